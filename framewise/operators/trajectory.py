"""Operators on tagged trajectories and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions.text import found, last_of, strip

RESPONSE, CLOSE = "<tool_response>", "</tool_response>"
#: A tool's block, closed by the tag that opens it.
TOOL_BLOCK = r"(?s)(<(search(?:_summary|_subtitle)?)>.*?</\2>)"


def readable(c: Column) -> Column:
    """Without vision tokens, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"<\|(?:vision_start|vision_end|image_pad)\|>", ""), r"\s+", " "))


def turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """Turns of a trajectory in order: key, turn, kind (images, answer), images, vision_blocks, said, tool, answer.

    The text of a turn starts after the previous tool response.  An answer with a tool response after it is tentative and
    dropped; a tool response without an end is none.
    """
    whole = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|endoftext|>"), F.lit(""))
    parts = df.select(key, F.split(whole, CLOSE).alias("parts")).select(key, F.size("parts").alias("m"), F.posexplode("parts").alias("i", "part"))
    opened = F.contains(F.col("part"), F.lit(RESPONSE))
    block = F.substr(F.col("part"), F.instr(F.col("part"), RESPONSE))
    image = F.struct(F.lit(0).alias("j"), F.lit("images").alias("kind"), F.col("part").alias("span"), block.alias("body"))
    # In the last part only what follows its last (unclosed) tool response can be final.
    pieces = F.split(F.col("part"), "</answer>")
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda b: F.concat(b, F.lit("</answer>")))
    final = F.when(opened, F.array().cast("array<string>")).otherwise(F.filter(bodies, lambda b: F.contains(b, F.lit("<answer>"))))
    answers = F.transform(final, lambda b, j: F.struct(j.alias("j"), F.lit("answer").alias("kind"), F.array_join(F.slice(bodies, F.lit(1), F.array_position(bodies, b).cast("int")), "").alias("span"), last_of(b, r"(?s)<answer>(.*?)</answer>").alias("body")))
    events = F.when(F.col("i") < F.col("m") - 1, F.when(opened, F.array(image)).otherwise(F.array().cast("array<struct<j:int,kind:string,span:string,body:string>>"))).otherwise(answers)
    rows = parts.select(key, "i", F.explode(events).alias("e")).select(key, "i", "e.*")
    clean = readable(F.col("span"))
    return rows.select(
        key, F.row_number().over(W.partitionBy(key).orderBy("i", "j")).alias("turn"), "kind",
        F.when(F.col("kind") == "images", F.regexp_count("body", F.lit(r"<\|image_pad\|>"))).alias("images"),
        F.when(F.col("kind") == "images", F.regexp_count("body", F.lit(r"<\|vision_start\|>"))).alias("vision_blocks"),
        strip(F.regexp_replace(clean, r"(?s)<think>.*?</think>", "")).alias("said"),
        F.coalesce(strip(F.regexp_replace(last_of(clean, TOOL_BLOCK), "</?(search|search_summary|search_subtitle)>", "")), F.lit("")).alias("tool"),
        F.when(F.col("kind") == "answer", strip(F.col("body"))).alias("answer"),
    )


def tool_usage(messages: DataFrame, key: str) -> DataFrame:
    """Tool calls, images (most over passes) and distinct windows of each question's messages (key, pass_idx, content)."""
    calls = F.size(found(F.col("content"), r"<(search|search_subtitle|search_summary)>"))
    windows = F.flatten(F.transform(found(F.col("content"), r"window_indices=\[([0-9, ]*)\]"), lambda w: F.split(F.replace(w, F.lit(" "), F.lit("")), ",")))
    rows = messages.select(key, "pass_idx", calls.alias("calls"), F.size(found(F.col("content"), r"(<\|image_pad\|>)")).alias("images"), F.filter(windows, lambda w: w != "").alias("windows"))
    per_pass = rows.groupBy(key, "pass_idx").agg(F.sum("calls").alias("calls"), F.sum("images").alias("images"))
    seen = rows.select(key, F.explode("windows").alias("w")).groupBy(key).agg(F.count_distinct("w").alias("windows"))
    return per_pass.groupBy(key).agg(F.sum("calls").alias("calls"), F.max("images").alias("images")).join(seen, key, "left").select(key, "calls", "images", F.coalesce("windows", F.lit(0)).alias("windows"))


def tool_histogram(messages: DataFrame) -> DataFrame:
    """Names of called functions with their counts."""
    return messages.select(F.explode(found(F.col("content"), r"<tool_call>\s*(\w+)\(")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
