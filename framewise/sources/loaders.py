"""Benchmark datasets as entries, and entries as training rows.

Every loader takes the folder of a dataset and gives ``pos`` and the fields of :data:`framewise.schemas.ENTRY`.  A
refined file with propositions, if there is one, is returned as it is.  Choices are text.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.text import BOILERPLATE, choice_to_index, option_lines, strip
from framewise.operators.dataset import keep_first, running_offset
from framewise.schemas import ENTRY_PULS
from framewise.sources import paths
from framewise.sources.files import list_files, read_json_array

TEXT = T.StringType()
# Fixed values, here and in the loaders: names of the datasets' files, folders and fields.
REFINED = "puls_refined.json"


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def refined(spark: SparkSession, folder: str, name: str = REFINED) -> DataFrame | None:
    path = os.path.join(folder, name)
    return read_json_array(spark, path, ENTRY_PULS) if paths.exists(spark, path) else None


def entry(question: Column, candidates: Column, choice: Column, raw: Column, subtitle: Column, video: Column, video_id: Column, ident: Column, original: Column) -> list[Column]:
    return [
        question.alias("question"), candidates.alias("candidates"), choice.cast("string").alias("correct_choice"),
        F.struct(raw.alias("raw_video_path"), subtitle.alias("subtitle_path"), video.alias("video_path")).alias("paths"),
        F.struct(video_id.cast("string").alias("video_id"), ident.cast("string").alias("id"), original.alias("original_data")).alias("metadata"),
    ]


def asked(question: Column, boilerplate: str = BOILERPLATE[0]) -> Column:
    return F.concat(F.lit(f"\n {boilerplate} \nQuestion: "), question, F.lit(" \n"))


def at(*parts) -> Column:
    """Path of constant and column parts."""
    return F.concat_ws("/", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def where_file_exists(rows: DataFrame, spark: SparkSession, folder: str, name: Column) -> DataFrame:
    """Rows whose file is below the folder; one listing, no file is opened."""
    if not paths.holds_files(spark, folder):
        return rows.limit(0)
    base = paths.inner(spark, folder)
    there = list_files(spark, folder).select(F.element_at(F.split("path", base), -1).alias("_file"))
    return rows.withColumn("_file", name).join(there, "_file", "left_semi").drop("_file")


def by_category(rows: DataFrame) -> DataFrame:
    """Order of a dataset: categories as first seen, entries within them by place."""
    first = F.min("pos").over(W.partitionBy("category"))
    return rows.withColumn("_first", first).orderBy("_first", "pos").drop("_first")


def load_lvb(spark: SparkSession, folder: str, burned: str) -> DataFrame:
    """Long-video questions with a burned-in video; grouped by category in first-seen order."""
    done = refined(spark, folder)
    if done is not None:
        return done
    schema = fields(id=TEXT, video_id=TEXT, video_path=TEXT, subtitle_path=TEXT, question=TEXT, question_category=TEXT, candidates=T.ArrayType(TEXT), correct_choice=TEXT)
    rows = read_json_array(spark, os.path.join(folder, "lvb_val.json"), schema)
    original = F.to_json(F.struct(*schema.names))
    file = F.concat("video_id", F.lit(".mp4"))
    kept = where_file_exists(rows, spark, os.path.join(burned, "burn-subtitles"), file).withColumn("category", F.col("question_category"))
    cols = entry(asked(F.col("question")), F.col("candidates"), F.col("correct_choice"), at(folder, "videos", F.col("video_path")), at(folder, "subtitles", F.col("subtitle_path")), at(burned, "burn-subtitles", file), F.col("video_id"), F.col("id"), original)
    return by_category(kept).select("pos", "category", *cols)


def load_lvbench(spark: SparkSession, folder: str, file: str = "lvbench.json") -> DataFrame:
    """Questions whose options stand on the lines after the question; answers under any of three names."""
    done = refined(spark, folder)
    if done is not None:
        return done
    schema = fields(key=TEXT, id=TEXT, uid=TEXT, question=TEXT, answer=TEXT, gt=TEXT, correct_choice=TEXT, candidates=T.ArrayType(TEXT), options=T.ArrayType(TEXT), video=TEXT, video_path=TEXT, category=TEXT, task_type=TEXT)
    rows = read_json_array(spark, os.path.join(folder, file), schema)
    video_id = F.coalesce("key", "id", F.concat(F.lit("video_"), F.col("pos").cast("string")))
    lines = F.split("question", "\n")
    name = F.coalesce("video", "video_path", F.concat(video_id, F.lit(".mp4")))
    kept = where_file_exists(rows, spark, os.path.join(folder, "videos"), name).withColumn("category", F.coalesce("category", "task_type", F.lit("general")))
    path = at(folder, "videos", name)
    candidates = F.coalesce("candidates", "options", F.slice(lines, 2, 1000))
    cols = entry(asked(lines[0], BOILERPLATE[1]), candidates, F.coalesce("answer", "gt", "correct_choice"), path, F.lit(None).cast("string"), path, video_id, F.coalesce("uid", video_id), F.to_json(F.struct(*schema.names)))
    return by_category(kept).select("pos", "category", *cols)


def load_videomme(spark: SparkSession, folder: str, file: str = "videomme.json") -> DataFrame:
    """Questions kept if the raw or the burned video exists; subtitles are read with :mod:`framewise.sources.srt`."""
    done = refined(spark, folder)
    if done is not None:
        return done
    schema = fields(video_id=TEXT, videoID=TEXT, question_id=TEXT, question=TEXT, options=T.ArrayType(TEXT), candidates=T.ArrayType(TEXT), answer=TEXT, task_type=TEXT, category=TEXT)
    rows = read_json_array(spark, os.path.join(folder, file), schema)
    video = F.coalesce("videoID", "video_id")
    name = F.concat(video, F.lit(".mp4"))
    raw, burned = (where_file_exists(rows, spark, os.path.join(folder, d), name).select("pos") for d in ("data", "burn-subtitles"))
    both = raw.withColumn("raw", F.lit(True)).join(burned.withColumn("burned", F.lit(True)), "pos", "full")
    kept = rows.join(both, "pos").withColumn("category", F.coalesce("task_type", "category", F.lit("general")))
    raw_path, burned_path = F.when(F.col("raw"), at(folder, "data", name)), F.when(F.col("burned"), at(folder, "burn-subtitles", name))
    cols = entry(asked(F.col("question")), F.coalesce("options", "candidates"), F.col("answer"), raw_path, at(folder, "subtitle", F.concat(video, F.lit(".srt"))), F.coalesce(burned_path, raw_path), video, F.coalesce("question_id", video), F.to_json(F.struct(*schema.names)))
    return by_category(kept).select("pos", "category", *cols)


MLVU_CATEGORIES = ("1_plotQA", "2_needle", "3_ego", "4_count", "5_order", "6_anomaly_reco", "7_topic_reasoning")


def load_mlvu(spark: SparkSession, folder: str, categories: tuple[str, ...] = MLVU_CATEGORIES) -> DataFrame:
    """Category files under one running id: lists, objects with a list inside, or single objects; answers by text.

    A row whose answer is none of its options is dropped.
    """
    done = refined(spark, folder)
    if done is not None:
        return done
    item = fields(question=TEXT, candidates=T.ArrayType(TEXT), options=T.ArrayType(TEXT), choices=T.ArrayType(TEXT), answer=TEXT, video=TEXT, category=TEXT, task_type=TEXT)
    schema = T.StructType([*item.fields, *[T.StructField(n, T.ArrayType(item)) for n in ("data", "questions", "items")]])
    parts = []
    for k, category in enumerate(categories):
        path = os.path.join(folder, "json", f"{category}.json")
        if not paths.exists(spark, path):
            continue
        rows = read_json_array(spark, path, schema)
        own = F.array(F.struct(*item.names))
        inner = rows.select("pos", F.posexplode(F.coalesce("data", "questions", "items", own)).alias("inner", "i"))
        parts.append(inner.select(F.lit(k).alias("file"), "pos", "inner", "i.*", F.lit(category).alias("folder")))
    if not parts:
        raise FileNotFoundError(f"no category file below {folder}/json")
    rows = running_offset(reduce(DataFrame.unionByName, parts), "file", "pos", "inner").withColumnRenamed("index", "id").drop("inner")
    video = F.concat_ws("/", "folder", "video")
    rows = rows.withColumn("video", video).withColumn("category", F.coalesce("category", "folder")).withColumn("options", F.coalesce("options", "candidates", "choices"))
    place = F.array_position("options", F.col("answer")) - 1
    name = F.when(F.col("video").rlike(r"\.(mp4|avi|mov|mkv)$"), F.col("video")).otherwise(F.concat("video", F.lit(".mp4")))
    kept = where_file_exists(rows.where(place >= 0), spark, os.path.join(folder, "video"), name).withColumn("pos", F.col("id"))
    path = at(folder, "video", name)
    cols = entry(asked(F.col("question"), "This is a multiple choice question. You must choose the correct answer as a number."), F.col("options"), place, path, F.lit(None).cast("string"), path, F.split_part("video", F.lit("."), F.lit(1)), F.col("id"), F.to_json(F.struct("question", "options", "answer", "video", "category", "id")))
    return by_category(kept).select("pos", "category", *cols)


CGBENCH_FILES = ("cgbench_puls.json", "cgbench.json", "cgbench_mini.json")


def load_cgbench(spark: SparkSession, folder: str, files: tuple[str, ...] = CGBENCH_FILES) -> DataFrame:
    """The first file that exists; answers as letters, numbers or texts become 0-based numbers."""
    path = next((os.path.join(folder, f) for f in files if paths.exists(spark, os.path.join(folder, f))), None)
    if path is None:
        raise FileNotFoundError(f"none of {files} in {folder}")
    item = fields(qid=TEXT, id=TEXT, video_uid=TEXT, video_id=TEXT, question=TEXT, choices=T.ArrayType(TEXT), options=T.ArrayType(TEXT), right_answer=TEXT, answer=TEXT)
    schema = T.StructType([*item.fields, *[T.StructField(n, T.ArrayType(item)) for n in ("data", "questions")]])
    rows = read_json_array(spark, path, schema).select("pos", F.posexplode(F.coalesce("data", "questions", F.array(F.struct(*item.names)))).alias("inner", "i"))
    rows = running_offset(rows.select("pos", "inner", "i.*"), None, "pos", "inner").withColumn("pos", F.col("index")).drop("inner", "index")
    candidates, video = F.coalesce("choices", "options"), F.coalesce("video_uid", "video_id")
    kept = where_file_exists(rows, spark, os.path.join(folder, "videos"), F.concat(video, F.lit(".mp4")))
    vpath = at(folder, "videos", F.concat(video, F.lit(".mp4")))
    cols = entry(asked(F.col("question")), candidates, choice_to_index(F.coalesce("right_answer", "answer"), candidates), vpath, at(folder, "subtitles", F.concat(video, F.lit(".srt"))), vpath, video, F.coalesce("qid", "id", video), F.to_json(F.struct(*item.names)))
    return kept.orderBy("pos").select("pos", *cols)


def unique_videos(entries: DataFrame) -> DataFrame:
    """First entry of each video, as indexing needs it."""
    return keep_first(entries.withColumn("_video", F.col("metadata.video_id")), ["_video"], ["pos"]).drop("_video")


def rl_row(entries: DataFrame, topk: int = 4, style: str = "paren", system: str | None = None) -> DataFrame:
    """Rows of ``data_input`` as training rows; the prompt is built in the plan, paths stay nested."""
    options = F.split("options", r"\n| \| ")
    body = F.concat_ws("\n", strip(F.col("question")), option_lines(options, style))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = F.array(*([message("system", F.lit(system))] if system else []), message("user", body))
    execute = F.struct(F.lit(topk).alias("topk"), F.col("video_id"), F.col("data_source").alias("dataset"))
    extra = F.struct(
        F.col("entry_id").alias("index"), "question", options.alias("candidates"), F.col("answer").cast("string").alias("correct_choice"), F.struct(F.col("video_id").cast("string").alias("video_id")).alias("metadata"), "paths", "split",
        F.struct(F.struct(execute.alias("execute_kwargs")).alias("video_search")).alias("tools_kwargs"),
    )
    reward = F.struct(F.lit("rule").alias("style"), F.col("answer").cast("string").alias("ground_truth"))
    return entries.select("data_source", prompt.alias("prompt"), F.lit("video_qa").alias("ability"), reward.alias("reward_model"), extra.alias("extra_info"))


def tree_inputs(narrations: DataFrame, annotations: DataFrame, durations: DataFrame) -> DataFrame:
    """Narration, question, five options, truth and duration by uid; a uid without a duration is an error when read."""
    joined = narrations.join(annotations, "uid").join(durations, "uid", "left")
    checked = F.when(F.col("duration").isNull(), F.raise_error(F.concat(F.lit("no duration for "), F.col("uid")))).otherwise(F.col("duration"))
    filled = F.slice(F.concat("options", F.array_repeat(F.lit(""), 5)), 1, 5)
    return joined.select("uid", F.concat_ws("_", "uid", "qid").alias("quid"), "narration", "question", filled.alias("options"), "truth", checked.alias("duration"))
