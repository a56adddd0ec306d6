"""Subtitle files in SRT notation as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.text import strip
from framewise.functions.timeline import clock_seconds


def parse_srt(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Cues of SRT texts: keys, cue (from 0), start, end (seconds), line.

    Blocks stand between blank lines; a block with fewer than three lines or without a readable ``-->`` line is skipped.
    Text lines are joined by a space and font tags removed.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "﻿", "")
    blocks = df.select(*keys, F.posexplode(F.split(strip(plain), r"\n\s*\n")).alias("block", "body"))
    lines = blocks.withColumn("lines", F.split(strip(F.col("body")), "\n")).where(F.size("lines") >= 3)
    times = lines.withColumn("ends", F.split(F.col("lines")[1], "-->")).where(F.size("ends") == 2)
    start, end = (clock_seconds(F.trim(F.col("ends")[k])) for k in (0, 1))
    said = F.regexp_replace(F.array_join(F.transform(F.slice("lines", F.lit(3), F.size("lines")), strip), " "), r"</?font[^>]*>", "")
    return times.select(*keys, F.col("block").alias("cue"), start.alias("start"), end.alias("end"), strip(said).alias("line")).where("start is not null and end is not null")


def read_srt_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Cues of every ``.srt`` file below a folder, with the file's path; each file is read by one task."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.srt").text(folder, wholetext=True)
    return parse_srt(files.select(F.input_file_name().alias("path"), F.col("value")), ["path"], "value")
