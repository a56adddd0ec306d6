"""The video index as tables, partitioned by dataset and window size, and search over it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators import retrieval
from framewise.sources import paths

TABLES = ("frames", "window_embeddings", "subtitle_embeddings", "frame_subtitles")


def save_table(df: DataFrame, root: str, name: str) -> None:
    """Add rows (with dataset and window_size) to an index table; images stay in ``frames`` so others never read them."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    df.write.mode("append").option("compression", "zstd").partitionBy("dataset", "window_size").parquet(os.path.join(root, name))


def read_table(spark: SparkSession, root: str, name: str, dataset: str, window_size: int = 8) -> DataFrame:
    """One dataset's rows; only its partition is read."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(os.path.join(root, name)).where((F.col("dataset") == dataset) & (F.col("window_size") == window_size))


def missing(todo: DataFrame, spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Videos that the index does not hold yet."""
    if not paths.is_folder(spark, os.path.join(root, "window_embeddings")):
        return todo
    return todo.join(read_table(spark, root, "window_embeddings", dataset).select("video_id").distinct(), "video_id", "left_anti")


def search(spark: SparkSession, root: str, dataset: str, queries: DataFrame, topk: int = 4, mode: str = "base", video_id: str | None = None) -> DataFrame:
    """Ranked windows for ``queries`` (query_id, query_embedding) by ``base`` or ``subtitle`` search; without a video over all of them.

    An unknown mode is an error; an unknown video gives no rows.
    """
    if mode not in ("base", "subtitle"):
        raise ValueError(f"unknown mode {mode}")
    rows = read_table(spark, root, "window_embeddings" if mode == "base" else "subtitle_embeddings", dataset)
    if video_id is not None:
        rows = rows.where(F.col("video_id") == video_id)
    if mode == "base":
        found = retrieval.top_windows(rows.select("video_id", F.col("window_idx").cast("long").alias("item"), "embedding"), queries, topk, per_video=video_id is not None)
        return found.select("query_id", "video_id", F.col("item").cast("int").alias("window"), "sim", "rank")
    return retrieval.top_subtitles(rows.select("video_id", F.col("vec_id").alias("item"), "windows", "embedding"), queries, topk)
