"""Results and events as streams: running scores, event-time windows, late data and exactly-once batches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_results(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", files_a_batch: int = 100) -> DataFrame:
    """Result files as they arrive; the schema is declared."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(folder)


def running_accuracy(results: DataFrame, key: str) -> DataFrame:
    right = F.coalesce(F.col("parsed") == F.col("gt"), F.lit(False))
    return results.groupBy(key).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by event-time window and type; later events than ``late`` are dropped once the watermark has passed."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop.  A batch writes a folder of its own number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
