"""Shared helpers: table access, checkpoints and decoding of embedding columns."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; only where it names none (tests) make one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "framewise-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so its lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, by a parquet table in the same folder: smaller than a checkpoint, and readers take single columns.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of plans that nothing refers to any more; else they stay until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than the cluster has cores (a few small files).

    Work per row is heavy where this is used; a scan with enough splits is left alone, so no large input is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable embedding, and those embeddings as float64.

    Usable: not null, ``dim`` long, no null or NaN entry.  An all-zero embedding is usable here.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    right = lengths == dim
    rows = np.flatnonzero(right)
    if not right.all():
        values = values[np.repeat(right, lengths)]
    matrix = values.reshape(len(rows), dim).astype(np.float64)
    clean = ~np.isnan(matrix).any(axis=1)
    return rows[clean], matrix[clean]
