"""Paths of any file system that Spark reads: local, HDFS, object stores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """The file system of a path and the path on it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = place(spark, path)
    return system.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, at = place(spark, path)
    return system.exists(at) and system.getFileStatus(at).isDirectory()


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether there is any file below a folder; the listing ends at the first."""
    system, at = place(spark, path)
    return is_folder(spark, path) and system.listFiles(at, True).hasNext()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths a pattern names, sorted; of the local file system without its scheme."""
    system, at = place(spark, pattern)
    found = system.globStatus(at)
    return sorted(plain(f.getPath().toString()) for f in found or [])


def plain(path: str) -> str:
    """A local path without scheme; others as they are."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def inner(spark: SparkSession, path: str) -> str:
    """The path part of a folder, with a slash at the end."""
    system, at = place(spark, path)
    return at.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri().getPath().rstrip("/") + "/"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local runs."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        shared = tempfile.gettempdir()
    folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, at = place(spark, folder)
    system.deleteOnExit(at)
    return folder
