"""Files as rows: JSON arrays, JSON lines, CSV, file listings, and the parquet and JSON sinks."""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.sources import paths

CHUNK = 8 << 20


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A file that is one JSON array, with a declared schema and ``pos``, the place in the file."""
    return spark.read.json(path, schema=schema, multiLine=True).withColumn("pos", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones give nulls and stay in ``_corrupt_record`` if the schema has it."""
    return spark.read.json(path, schema=schema, mode="PERMISSIVE")


def array_items(read: Callable[[int], bytes], chunk: int = CHUNK) -> Iterator[str]:
    """Items of a JSON array as text, up to the last whole one, from a source read ``chunk`` bytes at a time.

    Only the items not yet complete are held; while one does not end, twice as much is read each time.
    """
    decoder, decode = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")("replace").decode
    held, at, begun, more = "", 0, False, chunk
    while True:
        raw = read(more)
        held, at = held[at:] + decode(raw, not raw), 0
        if not begun:
            start = held.lstrip("\ufeff \t\r\n")
            if start[:1] not in ("", "["):
                return
            begun = bool(start)
            held = start[1:]
        while begun:
            while at < len(held) and held[at] in " \t\r\n,":
                at += 1
            if held[at : at + 1] == "]":
                return
            try:
                value, end = decoder.raw_decode(held, at)
            except json.JSONDecodeError:
                more *= 2
                break
            if end == len(held) and raw and not isinstance(value, (dict, list, str)):
                break  # a number may go on in the next chunk
            yield held[at:end]
            at, more = end, chunk
        if not raw:
            return


def read_json_prefix(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON arrays whose tail may be cut off: the valid prefix of each file, as ``path, pos, item``.

    A file is read by one task, ``CHUNK`` bytes at a time; something that is no array has no items.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for name in frame["path"]:
                system, at = fs.FileSystem.from_uri(name if "://" in name or not name.startswith("file:") else "file://" + name[5:])
                with system.open_input_stream(at) as stream:
                    numbered = enumerate(array_items(stream.read))
                    while some := list(islice(numbered, 1000)):
                        yield pd.DataFrame({"path": [name] * len(some), "pos": [k for k, _ in some], "raw": [x for _, x in some]})

    return files.mapInPandas(run, "path string, pos long, raw string").select("path", "pos", F.from_json("raw", schema).alias("item"))


def read_annotations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV annotations with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, name, stem, length`` of all files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def file_index(spark: SparkSession, roots: list[str], pattern: str = "*.mp4") -> DataFrame:
    """``key, path``: every file under its relative path, its stem and its name; later roots replace earlier ones."""
    parts = []
    for k, root in enumerate(roots):
        files = list_files(spark, root, pattern)
        relative = F.element_at(F.split("path", paths.inner(spark, root)), -1)
        parts.append(files.select(F.explode(F.array(relative, "stem", "name")).alias("key"), "path", F.lit(k).alias("root")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("key").agg(F.max_by("path", F.struct("root", "path")).alias("path"))


def parquet_paths(path: str, tag: str | None = None) -> list[str]:
    """Files to read: of a folder (with a tag) all sorted, of a file its train and test siblings if both exist; none is an error."""
    spark = SparkSession.active()
    mark = f"*{tag}*.parquet" if tag else "*.parquet"
    if paths.is_folder(spark, path):
        found = paths.matching(spark, os.path.join(path, mark))
    else:
        folder = os.path.dirname(path)
        pair = [os.path.join(folder, f"{n}{'_' + tag if tag else ''}.parquet") for n in ("train", "test")]
        found = pair if all(paths.exists(spark, p) for p in pair) else paths.matching(spark, path)
    if not found:
        raise FileNotFoundError(f"no parquet file at {path}")
    return found


def write_splits(df: DataFrame, folder: str, window: int, prompt: str, rows_per_file: int | None = None) -> str:
    """Parquet below ``window_{w}/{prompt}``, partitioned by split; returns the path."""
    to = os.path.join(folder, f"window_{window}", prompt)
    writer = df.write.mode("overwrite").option("compression", "zstd").partitionBy("split")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(to)
    return to


def write_verified(df: DataFrame, path: str) -> int:
    """Zstandard parquet; the rows read back must be as many as written, which the writer itself counts."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path).count()
    if back != seen.get["n"]:
        raise OSError(f"{path}: {back} rows read, {seen.get['n']} written")
    return back


def append_results(df: DataFrame, path: str) -> None:
    """Results added as JSON lines; with :func:`framewise.operators.answers.resume` a run goes on where it stopped."""
    df.write.mode("append").json(path)


def convert_parquet(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("overwrite").json(target)


def describe_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``column, type, bytes, rows`` of parquet files from their footers alone."""
    import pyarrow.parquet as pq

    files = list_files(spark, path, "*.parquet").select("path").distinct() if paths.is_folder(spark, path) else spark.createDataFrame([(path,)], "path string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for name in frame["path"]:
                system, at = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), paths.plain(name))
                meta = pq.read_metadata(system.open_input_file(at))
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    cols = [group.column(c) for c in range(group.num_columns)]
                    yield pd.DataFrame({"column": [c.path_in_schema for c in cols], "type": [c.physical_type for c in cols], "bytes": [c.total_compressed_size for c in cols], "rows": group.num_rows})

    return files.mapInPandas(run, "column string, type string, bytes long, rows long").groupBy("column", "type").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
