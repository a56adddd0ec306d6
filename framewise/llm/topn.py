"""Top N items within every group.

A mergeable aggregation: each task keeps the N best rows of every group it meets (a bounded heap per group, held as
sorted column blocks), writes only those to the shuffle, and the reducers merge the heaps of all tasks with the same
routine.  A group of any size costs N rows per map task in the shuffle, so no group can overload one task.

Order: higher score first, equal scores by smaller id.  Rows whose score or group key is null or whose score is NaN
belong to no heap.  Repeated rows each count.  Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framewise.llm.common import vectors

#: Rows a task holds before it shrinks its heaps again.
HELD_ROWS = 400_000


def best_rows(block: pa.Table, keys: list[str], score: str, ident: str, n: int) -> pa.Table:
    """The ``n`` first rows of every group of a block, by score descending and id ascending."""
    if block.num_rows == 0:
        return block
    group = np.zeros(block.num_rows, dtype=np.int64)
    for key in keys:
        codes = pc.dictionary_encode(block[key].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)
    value = block[score].to_numpy()
    name = block[ident]
    tie = name.to_numpy() if pa.types.is_integer(name.type) else pc.rank(name.combine_chunks(), tiebreaker="dense").to_numpy()
    order = np.lexsort((tie, -value, group))
    ranked = group[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return block.take(pa.array(order[place < n]))


def heaps(batches: Iterator[pa.RecordBatch], schema: pa.Schema, keys: list[str], score: str, ident: str, n: int) -> Iterator[pa.RecordBatch]:
    """Fold batches into bounded heaps; used on both sides of the shuffle."""
    held, size, floor = [], 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(pa.Table.from_batches([batch]).cast(schema))
        size += batch.num_rows
        if size > HELD_ROWS + 2 * floor:
            held = [best_rows(pa.concat_tables(held), keys, score, ident, n)]
            size = floor = held[0].num_rows
    if held:
        yield from best_rows(pa.concat_tables(held), keys, score, ident, n).combine_chunks().to_batches(max_chunksize=50_000)


def top_n_per_group(df: DataFrame, keys: list[str], score: str, ident: str, n: int, scorer: Callable | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Keep the ``n`` best rows of each group.

    ``scorer`` maps an Arrow batch of ``df`` to an Arrow batch of ``schema`` before the heaps, in the same task; without
    it the rows of ``df`` are used as they are.  All columns of the chosen rows are kept.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    schema = schema or df.schema
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema]
    if len(set(names)) != len(names):
        raise ValueError("column names must differ; rename clashing ones first")
    if scorer is None:
        good = F.col(f"`{score}`").isNotNull() & ~F.isnan(F.col(f"`{score}`").cast("double"))
        for key in keys:
            good = good & F.col(f"`{key}`").isNotNull()
        df = df.where(good)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from heaps((scorer(b) for b in batches) if scorer else batches, arrow, keys, score, ident, n)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from heaps(batches, arrow, keys, score, ident, n)

    partial = df.mapInArrow(before, schema)
    return partial.repartition(*[F.col(f"`{k}`") for k in keys]).mapInArrow(after, schema)


FOUND = T.StructType([T.StructField("probe_id", T.IntegerType()), T.StructField("video_id", T.StringType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def probe_scorer(probe_ids: list[int], probe_matrix: np.ndarray) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Score every usable embedding against every probe with a dot product in double."""
    schema = to_arrow_schema(FOUND)
    dim = probe_matrix.shape[1]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, matrix = vectors(batch.column("embedding"), dim)
        scores = matrix @ probe_matrix.T
        video, vec = batch.column("video_id").take(pa.array(rows)), batch.column("vec_id").take(pa.array(rows))
        parts = []
        for k, probe in enumerate(probe_ids):
            fine = ~np.isnan(scores[:, k])
            keep = pa.array(np.flatnonzero(fine))
            parts.append(pa.table([pa.array(np.full(len(keep), probe, dtype=np.int32)), video.take(keep), vec.take(keep), pa.array(scores[fine, k])], schema=schema))
        joined = pa.concat_tables(parts).combine_chunks()
        return joined.to_batches()[0] if joined.num_rows else pa.RecordBatch.from_pylist([], schema=schema)

    return score


#: Probes are scored by one matrix product; more rows than this are not a probe table.
MOST_PROBES = 1024


def best_windows(windows: DataFrame, probes: DataFrame, n: int = 4) -> DataFrame:
    """The ``n`` highest scoring windows of every video for every probe, as (probe_id, video_id, vec_id, score).

    Null, wrong-length and NaN-bearing embeddings have no score; rows without video_id belong to no group; an
    all-zero embedding scores 0.  The probes are a small fixed table; more than ``MOST_PROBES`` raise an error.
    """
    asked = probes.select("probe_id", "embedding").where("probe_id is not null").limit(MOST_PROBES + 1).collect()
    if len(asked) > MOST_PROBES:
        raise ValueError(f"more than {MOST_PROBES} probes")
    asked = [r for r in asked if r.embedding and not any(x is None or x != x for x in r.embedding)]
    if not asked:
        return windows.sparkSession.createDataFrame([], FOUND)
    matrix = np.array([r.embedding for r in asked], dtype=np.float64)
    rows = windows.select("vec_id", "video_id", "embedding").where("video_id is not null and vec_id is not null")
    return top_n_per_group(rows, ["probe_id", "video_id"], "score", "vec_id", n, probe_scorer([r.probe_id for r in asked], matrix), FOUND)
