"""Operators that rank windows and subtitles by similarity and check propositions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framewise.functions import vector

#: Queries are broadcast; more rows than this are no query table.
MOST_QUERIES = 10_000


def small(df: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """``df`` marked for broadcast after a check of its size."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return F.broadcast(df)


def query_matrix(queries: DataFrame, ident: str, vec: str, dim: int, most: int = MOST_QUERIES) -> tuple[list, np.ndarray]:
    """Ids and vectors of a query table after a check of its size; vectors of another length are left out."""
    rows = queries.select(ident, vec).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    rows = [r for r in rows if r[1] is not None and len(r[1]) == dim and not any(x is None or x != x for x in r[1])]
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), dim)


def similarities(rows: DataFrame, queries: DataFrame, dim: int = 64, floor: float = 0.0, ident: str = "query_id", vec: str = "query_embedding", digits: int | None = 6, best: tuple[int, str | None, str] | None = None) -> DataFrame:
    """Every row with every query and ``sim``, their cosine: columns of ``rows`` but the embedding, the query's id, sim.

    One matrix product an Arrow batch.  ``best`` (k, group column or None, tie column) leaves of every batch only the k
    most similar rows of each query and group, so few rows go back to the JVM.  Zero vectors have no similarity (null) unless ``floor`` bounds the norms; unusable
    embeddings give no rows.
    """
    names, matrix = query_matrix(queries, ident, vec, dim)
    keep = [f for f in rows.schema.fields if f.name != "embedding"]
    schema = T.StructType([*keep, queries.schema[ident], T.StructField("sim", T.DoubleType())])
    if not names:
        return rows.sparkSession.createDataFrame([], schema)
    lengths = np.linalg.norm(matrix, axis=1)
    name_type = to_arrow_type(queries.schema[ident].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            right = sizes == dim
            x = values[np.repeat(right, sizes)].reshape(-1, dim).astype(np.float64)
            fine = ~np.isnan(x).any(axis=1)
            place, x = np.flatnonzero(right)[fine], x[fine]
            own = np.linalg.norm(x, axis=1)
            step = max(1, 1_000_000 // max(1, len(x)))
            for k in range(0, len(names), step):
                scale = np.outer(np.maximum(own, floor), np.maximum(lengths[k : k + step], floor))
                with np.errstate(divide="ignore", invalid="ignore"):
                    sim = np.where(scale > 0, (x @ matrix[k : k + step].T) / scale, np.nan).ravel()
                sim = np.round(sim, digits) if digits is not None else sim
                m = len(names[k : k + step])
                row, query = np.repeat(np.arange(len(place)), m), np.tile(np.arange(m), len(place))
                if best is not None and len(row):
                    left = leaders(batch, place, row, query, sim, *best)
                    row, query, sim = row[left], query[left], sim[left]
                at = pa.array(place[row])
                asked = pa.array(names[k : k + step], name_type).take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(at) for f in keep], asked, pa.array(sim, from_pandas=True)], names=schema.names)

    return rows.mapInArrow(run, schema)


def leaders(batch: pa.RecordBatch, place: np.ndarray, row: np.ndarray, query: np.ndarray, sim: np.ndarray, k: int, group: str | None, tie: str) -> np.ndarray:
    """Which (row, query) of a batch are among the k first of their query and group, by sim and then tie; none without sim."""
    known = np.flatnonzero(~np.isnan(sim))
    row, query, sim = row[known], query[known], sim[known]
    rank_of = pc.rank(batch.column(tie).take(pa.array(place)), tiebreaker="dense").to_numpy()
    code = np.zeros(len(place), dtype=np.int64)
    if group is not None:
        code = pc.dictionary_encode(batch.column(group).take(pa.array(place))).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = query * (code.max(initial=0) + 2) + code[row] + 1
    order = np.lexsort((rank_of[row], -sim, owner))
    ranked = owner[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return known[order[nth < k]]


def top_windows(windows: DataFrame, queries: DataFrame, k: int, per_video: bool = True) -> DataFrame:
    """The ``k`` most similar windows per query (and video): query_id, video_id, item, sim, rank.

    ``windows`` has video_id, item, embedding; ``queries`` has query_id, query_embedding.  Cosine in double, rounded to 6
    decimals; ties by smaller item.  The rank filter plans to partial and final group limits.
    """
    good = windows.where(F.col("video_id").isNotNull())
    scored = similarities(good, queries, best=(k, "video_id" if per_video else None, "item")).select("query_id", "video_id", "item", "sim").where("sim is not null")
    w = W.partitionBy("query_id", *["video_id"] * per_video).orderBy(F.desc("sim"), "item")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_subtitles(subtitles: DataFrame, queries: DataFrame, k: int, size: int = 8) -> DataFrame:
    """Windows of the best subtitles until at least ``k`` distinct ones are found: query_id, video_id, window, first_rank.

    ``subtitles`` has video_id, item, windows (first frames), embedding.  The subtitle that reaches ``k`` counts whole,
    so the result may overshoot.
    """
    good = subtitles.where(F.col("video_id").isNotNull())
    group = ["query_id", "video_id"]
    scored = similarities(good, queries, floor=1e-8).select(*group, "item", "windows", "sim")
    # A window is found with its best subtitle; it counts if fewer than k windows have a better one.
    found = scored.select(*group, F.col("sim").alias("s"), F.col("item").alias("i"), F.explode("windows").alias("frame"))
    found = found.groupBy(*group, F.floor(F.col("frame") / size).cast("int").alias("window")).agg(F.min(F.struct((-F.col("s")).alias("s"), "i")).alias("best"))
    kept = found.withColumn("better", F.rank().over(W.partitionBy(*group).orderBy("best"))).where(F.col("better") <= k).select(*group, "window", "best")
    # Only subtitles as good as the last one needed are ranked, not a whole video's.
    last = kept.groupBy(*group).agg(F.max("best").alias("last"))
    needed = scored.join(last, group).select(*group, F.struct((-F.col("sim")).alias("s"), F.col("item").alias("i")).alias("best"), "last").where("best <= last")
    ranks = needed.withColumn("first_rank", F.row_number().over(W.partitionBy(*group).orderBy("best"))).select(*group, "best", "first_rank")
    return kept.join(ranks, [*group, "best"]).select(*group, "window", "first_rank")


def proposition_scores(retrieved: DataFrame, propositions: DataFrame, query: str) -> DataFrame:
    """Score of every proposition against the retrieved windows of its query: query_id, proposition, score.

    A proposition that starts with ``subtitle_`` is 1 if the query text is part of it; others take the best cosine.
    """
    said = F.col("proposition").startswith("subtitle_")
    seen = similarities(retrieved.select("query_id", "embedding"), propositions.where(~said), ident="proposition", vec="proposition_embedding").where("sim is not null")
    looks = seen.groupBy("query_id", "proposition").agg(F.max("sim").alias("score"))
    asked = retrieved.groupBy("query_id").agg(F.max(query).alias("asked"))
    text = F.when(F.contains(F.col("proposition"), F.col("asked")), 1.0).otherwise(0.0)
    return looks.unionByName(asked.crossJoin(small(propositions.where(said).select("proposition"))).select("query_id", "proposition", text.alias("score")))


def softmax_labels(clips: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The ``k`` likeliest labels of every clip by softmax of 100 times the cosine."""
    scored = similarities(clips, labels, ident="label", vec="label_embedding", digits=None).select("clip", "label", (F.col("sim") * 100).alias("z"))
    over = W.partitionBy("clip")
    shifted = scored.withColumn("e", F.exp(F.col("z") - F.max("z").over(over)))
    p = shifted.withColumn("p", F.round(F.col("e") / F.sum("e").over(over), 6))
    return p.withColumn("rank", F.row_number().over(over.orderBy(F.desc("p"), "label"))).where(F.col("rank") <= k).select("clip", "label", "p", "rank")


def nearest_centre(points: DataFrame, centres: DataFrame, cosine: bool = False) -> DataFrame:
    """Every point with its nearest centre: point, cluster, distance (rounded, ties to the smaller cluster).

    The centres are a checked small table; distances are taken by matrix operations on Arrow batches.
    """
    rows = centres.orderBy("cluster").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} centres")
    schema = T.StructType([points.schema["point"], centres.schema["cluster"], T.StructField("distance", T.DoubleType())])
    if not rows:
        return points.sparkSession.createDataFrame([], schema)
    names, matrix = [r.cluster for r in rows], np.array([r.centre for r in rows], dtype=np.float64)
    dim, name_type = matrix.shape[1], to_arrow_type(centres.schema["cluster"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            right = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) == dim
            kept = batch.filter(pa.array(right))
            x = kept.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            for k in range(0, len(x), 4096):
                part = x[k : k + 4096]
                if cosine:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = 1 - (part @ matrix.T) / np.outer(np.linalg.norm(part, axis=1), np.linalg.norm(matrix, axis=1))
                else:
                    d = np.stack([((part - c) ** 2).sum(axis=1) for c in matrix], axis=1)
                d = np.where(np.isnan(d), np.inf, np.round(d, 6))
                at = d.argmin(axis=1)
                least = d[np.arange(len(part)), at]
                fine = np.isfinite(least)
                yield pa.RecordBatch.from_arrays([kept.column("point").slice(k, len(part)).filter(pa.array(fine)), pa.array(names, name_type).take(pa.array(at[fine])), pa.array(least[fine])], names=schema.names)

    return points.select("point", "embedding").mapInArrow(run, schema)


def cluster_means(points: DataFrame, dim: int = 64) -> DataFrame:
    """Mean vector of each cluster of (cluster, embedding), summed before the shuffle."""
    sums = points.groupBy("cluster").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    return sums.select("cluster", F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("centre"))


def medoids(points: DataFrame, dim: int = 64) -> DataFrame:
    """Member of each cluster closest to its mean by L2, ties to the smallest point: cluster, point, distance."""
    near = points.join(cluster_means(points, dim), "cluster").select("cluster", "point", F.round(F.sqrt(vector.squared_distance(F.col("embedding"), F.col("centre"))), 6).alias("distance"))
    return near.groupBy("cluster").agg(F.min(F.struct("distance", "point")).alias("b")).select("cluster", "b.point", "b.distance")


def inverted_subtitles(rows: DataFrame, size: int = 8) -> DataFrame:
    """Windows in which each text of a video is shown, sorted: video_id, text, windows."""
    return rows.groupBy("video_id", "text").agg(F.array_sort(F.collect_set(F.floor(F.col("frame_idx") / size).cast("int"))).alias("windows"))


def cue_frames(cues: DataFrame) -> DataFrame:
    """Cues (video_id, start, end, text, fps, step, total) on every sampled frame they cover, the end inclusive and cut at the last.

    A text counts once a frame.  The interval join is an expansion and an equi-join.
    """
    low = F.floor(F.col("start") * F.col("fps") / F.col("step"))
    high = F.floor(F.col("end") * F.col("fps") / F.col("step"))
    top = F.col("total") - 1
    rows = cues.select("video_id", "text", F.greatest(low, F.lit(0)).cast("int").alias("low"), F.least(high, top).cast("int").alias("high")).where("low <= high")
    return rows.select("video_id", "text", F.explode(F.sequence("low", "high")).alias("frame_idx")).distinct()


def islands(df: DataFrame, key: str, value: str) -> DataFrame:
    """End-exclusive ranges of consecutive integers per key."""
    rows = df.select(key, F.col(value).cast("long").alias("v")).where("v is not null").distinct()
    placed = rows.withColumn("island", F.col("v") - F.row_number().over(W.partitionBy(key).orderBy("v")))
    return placed.groupBy(key, "island").agg(F.min("v").alias("start"), (F.max("v") + 1).alias("end")).drop("island")


def merged_calls(calls: DataFrame, key: str = "request") -> DataFrame:
    """Frames of parallel calls as one chronological list: first of each frame kept; frames without a number sort last."""
    place = F.coalesce(F.col("frame_idx"), F.lit(999_999) + F.col("call") * 100 + F.col("slot"))
    rows = calls.withColumn("place", place)
    first = F.row_number().over(W.partitionBy(key, "place").orderBy("call", "slot"))
    kept = rows.withColumn("nth", first).where("nth = 1").drop("nth")
    return kept.withColumn("order", F.row_number().over(W.partitionBy(key).orderBy("place")) - 1)
