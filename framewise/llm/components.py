"""Connected components, and splits that keep related records together.

Components grow breadth first from many seeds at once over hash-partitioned adjacency lists.  A seed is a vertex whose
hash is the least among its neighbours', so every component has one.  Where two labels meet on an edge, the pair of
labels becomes an edge of a smaller graph, and the same routine runs on that graph until no labels meet.  All state
stays in DataFrames; each round is cut by a checkpoint in the shared folder.  The adjacency lists are hash-partitioned once;
a round moves only its frontier to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.llm.common import cut, spread
from framewise.llm.normal import video_key, words_of


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected ``edges`` (a, b) in both directions (src, dst), each once, written hash-partitioned by ``src``."""
    found = edges.where("a <> b").select("a", "b")
    both = found.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(found.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    conf = edges.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    # An adaptive plan doesn't tell how its result is partitioned, so this one is planned without.
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(both.repartition(int(conf.get("spark.sql.shuffle.partitions")), "src").dropDuplicates(["src", "dst"]))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def reach(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Vertices next to the frontier (v, label) with the least label that reaches them."""
    return edges.join(frontier, edges.src == frontier.v).groupBy("dst").agg(F.min("label").alias("label")).select(F.col("dst").alias("v"), "label")


def label_by_frontier(edges: DataFrame) -> DataFrame:
    """One level: every vertex of ``edges`` (src, dst; both directions) with the label of a seed that reached it."""
    near = edges.groupBy("src").agg(F.min(F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("v"))).alias("low"))
    labels = frontier = cut(near.where(F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("v")) < F.col("low")).select(F.col("src").alias("v"), F.col("src").alias("label")))
    for turn in range(1, 1_000_000):
        frontier = cut(reach(edges, frontier).join(labels, "v", "left_anti"))
        if frontier.isEmpty():
            return labels
        # The rounds are written ones already; their union is written anew only when it has grown long.
        labels = labels.unionByName(frontier)
        labels = cut(labels) if turn % 8 == 0 else labels
    raise AssertionError("a frontier can't go on for ever")


def components(edges: DataFrame) -> DataFrame:
    """``(v, component)`` for every vertex of the undirected ``edges`` (a, b).

    Self-loops, nulls and repeated edges are ignored; a vertex without an edge to another has no row.
    """
    both = adjacency(edges)
    if both.isEmpty():
        return both.select(F.col("src").alias("v"), F.col("dst").alias("component"))
    labels = label_by_frontier(both)
    left = labels.select(F.col("v").alias("src"), F.col("label").alias("a"))
    right = labels.select(F.col("v").alias("dst"), F.col("label").alias("b"))
    met = cut(both.join(left, "src").join(right, "dst").where("a < b").select("a", "b").distinct())
    if met.isEmpty():
        return labels.select("v", F.col("label").alias("component"))
    upper = components(met).select(F.col("v").alias("label"), F.col("component").alias("upper"))
    return labels.join(upper, "label", "left").select("v", F.coalesce("upper", "label").alias("component"))


def record_keys(entries: DataFrame) -> DataFrame:
    """``entry_id``, the canonical ``video`` and a 128-bit key ``asked`` of the question's words; both null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = (words_of(q) if q else [] for q in b.column("question").to_pylist())
            asked = [xxhash.xxh3_128_digest(" ".join(w)) if w else None for w in words]
            yield pa.RecordBatch.from_arrays([b.column("entry_id"), pa.array(map(video_key, b.column("video_id").to_pylist()), pa.string()), pa.array(asked, pa.binary())], names=["entry_id", "video", "asked"])

    return spread(entries.select("entry_id", "video_id", "question")).mapInArrow(run, "entry_id long, video string, asked binary")


def video_ties(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``homes`` (asked, home: the least video of each question) and star edges (a, b) from each home to the question's other videos."""
    pairs = keys.where("video is not null and asked is not null").select("asked", "video").distinct()
    homes = pairs.groupBy("asked").agg(F.min("video").alias("home"), F.count("*").alias("n"))
    edges = pairs.join(homes.where("n > 1"), "asked").where("video <> home").select(F.col("home").alias("a"), F.col("video").alias("b"))
    return homes.select("asked", "home"), edges


def tied_videos(entries: DataFrame) -> DataFrame:
    """``(video, component)`` of every video that shares a question, directly or over others, with another."""
    _, edges = video_ties(record_keys(entries))
    return components(edges).withColumnRenamed("v", "video")


def tied_pairs(entries: DataFrame) -> DataFrame:
    """All pairs ``video_a < video_b`` of one component."""
    tied = cut(tied_videos(entries))
    a = tied.select("component", F.col("video").alias("video_a"))
    b = tied.select("component", F.col("video").alias("video_b"))
    return a.join(b, "component").where("video_a < video_b").select("video_a", "video_b")


#: Hash ranges over which rows are counted before components are put in order.
RANGES = 4096


def grouped_splits(entries: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """``entry_id, unit, split``: every row in one split, all rows of a unit in the same.

    A unit is a component; rows without a video go with their question, rows without a question with their video, rows
    with neither alone.  Units stand in the order of their hash; a unit belongs to the split in whose share of the
    rows its middle lies.  The order is cut into ``RANGES`` hash ranges, so no window spans all units.
    """
    shares = sorted((r.share or 0.0, r.split) for r in plan.where("split is not null").limit(1001).collect())[::-1]
    if not shares or len(shares) > 1000 or sum(s for s, _ in shares) <= 0:
        raise ValueError("the plan needs 1 to 1000 splits with positive shares")
    keys = cut(record_keys(entries))
    homes, edges = video_ties(keys)
    tied = components(edges).select(F.col("v").alias("video"), "component")
    # Rows without a video or question stay out of the joins on them, where they would all share one key.
    own = keys.where("video is not null").select("entry_id", "video")
    lent = keys.where("video is null and asked is not null").join(homes, "asked", "left")
    videos = own.unionByName(lent.where("home is not null").select("entry_id", F.col("home").alias("video"))).join(tied, "video", "left")
    alone = keys.where("video is null and asked is null").select("entry_id", F.concat(F.lit("row "), F.col("entry_id").cast("string")).alias("unit"))
    by_question = lent.where("home is null").select("entry_id", F.concat(F.lit("question "), F.hex("asked")).alias("unit"))
    rows = cut(videos.select("entry_id", F.coalesce("component", "video").alias("unit")).unionByName(by_question).unionByName(alone))
    sized = rows.groupBy("unit").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("unit", F.lit(seed))).withColumn("part", F.shiftright("h", 52) + RANGES // 2)
    sized = cut(sized)
    before, total = {}, 0
    for r in sorted(sized.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        before[r.part], total = total, total + r.n
    spark = entries.sparkSession
    offsets = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "part long, before long")
    run = F.sum("n").over(W.partitionBy("part").orderBy("h", "unit"))
    middle = (F.col("before") + run - F.col("n") / 2.0) / F.lit(float(max(total, 1)))
    whole, bound, split = sum(s for s, _ in shares), 0.0, F.lit(None).cast("string")
    for share, name in reversed(shares):
        bound += share / whole
        split = F.coalesce(split, F.when(F.col("middle") < bound, name))
    ordered = sized.join(F.broadcast(offsets), "part").withColumn("middle", middle)
    units = ordered.select("unit", F.coalesce(split, F.lit(shares[0][1])).alias("split"))
    return rows.join(units, "unit").select("entry_id", "unit", "split")
