"""Clustering of a video's frames: k-means, Ward splits and representative picking.

A video is one group of a grouped map as long as it has at most ``MOST_POINTS`` vectors.  Larger keys are clustered by
rounds over the whole cluster: nearest centre by a join, means by a combined aggregation; no task holds such a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions import vector
from framewise.operators.retrieval import cluster_means

#: Windows of one video that one task clusters at once (about nine days of video at a window every 8 seconds).
MOST_POINTS = 100_000


def distances(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        return 1.0 - unit(x) @ unit(centres).T
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


def seed_places(distinct: int, k: int, seed: int, rounds: int) -> np.ndarray:
    """Places of the seeds, and after them of the spare vectors for empty clusters, among the sorted distinct vectors."""
    return np.random.default_rng(seed).permutation(distinct)[: k * (rounds + 1)]


def renewed(centres: np.ndarray, means: dict[int, np.ndarray], pool: np.ndarray, turn: int, tol: float) -> tuple[np.ndarray, bool]:
    """Centres after a round, and whether they have come to rest."""
    k = len(centres)
    new = np.array([means[c] if c in means else pool[(k * (turn + 1) + c) % len(pool)] for c in range(k)], dtype=np.float64)
    return new, bool(np.linalg.norm(new - centres, axis=1).sum() ** 2 < tol)


def kmeans(x: np.ndarray, k: int, metric: str = "euclidean", seed: int = 0, tol: float = 1e-4, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Assignment and centres.

    Seeds are distinct rows; an empty cluster takes a random distinct row; stops when the squared total shift is below ``tol``.
    """
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    pool = distinct[seed_places(len(distinct), k, seed, rounds)]
    centres = pool[:k].astype(np.float64)
    for turn in range(rounds):
        own = distances(x, centres, metric).argmin(1)
        centres, rests = renewed(centres, {c: x[own == c].mean(0) for c in np.unique(own).tolist()}, pool, turn, tol)
        if rests:
            break
    return distances(x, centres, metric).argmin(1), centres


def kmeans_per_key(df: DataFrame, k: int, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """``key, point, cluster, distance`` of (key, point, embedding): k-means within each key, over points in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point")
        x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        centres = kmeans(x, k, metric, seed)[1]
        d = distances(x, centres, metric)
        return pd.DataFrame({"key": frame["key"], "point": frame["point"], "cluster": d.argmin(1).astype(np.int32), "distance": np.sqrt(np.maximum(d.min(1), 0)).round(6)})

    rows = df.select("key", "point", "embedding")
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_POINTS).select("key")
    out = rows.join(large, "key", "left_anti").groupBy("key").applyInPandas(run, "key string, point long, cluster int, distance double")
    if large.isEmpty():
        return out
    return out.unionByName(kmeans_rounds(rows.join(large, "key", "left_semi"), k, metric, seed))


def sorted_places(distinct: DataFrame, parts: int = 256) -> DataFrame:
    """Place of each of a key's distinct vectors in their order: counts per range of the first component plus a rank inside each."""
    lead = F.col("embedding")[0].cast("double")
    ends = distinct.groupBy("key").agg(F.min(lead).alias("low"), F.max(lead).alias("high"))
    share = F.coalesce(F.try_divide(lead - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    rows = distinct.join(ends, "key").select("key", "embedding", F.floor(share * (parts - 1)).alias("part"))
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    over = W.partitionBy("key").orderBy("part")
    before = counts.select("key", "part", (F.sum("n").over(over) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("key")).alias("all"))
    inside = F.row_number().over(W.partitionBy("key", "part").orderBy("embedding")) - 1
    return rows.join(before, ["key", "part"]).select("key", "embedding", (F.col("before") + inside).alias("place"), "all")


def kmeans_rounds(rows: DataFrame, k: int, metric: str = "euclidean", seed: int = 0, tol: float = 1e-4, dim: int = 64, rounds: int = 15) -> DataFrame:
    """:func:`kmeans` of keys of any size, a join and an aggregation a round, with the same seeds and rules."""
    state = "key string, k int, pool array<array<double>>, centres array<array<double>>, rests boolean"
    placed = sorted_places(rows.select("key", "embedding").distinct())

    def chosen(frames):
        for f in frames:
            for key, n in zip(f["key"], f["all"]):
                at = seed_places(n, min(k, n), seed, rounds)
                yield pd.DataFrame({"key": key, "place": at, "nth": np.arange(len(at)), "k": min(k, n)})

    wanted = placed.groupBy("key").agg(F.max("all").alias("all")).mapInPandas(chosen, "key string, place long, nth int, k int")
    vectors = placed.join(wanted, ["key", "place"]).select("key", "k", F.struct("nth", F.transform("embedding", lambda x: x.cast("double")).alias("v")).alias("s"))
    pools = vectors.groupBy("key").agg(F.max("k").alias("k"), F.array_sort(F.array_agg("s")).alias("s")).withColumn("pool", F.col("s")["v"])
    now = pools.select("key", "k", "pool", F.slice("pool", 1, F.col("k")).alias("centres"), F.lit(False).alias("rests")).checkpoint()
    means = [F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(dim)]
    for turn in range(rounds):

        def moved(frames, turn=turn):
            for f in frames:
                out = f[["key", "k", "pool"]].copy()
                fresh = [renewed(np.stack(c), {m["cluster"]: np.asarray(m["m"]) for m in ms}, np.stack(p), turn, tol) for c, ms, p in zip(f["centres"], f["ms"], f["pool"])]
                out["centres"], out["rests"] = [[r.tolist() for r in c] for c, _ in fresh], [r for _, r in fresh]
                yield out

        moving = now.where("not rests")
        near = nearest_of_key(rows, moving, metric).groupBy("key", "cluster").agg(*means)
        got = near.groupBy("key").agg(F.array_agg(F.struct("cluster", F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("m"))).alias("ms"))
        now = moving.join(got, "key").mapInPandas(moved, state).unionByName(now.where("rests")).checkpoint()
        if now.where("not rests").isEmpty():
            break
    return nearest_of_key(rows, now, metric).select("key", "point", "cluster", F.round(F.sqrt(F.greatest("d", F.lit(0.0))), 6).alias("distance"))


def nearest_of_key(rows: DataFrame, now: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Every row with the nearest of its key's centres: the centres of a key travel as one row."""
    away = (lambda c: F.coalesce(vector.cosine_distance(F.col("embedding"), c), F.lit(1.0))) if metric == "cosine" else lambda c: vector.squared_distance(F.col("embedding"), c)
    best = F.array_min(F.transform("centres", lambda c, i: F.struct(away(c).alias("d"), i.alias("cluster"))))
    return rows.join(now.select("key", "centres"), "key").select("key", "point", "embedding", best.alias("b")).select("key", "point", "embedding", "b.cluster", "b.d")


def breadth_expansion(relevance_of, points: int, first: int = 8, most: int = 32, wanted: int = 4) -> int:
    """Number of clusters: doubled from ``first`` while fewer than ``wanted`` are highly relevant and both bounds allow it.

    ``relevance_of(k)`` gives the relevance (1 to 3) of the k clusters.
    """
    k = min(first, points)
    while sum(1 for r in relevance_of(k) if r == 3) < wanted and k < min(most, points):
        k = min(k * 2, most, points)
    return k


def breadth_levels(sizes: DataFrame, relevance: DataFrame, first: int = 8, most: int = 32, wanted: int = 4) -> DataFrame:
    """:func:`breadth_expansion` for every key of ``sizes`` (key, points): ``key, k``.

    ``relevance`` (key, k, relevance) has the relevance of each of the k clusters for the numbers k a key may try.
    """
    doubled = F.array(*[F.lit(first * 2**i) for i in range(max(0, (most - 1).bit_length() - (first - 1).bit_length()) + 1)])
    tried = F.array_distinct(F.transform(doubled, lambda x: F.least(x, F.lit(most), F.col("points").cast("int"))))
    steps = sizes.where("points > 0").select("key", F.explode(tried).alias("k"))
    high = relevance.groupBy("key", "k").agg(F.count_if(F.col("relevance") == 3).alias("high"))
    enough = F.min(F.when(F.coalesce("high", F.lit(0)) >= wanted, F.col("k")))
    return steps.join(high, ["key", "k"], "left").groupBy("key").agg(F.coalesce(enough, F.max("k")).alias("k"))


def ward(x: np.ndarray, parts: int) -> np.ndarray:
    """Labels of ``parts`` clusters by Ward's merging, numbered by first member.

    Chains of nearest neighbours give the merges of the greedy order in linear memory and quadratic time.
    """
    n = len(x)
    parts = max(1, min(parts, n))
    size, centre, ident = np.ones(n), x.astype(np.float64).copy(), np.arange(n)
    norm = (centre * centre).sum(1)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    links: list[float] = []
    while len(merges) < n - 1:
        if 2 * (n - len(merges)) < len(size) and len(size) > 64:
            keep = np.flatnonzero(size)
            new = np.full(len(size), -1)
            new[keep] = np.arange(len(keep))
            size, centre, norm, ident, chain = size[keep], centre[keep], norm[keep], ident[keep], new[chain].tolist() if chain else []
        if not chain:
            chain.append(int(np.flatnonzero(size)[0]))
        a = chain[-1]
        cost = np.where(size > 0, size[a] * size / (size[a] + size) * np.maximum(norm + norm[a] - 2 * (centre @ centre[a]), 0), np.inf)
        cost[a] = np.inf
        b = int(cost.argmin())
        if not links or cost[b] < links[-1]:  # links shorten, so a chain ends
            chain.append(b)
            links.append(float(cost[b]))
            continue
        i, j = sorted((chain.pop(), chain.pop()), key=ident.__getitem__)
        merges.append((links.pop(), int(ident[i]), int(ident[j])))
        del links[max(len(chain) - 1, 0) :]
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        norm[i] = centre[i] @ centre[i]
        size[i] += size[j]
        size[j] = 0
    top = list(range(n))

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - parts]:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return np.unique([root(k) for k in range(n)], return_inverse=True)[1]


def split_by_relevance(x: np.ndarray, relevance: int, parts: int = 4) -> list[tuple[int, int] | None]:
    """(sub, subsub) of every member: none for relevance 1, one level for 2, two for 3; -1 where there is no level.

    At relevance 3 the members of sub-clusters with less than two leave the tree: None.
    """
    n = len(x)
    if relevance <= 1 or n < 2:
        return [(-1, -1)] * n
    sub = ward(x, parts)
    if relevance == 2:
        return [(int(s), -1) for s in sub]
    deep = np.full(n, -1)
    for s in np.unique(sub):
        here = np.flatnonzero(sub == s)
        if len(here) >= 2:
            deep[here] = ward(x[here], parts)
    return [(int(s), int(z)) if z >= 0 else None for s, z in zip(sub, deep)]


def depth_expansion(assigned: DataFrame, vectors: DataFrame, relevance: str | None = None, parts: int = 4) -> DataFrame:
    """``key, point, cluster, sub, subsub``: each cluster split by its relevance (a column of ``assigned``, else 3).

    Members of dropped sub-clusters have no row.
    """
    rows = assigned.join(vectors, ["key", "point"]).withColumn("relevance", F.col(relevance) if relevance else F.lit(3))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point")
        x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        levels = split_by_relevance(x, int(frame["relevance"].iloc[0]), parts)
        kept = frame[[v is not None for v in levels]]
        levels = [v for v in levels if v is not None]
        return pd.DataFrame({"key": kept["key"], "point": kept["point"], "cluster": kept["cluster"], "sub": [a for a, _ in levels], "subsub": [b for _, b in levels]})

    return rows.groupBy("key", "cluster").applyInPandas(run, "key string, point long, cluster int, sub int, subsub int")


def representatives(points: DataFrame, dim: int = 64) -> DataFrame:
    """Member of each cluster closest to its mean by cosine, numbered in temporal order: place, point, cluster."""
    near = points.join(cluster_means(points, dim), "cluster").select("cluster", "point", F.round(vector.cosine_distance(F.col("embedding"), F.col("centre")), 6).alias("distance"))
    best = near.groupBy("cluster").agg(F.min(F.struct("distance", "point")).alias("b")).select(F.col("b.point").alias("point"), "cluster")
    return best.withColumn("place", F.row_number().over(W.orderBy("point"))).select("place", "point", "cluster")


def tree_representatives(tree: DataFrame, vectors: DataFrame, dim: int = 64, distinct: bool = False) -> DataFrame:
    """``key, place, point``: representatives of a tree (key, point, cluster, sub, subsub) in temporal order.

    Every cluster gives the member closest by cosine to its mean, every deepest group inside it one more; ``distinct``
    keeps a point once.
    """
    groups = F.array(
        F.struct(F.lit(-1).alias("sub"), F.lit(-1).alias("subsub")),
        F.when(F.col("sub") >= 0, F.struct(F.col("sub").cast("int").alias("sub"), F.col("subsub").cast("int").alias("subsub"))),
    )
    rows = tree.join(vectors, ["key", "point"]).select("key", "point", "embedding", "cluster", F.explode(F.array_compact(groups)).alias("g")).select("key", "point", "embedding", F.struct("key", "cluster", "g.sub", "g.subsub").alias("cluster"))
    near = rows.join(cluster_means(rows, dim), "cluster").select("cluster", "point", F.round(vector.cosine_distance(F.col("embedding"), F.col("centre")), 6).alias("distance"))
    best = near.groupBy("cluster").agg(F.min(F.struct(F.coalesce("distance", F.lit(2.0)).alias("distance"), "point")).alias("b")).select("cluster.key", F.col("b.point").alias("point"))
    best = best.distinct() if distinct else best
    return best.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("point"))).select("key", "place", "point")
