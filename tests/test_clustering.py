import numpy as np
import pytest

from framewise.operators import clustering as C


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 64)) * 10
    return np.concatenate([c + rng.normal(size=(20, 64)) * 0.1 for c in centres])


def groups(labels):
    return {frozenset(np.flatnonzero(np.asarray(labels) == c)) for c in set(labels)}


def test_kmeans_and_ward_find_blobs(blobs):
    want = {frozenset(range(a, a + 20)) for a in (0, 20, 40)}
    assert any(groups(C.kmeans(blobs, 3, seed=s)[0].tolist()) == want for s in range(5))
    assert groups(C.ward(blobs, 3).tolist()) == want
    assert groups(C.ward(blobs[:1], 4).tolist()) == {frozenset([0])}


def test_fewer_points_than_clusters():
    x = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]])
    labels, centres = C.kmeans(x, 8)
    assert len(centres) == 2 and labels[0] == labels[1] != labels[2]


def test_breadth_and_depth():
    assert C.breadth_expansion(lambda k: [3] * min(k // 8, k), 100) == 32
    assert C.breadth_expansion(lambda k: [3] * k, 100) == 8
    assert C.breadth_expansion(lambda k: [1] * k, 10) == 10
    x = np.arange(8.0).reshape(-1, 1)
    assert C.split_by_relevance(x, 1) == [(-1, -1)] * 8
    assert all(b == -1 for _, b in C.split_by_relevance(x, 2)) and len({a for a, _ in C.split_by_relevance(x, 2)}) == 4
    assert len(set(C.split_by_relevance(x, 3))) == 8
    lone = np.array([[0.0], [0.1], [5.0], [5.1], [9.0], [20.0], [20.1]])
    assert [v is None for v in C.split_by_relevance(lone, 3)] == [False] * 4 + [True] + [False] * 2


def test_large_keys_are_clustered_without_grouping_them(spark, blobs, monkeypatch, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(C, "MOST_POINTS", 30)
    rows = [("big", k, [float(v) for v in x]) for k, x in enumerate(blobs)] + [("small", k, [float(v) for v in x]) for k, x in enumerate(blobs[:25])]
    df = spark.createDataFrame(rows, "key string, point long, embedding array<float>")
    got = C.kmeans_per_key(df, 3).collect()
    big = sorted((r.point, r.cluster) for r in got if r.key == "big")
    assert len(big) == 60 and sum(r.key == "small" for r in got) == 25
    assert all(len({c for p, c in big if a <= p < a + 20}) == 1 for a in (0, 20, 40))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_large_keys_follow_the_rules_of_small_ones(spark, monkeypatch, tmp_path, metric):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(15, 64)), 4, axis=0)
    df = spark.createDataFrame([("v", k, [float(v) for v in r]) for k, r in enumerate(x)], "key string, point long, embedding array<float>")
    rows = lambda: sorted((r.point, r.cluster, round(r.distance, 4)) for r in C.kmeans_per_key(df, 5, metric, seed=2).collect())
    small = rows()
    monkeypatch.setattr(C, "MOST_POINTS", 30)
    assert rows() == small and len({c for _, c, _ in small}) == 5


def test_an_empty_cluster_is_filled_from_the_pool():
    pool = np.arange(6.0).reshape(-1, 1)
    new, rests = C.renewed(pool[:2], {0: np.array([0.5])}, pool, 0, 1e-4)
    assert new.tolist() == [[0.5], [3.0]] and not rests


def test_ward_merges_members_at_every_size(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(n, 4)) * 0.1 + at for n, at in ((2400, 0), (60, 3), (30, 6), (10, 9))])
    df = spark.createDataFrame([("v", k, [float(v) for v in r]) for k, r in enumerate(x)], "key string, point long, embedding array<double>")
    assigned = df.selectExpr("key", "point", "0 cluster", "2 relevance")
    got = C.depth_expansion(assigned, df, "relevance").orderBy("point").collect()
    want = C.ward(x, 4)
    assert [r["sub"] for r in got] == want.tolist()
    small = x[::25]
    held = {k: [k] for k in range(len(small))}
    cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((small[a].mean(0) - small[b].mean(0)) ** 2).sum()
    while len(held) > 4:
        i, j = min(((a, b) for a in held for b in held if a < b), key=lambda p: cost(held[p[0]], held[p[1]]))
        held[i] += held.pop(j)
    assert groups(C.ward(small, 4).tolist()) == {frozenset(v) for v in held.values()}


def test_breadth_levels_follow_the_loop(spark):
    import random

    rng = random.Random(3)
    sizes = [(k, rng.choice([1, 5, 8, 9, 20, 31, 32, 100])) for k in range(40)]
    rows, want = [], {}
    for key, points in sizes:
        given = {k: [rng.choice([1, 2, 3, 1, 1]) for _ in range(k)] for k in {min(x, points) for x in (8, 16, 32)}}
        rows += [(key, k, r) for k, rs in given.items() for r in rs]
        want[key] = C.breadth_expansion(given.__getitem__, points)
    got = C.breadth_levels(spark.createDataFrame(sizes, "key int, points long"), spark.createDataFrame(rows, "key int, k int, relevance int"))
    assert {r.key: r.k for r in got.collect()} == want


def test_representatives_of_a_tree(spark):
    unit = lambda a: [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62
    rows = [("v", 1, 0, -1, -1, 0.0), ("v", 2, 0, -1, -1, 0.1), ("v", 3, 0, -1, -1, 0.25), ("v", 4, 1, 0, 0, 1.0), ("v", 5, 1, 0, 1, 1.3), ("v", 6, 1, 1, -1, 1.6), ("w", 9, 0, -1, -1, 0.0)]
    df = spark.createDataFrame([(k, p, c, s, z, unit(a)) for k, p, c, s, z, a in rows], "key string, point long, cluster int, sub int, subsub int, embedding array<double>")
    found = lambda d: [(r.key, r.place, r.point) for r in C.tree_representatives(df.drop("embedding"), df.select("key", "point", "embedding"), distinct=d).orderBy("key", "place").collect()]
    assert found(False) == [("v", 1, 2), ("v", 2, 4), ("v", 3, 5), ("v", 4, 5), ("v", 5, 6), ("w", 1, 9)]
    assert found(True) == [("v", 1, 2), ("v", 2, 4), ("v", 3, 5), ("v", 4, 6), ("w", 1, 9)]
