import random

import pytest

from framewise.llm import topn


def test_matches_sorting_with_ties_repeats_and_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 3.0, None, float("nan")]), k, "c") for k in range(3000)] + [("one", 5.0, 7, "c"), ("one", 5.0, 7, "c")]
    df = spark.createDataFrame(rows, "g string, s double, id long, `order` string").repartition(7)
    got = sorted((r.g, -r.s, r.id) for r in topn.top_n_per_group(df, ["g"], "s", "id", 3).collect())
    want = []
    for g in ("hot", "a", "b", "one"):
        want += sorted((g, -s, i) for x, s, i, _ in rows if x == g and s is not None and s == s)[:3]
    assert got == sorted(want)


def test_string_ids_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0, "y"), ("a", 1.0, "x")], "g string, s double, id string")
    assert [r.id for r in topn.top_n_per_group(df, ["g"], "s", "id", 1).collect()] == ["x"]
    assert topn.top_n_per_group(df.limit(0), ["g"], "s", "id", 1).collect() == []
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["g"], "s", "id", 0)


def test_bad_embeddings_have_no_score(spark):
    rows = [(1, "v", [1.0, 0.0]), (2, "v", [0.0, 0.0]), (3, "v", None), (4, "v", [1.0]), (5, "v", [float("nan"), 1.0]), (6, None, [9.0, 9.0]), (7, "v", [1.0, 0.0]), (8, "v", [None, 1.0])]
    windows = spark.createDataFrame(rows, "vec_id long, video_id string, embedding array<float>")
    probes = spark.createDataFrame([(1, "p", [1.0, 1.0]), (2, "q", None)], "probe_id int, proposition string, embedding array<float>")
    got = [tuple(r) for r in topn.best_windows(windows, probes, 4).orderBy("vec_id").collect()]
    assert got == [(1, "v", 1, 1.0), (1, "v", 2, 0.0), (1, "v", 7, 1.0)]
    assert topn.best_windows(windows.limit(0), probes, 4).collect() == []
    assert topn.best_windows(windows, probes.limit(0), 4).collect() == []
