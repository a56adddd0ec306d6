import pytest
from pyspark.sql import functions as F

from framewise.operators import dataset as D


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "key")


@pytest.mark.parametrize("n, ratio", [(0, 0.5), (1, 0.9), (10, 0.75), (333, 0.9)])
def test_split_sizes_are_exact_and_repeatable(spark, n, ratio):
    one = {r.key: r.split for r in D.train_test_split(ids(spark, n), "key", ratio).collect()}
    two = {r.key: r.split for r in D.train_test_split(ids(spark, n).repartition(7), "key", ratio).collect()}
    assert one == two and len(one) == n and sum(s == "train" for s in one.values()) == int(n * ratio)


def test_shards_cover_everything_once(spark):
    placed = D.ranked(ids(spark, 23), [D.shuffle_key(F.col("key"), 1), F.col("key")])
    assert sorted(r.place for r in placed.collect()) == list(range(23))
    parts = [[r.key for r in D.contiguous_shard(placed, 23, k, 4).collect()] for k in range(4)]
    assert [len(p) for p in parts] == [6, 6, 6, 5] and sorted(sum(parts, [])) == list(range(23))


def test_merging_and_duplicates(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 5)], "k int, b int")
    assert sorted(tuple(r) for r in D.merged([a, b]).collect()) == [(1, "x", None), (2, None, 5)]
    with pytest.raises(ValueError, match="duplicate"):
        D.merged_shards([a, a], ["k"])


def test_keep_first_overlay_and_members(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k int, pos int, v string")
    assert sorted(r.v for r in D.keep_first(df, ["k"], ["pos"]).collect()) == ["a", "c"]
    new = spark.createDataFrame([(2, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in D.overlay(df, new, "k", ["v"]).collect()) == [(1, "a"), (1, "b"), (2, None)]
    wanted = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sorted(r.v for r in D.members(df, wanted, ["k"], "v").collect()) == ["a", "c"]


def test_fuzzy_and_substring_matches(spark):
    wanted = spark.createDataFrame([("clip one",), ("b-2",), ("zz",)], "key string")
    files = spark.createDataFrame([("Clip_One",), ("x_b2_y",), ("a_b2",)], "name string")
    got = sorted((r.key, r.name, r.exact) for r in D.fuzzy_match(wanted, files, "key", "name").collect())
    assert got == [("b-2", "a_b2", False), ("clip one", "Clip_One", True)]


def test_substring_join_goes_on_beyond_the_broadcast(spark):
    big = spark.createDataFrame([(1, "abcab"), (2, "xyz"), (3, ""), (4, None)], "i int, text string")
    small = spark.createDataFrame([("ab",), ("z",), ("",), ("片",), (None,)], "part string")
    rows = lambda most: sorted((r.i, r.part) for r in D.substring_join(big, "text", small, "part", most).collect())
    assert rows(10) == rows(2) == [(1, ""), (1, "ab"), (2, ""), (2, "z"), (3, "")]


def test_positions_are_global_whatever_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 7)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"), F.format_string("f%d", F.col("id") % 3).alias("file"))
    assert [r["index"] for r in D.running_offset(df, None, "n").orderBy("n").collect()] == list(range(1000))
    assert [r["index"] for r in D.running_offset(df, "file", "n").orderBy("file", "n").collect()] == list(range(1000))
    placed = D.ranked(df, [D.shuffle_key(F.col("n"), 1), F.col("n")], parts=40).withColumn("h", D.shuffle_key(F.col("n"), 1))
    assert [r.place for r in placed.orderBy("h", "n").collect()] == list(range(1000))
    cut = placed.withColumn("shard", D.shard_of(F.col("place"), F.lit(1000), 7)).groupBy("shard").agg(F.count("*").alias("n"), F.min("place").alias("a")).orderBy("shard").collect()
    assert [r.n for r in cut] == [143] * 6 + [142] and cut[-1].a == 858
    assert D.contiguous_shard(placed, 1000, 6, 7).count() == 142


def test_fuzzy_match_takes_any_number_of_keys(spark):
    n = 10_500
    wanted = spark.range(n).select(F.format_string("v%06d", "id").alias("key")).unionByName(spark.createDataFrame([("",), ("片",), ("V-7",)], "key string"))
    files = spark.range(n + 5).select(F.format_string("videos/a%d/v%06d.mp4", F.col("id") % 3, "id").alias("name"))
    got = {r.key: (r.name, r.exact) for r in D.fuzzy_match(wanted, files, "key", "name").collect()}
    assert {k: v for k, v in got.items() if len(k) == 7} == {f"v{i:06d}": (f"videos/a{i % 3}/v{i:06d}.mp4", False) for i in range(n)}
    assert {k: v for k, v in got.items() if len(k) < 7} == {"": ("videos/a0/v000000.mp4", False), "片": ("videos/a0/v000000.mp4", False)}


def test_repaired_rows_cast_nested_ids(spark):
    schema = "extra_info struct<correct_choice:int,metadata:struct<video_id:int,id:string>,tools_kwargs:struct<video_search:struct<execute_kwargs:struct<topk:int,video_id:int>>>>"
    df = spark.createDataFrame([({"correct_choice": 1, "metadata": {"video_id": 7, "id": "x"}, "tools_kwargs": {"video_search": {"execute_kwargs": {"topk": 4, "video_id": 7}}}},)], schema)
    e = D.repaired_rows(df).first().extra_info
    assert (e.correct_choice, e.metadata.video_id, e.metadata.id, e.tools_kwargs.video_search.execute_kwargs.video_id, e.tools_kwargs.video_search.execute_kwargs.topk) == ("1", "7", "x", "7", 4)


def test_padding(spark):
    row = spark.range(1).select(D.padded(F.array(F.lit("a"))).alias("a"), D.padded(F.array(*[F.lit(str(i)) for i in range(7)])).alias("b"), D.padded(F.array(*[F.lit(str(i)) for i in range(7)]), cut=False).alias("c")).first()
    assert row.a == ["a", "", "", "", ""] and row.b == list("01234") and len(row.c) == 7


def test_members_by_key_and_question(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (3, "d", 4), (1, None, 5)], "k int, q string, id int")
    wanted = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (1, None)], "k int, q string")
    assert sorted(r.id for r in D.members(df, wanted, ["k"], "q").collect()) == [1, 3]
    assert sorted(r.id for r in D.members(df, wanted, ["k"]).collect()) == [1, 2, 3, 5]
