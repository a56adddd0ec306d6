import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewise.llm import neighbours


def brute(ids, matrix, k, least):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sim, -9)
    pairs = set()
    for r in range(len(ids)):
        near = np.flatnonzero(sim[r] >= least)
        for j in near[np.lexsort((ids[near], -sim[r, near]))][:k]:
            pairs.add((int(min(ids[r], ids[j])), int(max(ids[r], ids[j]))))
    return pairs


def collection(seed=2, clusters=60, size=5, noise=300, dim=64):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=(noise, dim))]
    for _ in range(clusters):
        centre = rng.normal(size=dim)
        rows.append(centre + rng.normal(size=(size, dim)) * rng.uniform(0.05, 0.3))
    copies = np.repeat(rng.normal(size=(1, dim)), 12, axis=0)
    return np.round(np.concatenate([*rows, copies]) * 64) / 64


def frame(spark, ids, matrix, extra=()):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)] + list(extra), "vec_id long, embedding array<float>")


def test_recall_and_copies_against_brute_force(spark):
    matrix = collection()
    ids = np.random.default_rng(9).permutation(len(matrix)) * 3 + 1
    bad = [(100_000, None), (100_001, [1.0, 2.0]), (100_002, [float("nan")] * 64), (100_003, [0.0] * 64)]
    got = {(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(frame(spark, ids, matrix, bad)).collect()}
    want = brute(ids, matrix, 5, 0.93)
    assert got <= want
    assert len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("least, dim", [(0.7, 64), (0.93, 32), (0.93, 256), (0.98, 64)])
def test_recall_at_other_similarities_and_lengths(spark, least, dim):
    matrix = collection(seed=6, dim=dim)
    ids = np.arange(len(matrix)) * 2
    want = brute(ids, matrix, 5, least)
    got = {(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(frame(spark, ids, matrix), 5, least, dim).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 0


def test_exact_way_finds_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "EXACT_ROWS", 150)
    matrix = collection(seed=7)
    ids = np.random.default_rng(1).permutation(len(matrix))
    for least in (0.3, 0.93):
        got = {(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(frame(spark, ids, matrix), 3, least, exact=True).collect()}
        assert got == brute(ids, matrix, 3, least)


def test_dense_groups_are_compared_without_all_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    dense = rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.02
    matrix = np.concatenate([dense, collection(seed=8)])
    ids = rng.permutation(len(matrix))
    monkeypatch.setattr(neighbours, "EXACT_ROWS", 100)
    want = brute(ids, matrix, 5, 0.93)
    pairs = list(neighbours.close_pairs(np.arange(400), np.zeros((400, 2), dtype=np.uint64), np.zeros(400, dtype=np.int64), 10, np.ones(400, dtype=bool), np.full(400, 2), neighbours.plan_search(1000, 0.93)))
    assert sum(len(u) for u, _ in pairs) == 400 * 399 // 2
    monkeypatch.setattr(neighbours, "CROWD", 30)
    pairs = list(neighbours.close_pairs(np.arange(400), np.zeros((400, 2), dtype=np.uint64), np.zeros(400, dtype=np.int64), 10, np.ones(400, dtype=bool), np.full(400, 2), neighbours.plan_search(1000, 0.93)))
    assert [(u == v).all() and len(u) == 400 for u, v in pairs] == [True]
    assert {(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(frame(spark, ids, matrix)).collect()} == want


def test_search_follows_from_the_similarity():
    plans = {s: neighbours.plan_search(700_000, s) for s in (0.9, 0.93, 0.98)}
    assert plans[0.93].tables == 5 and plans[0.9].tables > 5 and plans[0.98].near < plans[0.93].near < plans[0.9].near
    with pytest.raises(ValueError):
        neighbours.plan_search(1 << 28, 0.5)
    for bits, tables in ((20, 5), (20, 33), (13, 20)):
        places = neighbours.substring_bits(bits, tables)
        assert len(places) == tables and all(len(set(p.tolist())) == bits for p in places)


def test_blocks_find_what_one_table_finds(spark, monkeypatch):
    matrix = collection(seed=4)
    ids = np.arange(len(matrix))
    whole = {(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(frame(spark, ids, matrix)).collect()}
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    assert {(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(frame(spark, ids, matrix)).collect()} == whole


def test_a_vector_goes_to_one_block_of_each_table(spark, monkeypatch):
    def sent(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("task").cast("int64")], names=["u", "v"])

    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "block_search", lambda *_: sent)
    search = neighbours.plan_search(4096, 0.98)
    codes = spark.range(4096).select(F.col("id").alias("vec_id"), F.xxhash64("id").alias("c1"), F.xxhash64("id", F.lit(1)).alias("c2"))
    assert (search.block_bits, search.tables) == (6, 5)
    assert neighbours.candidate_pairs(codes, search).count() == 4096 * 5


def test_copies_beyond_the_listed_ones(spark):
    matrix = np.concatenate([np.repeat(np.random.default_rng(3).normal(size=(2, 64)), [20, 7], axis=0), collection(seed=5)])
    ids = np.random.default_rng(4).permutation(len(matrix))
    got = [(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(frame(spark, ids, matrix.astype(np.float32))).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ids, matrix.astype(np.float32).astype(float), 5, 0.93)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.similar_pairs(empty).collect() == []
    assert neighbours.similar_pairs(frame(spark, [1], np.ones((1, 64)))).collect() == []
