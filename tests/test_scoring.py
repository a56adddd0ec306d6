import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from framewise.functions import scoring as S
from framewise.operators import answers as A


def test_pass_at_k_is_the_share_of_draws_with_a_right_one(spark):
    cases = [(n, c, k) for n in range(0, 7) for c in range(0, n + 1) for k in range(0, 6)]
    got = spark.createDataFrame(cases, "n long, c long, k long").select("n", "c", "k", S.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).collect()
    for r in got:
        draws = list(combinations(range(r.n), r.k)) if 0 < r.k <= r.n else []
        want = sum(any(i < r.c for i in x) for x in draws) / len(draws) if draws else 0.0
        assert r.p == pytest.approx(want)


def test_rewards(spark):
    many = "<answer>a</answer>" * 11
    rows = [("<answer>The Cat</answer>", ["cat"], [{"p": 0.1, "q": 0.2}, {"p": 0.15, "summary": 0.2}]), (many, ["a", "b"], []), ("none", ["a"], [{"p": 1.0}]), ("<answer>x</answer>", ["a"], [None]), (None, ["a"], [])]
    df = spark.createDataFrame(rows, "s string, g array<string>, r array<map<string,double>>")
    got = df.select(S.compute_score(F.col("s"), F.col("g")).alias("em"), S.compute_score(F.col("s"), F.col("g"), F.col("r"), "puls").alias("puls"), S.compute_score(F.col("s"), F.col("g"), F.col("r"), "puls", num_examine=1).alias("forced")).collect()
    assert [r.em for r in got] == [1.0, 0.25, 0.0, 0.0, 0.0]
    assert got[0].puls == pytest.approx((0.5 * (1.0 + 0.5) / 3 + 1.0) / 1.5)
    assert [r.puls for r in got][2:] == [0.0, 0.0, 0.0]
    assert [r.forced for r in got] == [r.em for r in got]
    with pytest.raises(ValueError):
        S.compute_score(F.col("s"), F.col("g"), reward_type="other")


def test_many_tags_quarter_the_reward(spark):
    df = spark.createDataFrame([("<answer>b</answer>" * 11, ["b"]), ("<answer>b</answer>" * 10, ["b"])], "s string, g array<string>")
    assert [r[0] for r in df.select(S.compute_score(F.col("s"), F.col("g"))).collect()] == [0.25, 1.0]


def test_calibration_meets_its_points(spark):
    got = [r[0] for r in spark.createDataFrame([(0.1,), (0.4,), (0.95,), (1.0,), (0.4001,), (0.9499,)], "c double").select(S.calibrate(F.col("c"))).collect()]
    assert got[:4] == [0.01, 0.01, 0.99, 0.99] and got[4] == pytest.approx(0.01, abs=1e-3) and got[5] == pytest.approx(0.99, abs=1e-3)


def test_yes_probability(spark):
    df = spark.createDataFrame([(math.log(0.3), math.log(0.1)), (math.log(0.5), None)], "y double, n double")
    assert [r[0] for r in df.select(S.yes_probability(F.col("y"), F.col("n"))).collect()] == [0.75, 1.0]
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([(None, None)], "y double, n double").select(S.yes_probability(F.col("y"), F.col("n"))).collect()


def test_spans(spark):
    rows = [(0.0, 10.0, 0.0, 10.0), (0.0, 10.0, 5.0, 5.0), (0.0, 10.0, 11.0, 11.0), (0.0, 4.0, 6.0, 8.0), (0.0, 10.0, 5.0, 15.0)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(S.span_overlap(*[F.col(x) for x in "abcd"])).collect()]
    assert got == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (-0.25, -1.0), (pytest.approx(1 / 3), 0.5)]


def test_votes_ties_nulls_and_partitions(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "", 1), (2, None, 2), (3, "", 1), (3, "", 2), (3, "c", 3)]
    df = spark.createDataFrame(rows, "q int, v string, pos int")
    for parts in (1, 8):
        got = {r.q: (r.vote, r.votes) for r in A.majority_vote(df.repartition(parts), ["q"], "v", "pos").collect()}
        assert got == {1: ("b", 2), 2: ("", 0), 3: ("c", 1)}


def test_question_table_null_truth_is_never_right(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, "a", None), (2, 1, "", "b"), (2, 2, "b", "b")], "qid int, pass_idx int, parsed string, gt string")
    got = {r.qid: (r.n, r.c, r.vote, r.vote_right) for r in A.question_table(df, ["qid"]).collect()}
    assert got == {1: (2, 0, "a", False), 2: (2, 1, "b", True)}


def test_best_of_n_modes(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (1, 3, False), (2, 0, False), (3, 0, True)], "q int, pos int, ok boolean")
    assert sorted((r.q, r.pos) for r in A.best_of_n(df, "q", "pos", "ok").collect()) == [(1, 1), (3, 0)]
    assert sorted((r.q, r.pos, r["rank"]) for r in A.best_of_n(df, "q", "pos", "ok", "all_correct").collect()) == [(1, 1, 1), (1, 2, 2), (3, 0, 1)]
    assert [tuple(r) for r in A.best_of_n(df, "q", "pos", "ok", "best_and_worst").collect()] == [(1, 1, 3)]
    with pytest.raises(ValueError):
        A.best_of_n(df, "q", "pos", "ok", "x")


def test_judge_records(spark):
    df = spark.createDataFrame([("2", "2", "2", "odd", "true"), ("2", "1", "0", None, None), ("x", "0", "1", " Correct ", "true")], "inclusion string, temporal_alignment string, operator_correctness string, verdict string, needs_revision string")
    got = [tuple(r[0]) for r in df.select(S.judge_record(F.struct("*"))).collect()]
    assert got == [(2, 2, 2, 6, "correct", False), (2, 1, 0, 3, "partially_correct", True), (0, 0, 1, 1, "correct", False)]
