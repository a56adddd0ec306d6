"""Rules of answers with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from framewise.operators import answers as A


def test_report_at_the_configured_number_of_passes(spark):
    q = spark.createDataFrame([(1, 3), (4, 0), (2, 1), (4, 4)], "n long, c long")
    got = {r.k: (r.pass_at_k, r.questions) for r in A.pass_at_k_report(q, 6).collect()}
    # 6 passes: c = 3 -> 1/2, 4/5, 1, 1, 1; c = 1 -> 1/6, 1/3, 2/3, 5/6, 1; c = 4 -> 2/3, 14/15, 1, 1, 1
    assert set(got) == {1, 2, 4, 5, 6}
    assert got[1] == (pytest.approx((1 / 2 + 1 / 6 + 2 / 3) / 4), 4)
    assert got[2][0] == pytest.approx((4 / 5 + 1 / 3 + 14 / 15) / 4)
    assert got[4][0] == pytest.approx((1 + 2 / 3 + 1) / 4) and got[6][0] == pytest.approx(3 / 4)
    assert [(r.k, r.pass_at_k, r.questions) for r in A.pass_at_k_report(q.limit(0), 1).collect()] == [(1, None, 0)]
    counted = {r.k: (r.pass_at_k, r.questions) for r in A.pass_at_k_report(q).collect()}
    assert counted == {1: (pytest.approx((1 + 0 + 1 / 2 + 1) / 4), 4), 2: (pytest.approx((1 + 1 + 0) / 3), 3), 4: (pytest.approx(0.5), 2)}


def test_capped_table_counts_the_questions_of_each_k(spark):
    rows = [(1, i, "A", "A" if i < 3 else "B") for i in range(1, 7)] + [(2, 1, "B", "A"), (2, 2, "A", "A"), (3, 1, "A", "A")]
    p = spark.createDataFrame([(q, i, x, g, "m") for q, i, x, g in rows], "qid int, pass_idx int, parsed string, gt string, method string")
    got = {r.k: (r.pass_at_k, r.average_4, r.num_samples) for r in A.capped_pass_table(p, ["method"]).collect()}
    # Right among the first four: 2 of 4, 1 of 2, 1 of 1.
    assert got == {1: (pytest.approx((1 / 2 + 1 / 2 + 1) / 3), pytest.approx(1 / 3), 3), 2: (pytest.approx((5 / 6 + 1) / 2), pytest.approx(1 / 3), 2), 4: (pytest.approx(1.0), pytest.approx(1 / 3), 1)}


def test_pivot_has_all_labels(spark):
    df = spark.createDataFrame([("b", "x", 1.0), ("b", "x", 0.0), ("b", "y", 1.0)], "r string, m string, v double")
    out = A.pivoted(df, "r", "m", ["x", "y", "z"], {"mean": lambda hit: F.avg(F.when(hit, F.col("v"))), "n": F.count_if}, ["a", "b"], {"n": 0})
    assert sorted(map(tuple, out.collect())) == [("a", None, None, None, 0, 0, 0), ("b", 0.5, 1.0, None, 2, 1, 0)]


def test_error_kinds(spark):
    rows = [("", "A", False), ("a b", "A", False), ("A", "A", False), (None, "A", None), ("B", "A", True), ("C", None, False)]
    df = spark.createDataFrame(rows, "p string, t string, r boolean")
    got = {r.kind: (r.n, r.percent) for r in A.error_taxonomy(df, F.col("p"), F.col("t"), F.col("r")).collect()}
    assert got == {"no_answer_extracted": (1, 20.0), "wrong_answer": (3, 60.0), "other": (1, 20.0)}


def test_caseless_accuracy_leaves_out_failures_and_missing_truths(spark):
    df = spark.createDataFrame([("a", "A", False), ("", "B", None), (None, "C", False), ("d", "D", True), ("e", None, False), ("f", "", False)], "vote string, gt string, bad boolean")
    assert tuple(A.caseless_accuracy(df, failed=F.col("bad")).first()) == (1, 3, pytest.approx(1 / 3))


def test_revisions(spark):
    part = "struct<proposition:array<string>,specification:string>"
    rows = [((["a"], "x"), True, (["b"], "y"), 1, 2), ((["a"], "x"), True, ([" "], "y"), 1, 2), ((["a"], "x"), False, (["b"], "y"), 1, 2), ((["a"], "x"), None, None, 1, 2), ((["a"], "x"), True, (["b"], "y"), 2, 2), ((["a"], "x"), True, None, 1, 2)]
    df = spark.createDataFrame(rows, f"f {part}, n boolean, c {part}, s int, t int")
    one = df.select(A.revised(F.col("f"), F.col("n"), F.col("c")).alias("o")).select("o.*").collect()
    assert [(r.kept.specification, r.revised, r.error) for r in one] == [("y", True, None), ("x", False, "invalid revision"), ("x", False, None), ("x", False, None), ("y", True, None), ("x", False, "invalid revision")]
    two = df.select(A.revised(F.col("f"), F.col("n"), F.col("c"), F.col("s"), F.col("t")).alias("o")).select("o.*").collect()
    assert [r.revised for r in two] == [True, False, False, False, False, False]


def test_a_run_repeated_for_an_item(spark):
    df = spark.createDataFrame([("u", 1, 2, 3), ("u", 1, 2, 3), ("u", 2, 3, 3)], "uid string, run int, pred int, truth int")
    r = A.any_right_runs(df, 3).first()
    assert (r.preds, r.valid, r.right, r.pred) == ([2, 3, -1], [1, 2], [2], 3)
