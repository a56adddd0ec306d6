import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import extension as E


def test_embedding_is_per_value_and_null_safe(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "k int, t string")
    for got in (E.embedded(df, "t", E.hashed_embedder(8), batch_size=2), E.embedded_once(df, "t", E.hashed_embedder(8))):
        by = {r.k: r.embedding for r in got.collect()}
        assert by[1] == by[3] != by[4] and by[2] is None and np.linalg.norm(by[1]) == pytest.approx(1.0, abs=1e-6)


def test_model_calls_retry_and_keep_errors(spark):
    def make():
        seen = {}

        def client(p):
            seen[p] = seen.get(p, 0) + 1
            if p == "flaky" and seen[p] < 3:
                raise RuntimeError("later")
            if p == "bad":
                raise E.NoRetry("bad request")
            return f"{p}:{seen[p]}"

        return client

    df = spark.createDataFrame([("ok",), ("flaky",), ("bad",)], "p string").coalesce(1)
    assert {r.p: (r.response, r.error) for r in E.model_calls(df, "p", make, wait=0.0).collect()} == {"ok": ("ok:1", None), "flaky": ("flaky:3", None), "bad": (None, "bad request")}


def test_small_helpers(spark):
    row = spark.range(1).select(
        E.search_errors(F.lit(""), F.lit("base")).alias("a"), E.search_errors(F.lit("q"), F.lit("x")).alias("b"), E.search_errors(F.lit("q"), F.lit("summary")).alias("c"),
        E.right_answer(F.lit(""), F.lit("")).alias("d"), E.right_answer(F.lit("x"), F.lit("x")).alias("e"), E.one_action(F.lit("a"), F.lit(None), F.lit(None)).alias("f"), E.one_action(F.lit("a"), F.lit("b"), F.lit(None)).alias("g"),
        E.single_line(F.lit(" a\n  b ")).alias("h"), E.stamped(F.lit("x/log.txt"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("i"), E.number_keys(E.text_keys(F.create_map(F.lit(1), F.lit("z")))).alias("j"),
    ).first()
    assert "query" in row.a and "mode" in row.b and row.c is None and (row.d, row.e, row.f, row.g) == (False, True, True, False)
    assert (row.h, row.i, row.j) == ("a b", "x/log_2024-01-02T03:04:05.txt", {1: "z"})
    assert E.find_column(spark.createDataFrame([(1,)], "Video_ID int"), ["vid", "video_id"]) == "Video_ID"
    with pytest.raises(KeyError):
        E.registered(E.REWARDS, "none")


def test_soft_dtw_nears_dtw(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 2.0, 3.0]), ([0.0], [3.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(E.soft_dtw_column("a", "b", 1e-3)).collect()]
    assert got[0] == pytest.approx(0.0, abs=1e-2) and got[1] == pytest.approx(9.0) and (got[2] is None or np.isnan(got[2]))


def test_payload_of_mined_videos(spark):
    rows = spark.createDataFrame([("d", "v", "Who  Is It?"), ("d", "v", "Other?"), ("d", "w", "Any?"), ("d", "x", "No?")], "data_source string, video_id string, question string")
    mined = spark.createDataFrame([("d", "v", ["who is it?"], 6, 2), ("d", "w", [], 7, 1)], "data_source string, video_id string, questions array<string>, max_turn int, correct_count int")
    assert sorted((r.video_id, r.question, r.selection_meta.max_turn) for r in E.selected_payload(rows, mined).collect()) == [("v", "Who  Is It?", 6), ("w", "Any?", 7)]
