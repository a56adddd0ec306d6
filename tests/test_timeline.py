from pyspark.sql import functions as F

from framewise.functions import timeline as T
from framewise.operators import retrieval as R
from framewise.sources.srt import parse_srt


def test_windows_and_samples(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 8, 9, 17, 100)], "n int")
    rows = df.select("n", T.window_count(F.col("n")).alias("w"), T.window_frames(F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / 8).cast("int"), 8, F.col("n")).alias("f"), T.uniform_sample(F.col("n"), 4).alias("s"), T.uniform_sample(F.col("n"), 4, "round").alias("r"), T.uniform_sample(F.col("n"), 4, "stride").alias("t"), T.step_sample(F.col("n")).alias("p")).collect()
    assert [r.w for r in rows] == [0, 1, 1, 2, 3, 13]
    assert [r.f for r in rows] == [[], [0], list(range(8)), [8], [16], [96, 97, 98, 99]]
    assert [r.s for r in rows] == [[], [0], [0, 2, 4, 7], [0, 2, 5, 8], [0, 5, 10, 16], [0, 33, 66, 99]]
    assert rows[3].r == [0, 3, 5, 8] and rows[3].t == [0, 2, 4, 6] and rows[1].p == [0] and len(rows[5].p) == 8


def test_ranges_expand_back(spark):
    values = [1, 2, 3, 7, 9, 10, 10, None]
    got = R.islands(spark.createDataFrame([("a", v) for v in values] + [("b", 5)], "k string, v int"), "k", "v").collect()
    spans = sorted((r.k, r.start, r.end) for r in got)
    assert spans == [("a", 1, 4), ("a", 7, 8), ("a", 9, 11), ("b", 5, 6)]
    assert sorted({x for k, s, e in spans if k == "a" for x in range(s, e)}) == [1, 2, 3, 7, 9, 10]


def test_cues_onto_frames(spark):
    rows = [("v", 0.5, 2.0, "a"), ("v", -3.0, 0.2, "b"), ("v", 8.0, 99.0, "c"), ("v", 8.0, 99.0, "c"), ("v", 50.0, 60.0, "d")]
    cues = spark.createDataFrame(rows, "video_id string, start double, end double, text string").withColumns({"fps": F.lit(1.0), "step": F.lit(1), "total": F.lit(10)})
    got = sorted((r.text, r.frame_idx) for r in R.cue_frames(cues).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 8), ("c", 9)]


def test_srt_blocks(spark):
    text = "1\r\n00:00:01,500 --> 00:00:02.250\r\n<font color=\"x\">Hi</font>\r\nyou\r\n\r\n2\n00:00:03,000 --> 00:00:04,000\n\n3\nno arrow\ntext\n\n4\nxx --> 00:00:01,000\nbad\n\n\n5\n01:00:00,000 --> 01:00:01,000\nEnd"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = [tuple(r) for r in parse_srt(df, ["id"], "t").orderBy("id", "cue").collect()]
    assert [(g[0], g[2], g[3], g[4]) for g in got] == [(1, 1.5, 2.25, "Hi you"), (1, 3600.0, 3601.0, "End")]


def test_times(spark):
    df = spark.createDataFrame([("60",), ("1:02:03.5",), ("soon",), (None,), (" 7.5 ",)], "s string")
    assert [r[0] for r in df.select(T.any_seconds(F.col("s"))).collect()] == [60.0, 3723.5, None, None, 7.5]
    buckets = spark.createDataFrame([(x,) for x in (0.0, 59.9, 60.0, 600.0, 3600.0, None, -1.0)], "x double").select(T.length_bucket(F.col("x"))).collect()
    assert [r[0] for r in buckets][:5] == ["0-1min", "0-1min", "1-10min", "10-60min", "60min+"] and buckets[5][0] is None


def test_repaired_cues(spark):
    rows = [(1.0, 1.2, 10.0), (0.1, 0.2, 10.0), (-5.0, -3.0, 10.0), (11.0, 12.0, 10.0), (9.0, 30.0, 10.0)]
    got = [r[0] and tuple(round(x, 3) for x in r[0]) for r in spark.createDataFrame(rows, "a double, b double, d double").select(T.repaired_cue(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert got == [(0.6, 1.6), (0.0, 0.65), None, None, (9.0, 10.0)]


def test_subtitle_search_keeps_the_overshoot(spark):
    subs = spark.createDataFrame([("v", 1, [0, 8], [1.0] + [0.0] * 63), ("v", 2, [8, 16, 24], [0.9, 0.1] + [0.0] * 62), ("v", 3, [80], [0.0, 1.0] + [0.0] * 62), ("w", 4, [0], [1.0] + [0.0] * 63)], "video_id string, item long, windows array<int>, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0] + [0.0] * 63)], "query_id int, query_embedding array<float>")
    got = sorted((r.video_id, r.window) for r in R.top_subtitles(subs, queries, 3).collect())
    assert got == [("v", 0), ("v", 1), ("v", 2), ("v", 3), ("w", 0)]


def test_top_windows_ties_and_bad_vectors(spark):
    e = lambda *x: [*x] + [0.0] * (64 - len(x))
    rows = [("v", 2, e(1.0)), ("v", 1, e(2.0)), ("v", 3, e(0.0)), ("v", 4, None), ("v", 5, [1.0]), ("v", 6, e(float("nan"))), (None, 7, e(1.0)), ("w", 8, e(0.0, 1.0))]
    windows = spark.createDataFrame(rows, "video_id string, item long, embedding array<float>")
    queries = spark.createDataFrame([(1, e(1.0))], "query_id int, query_embedding array<float>")
    top = lambda k: sorted((r.video_id, r["rank"], r.item) for r in R.top_windows(windows, queries, k).collect())
    assert top(1) == [("v", 1, 1), ("w", 1, 8)] and set(top(1)) <= set(top(9)) and len(top(9)) == 3


def test_closest_ratio_and_image_cap(spark):
    ratios = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)]
    df = spark.createDataFrame([(400, 400), (900, 900), (640, 480), (1500, 500), (100, 200)], "w int, h int")
    got = df.select(T.closest_ratio(F.col("w"), F.col("h"), ratios, 448).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [(1, 1), (2, 2), (3, 2), (2, 1), (1, 2)]
    caps = spark.createDataFrame([(16, 0), (16, 140), (16, 150), (16, 151)], "g int, b int").select(T.capped_images(F.col("g"), F.col("b")).alias("n")).collect()
    assert [r.n for r in caps] == [16, 10, 0, 0]


def test_cue_span_moves_by_the_start_of_the_video(spark):
    r = spark.range(1).select(T.cue_span(F.lit(7.0), F.lit("end"), F.lit(2.0), F.lit(12.0)).alias("s"), T.cue_span(F.lit(7.0), F.lit("9.0"), F.lit(2.0), F.lit(12.0)).alias("t")).first()
    assert tuple(r.s) == (5.0, 10.0, 7.5) and tuple(r.t) == (5.0, 7.0, 6.0)
