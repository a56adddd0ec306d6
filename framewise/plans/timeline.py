"""Queries on frames, windows, cues, samples and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions import timeline as T
from framewise.operators import dataset, retrieval
from framewise.plans.views import query, table
from framewise.sources.srt import parse_srt


def joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


@query("SELECT video_id, frame_idx // 8 AS window_idx, count(DISTINCT frame_idx) AS frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM frame_subtitles WHERE video_id IS NOT NULL GROUP BY 1, 2")
def frame_windows(spark: SparkSession, d: str) -> DataFrame:
    """Frames into windows of 8, the last one partial."""
    rows = table(spark, d, "frame_subtitles").where("video_id is not null")
    return rows.groupBy("video_id", T.window_of(F.col("frame_idx")).alias("window_idx")).agg(F.count_distinct("frame_idx").alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


@query("SELECT DISTINCT video_id, window_idx, array_to_string(range(window_idx * 8, least((window_idx + 1) * 8, end_frame)), ',') AS frames, CAST(ceil(end_frame / 8) AS INT) AS windows FROM window_embeddings WHERE video_id IS NOT NULL AND end_frame > window_idx * 8")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    """M7: frames of each window, cut at the last frame."""
    rows = table(spark, d, "window_embeddings").where("video_id is not null and end_frame > window_idx * 8")
    return rows.select("video_id", "window_idx", joined(T.window_frames(F.col("window_idx"), 8, F.col("end_frame"))).alias("frames"), T.window_count(F.col("end_frame")).alias("windows")).distinct()


@query("""WITH c AS (SELECT o_custkey AS video_id, o_orderpriority AS text, (o_orderkey % 97) * 0.5e0 AS s, (o_orderkey % 97) * 0.5e0 + o_orderkey % 7 AS e FROM orders),
r AS (SELECT video_id, text, greatest(CAST(floor(s * 2 / 2) AS INT), 0) AS lo, least(CAST(floor(e * 2 / 2) AS INT), 49) AS hi FROM c)
SELECT DISTINCT video_id, text, unnest(range(lo, hi + 1))::INT AS frame_idx FROM r WHERE lo <= hi""")
def cue_frames(spark: SparkSession, d: str) -> DataFrame:
    """Cues onto frames, the end inclusive."""
    start = (F.col("o_orderkey") % 97) * 0.5
    cues = table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("text"), start.alias("start"), (start + F.col("o_orderkey") % 7).alias("end"), F.lit(2.0).alias("fps"), F.lit(2).alias("step"), F.lit(50).alias("total"))
    return retrieval.cue_frames(cues)


@query("SELECT video_id, text, array_to_string(list_sort(list_distinct(list(frame_idx // 8))), ',') AS windows FROM (SELECT video_id, frame_idx, unnest(subtitles) AS text FROM frame_subtitles WHERE video_id IS NOT NULL) WHERE text IS NOT NULL GROUP BY 1, 2")
def inverted_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """Windows of every subtitle text."""
    rows = table(spark, d, "frame_subtitles").where("video_id is not null").select("video_id", "frame_idx", F.explode("subtitles").alias("text")).where("text is not null")
    return retrieval.inverted_subtitles(rows).withColumn("windows", joined(F.col("windows")))


@query("""WITH f AS (SELECT DISTINCT video_id, frame_idx FROM frame_subtitles WHERE video_id IS NOT NULL), g AS (SELECT video_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS island FROM f)
SELECT video_id, min(frame_idx)::BIGINT AS start, max(frame_idx)::BIGINT + 1 AS "end" FROM g GROUP BY video_id, island""")
def frame_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive frames as ranges."""
    return retrieval.islands(table(spark, d, "frame_subtitles").where("video_id is not null"), "video_id", "frame_idx")


N = "SELECT DISTINCT video_id, processed_frame_count AS n FROM video_info WHERE video_id IS NOT NULL AND processed_frame_count > 0"


@query(f"""WITH v AS ({N}) SELECT video_id,
array_to_string(CASE WHEN 16 >= n THEN range(n) ELSE list_transform(range(16), lambda i: floor(i * (n - 1) / 15)::BIGINT) END, ',') AS linspace,
array_to_string(CASE WHEN 16 >= n THEN range(n) ELSE list_transform(range(16), lambda i: round_even(i * (n - 1) / 15e0, 0)::BIGINT) END, ',') AS rounded,
array_to_string(list_transform(range(16), lambda i: floor(i * n / 16)::BIGINT), ',') AS strided,
(n // 2)::VARCHAR AS centre,
array_to_string(list_transform(range(32), lambda i: floor(n / 64e0 + round_even(n / 32e0 * i, 0))::BIGINT), ',') AS centres,
array_to_string(list_slice(range(0, n, greatest(n // 8, 1)), 1, 8), ',') AS stepped,
array_to_string(list_transform(range(8), lambda i: CASE WHEN n >= 8 THEN i * (n // 8) ELSE least(i, n - 1) END), ',') AS eight FROM v""")
def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    """The rules that spread samples over a video."""
    n = F.col("n")
    v = table(spark, d, "video_info").where("video_id is not null and processed_frame_count > 0").select("video_id", F.col("processed_frame_count").alias("n")).distinct()
    return v.select(
        "video_id", joined(T.uniform_sample(n, 16)).alias("linspace"), joined(T.uniform_sample(n, 16, "round")).alias("rounded"), joined(T.uniform_sample(n, 16, "stride")).alias("strided"), joined(T.centre_or_linspace(n, 1)).alias("centre"),
        joined(T.segment_centres(F.lit(0.0), n.cast("double"))).alias("centres"), joined(T.step_sample(n)).alias("stepped"), joined(T.eight_frames(n)).alias("eight"),
    )


DUR = "coalesce(original_duration, CASE WHEN original_fps > 0 AND original_frame_count > 0 THEN original_frame_count / original_fps END)"


@query(f"""WITH v AS (SELECT video_id, arg_max({DUR}, loaded_at) AS s, arg_max(original_fps, loaded_at) AS fps FROM video_info WHERE video_id IS NOT NULL AND {DUR} IS NOT NULL GROUP BY 1)
SELECT video_id, round(s, 4) AS seconds, CASE WHEN s < 60 THEN '0-1min' WHEN s < 600 THEN '1-10min' WHEN s < 3600 THEN '10-60min' ELSE '60min+' END AS bucket, greatest(1, round_even(fps, 0)::INT) AS step FROM v WHERE s >= 0""")
def video_durations(spark: SparkSession, d: str) -> DataFrame:
    """Duration from the first usable field, its bucket and the frame step."""
    s = F.coalesce("original_duration", F.when((F.col("original_fps") > 0) & (F.col("original_frame_count") > 0), F.col("original_frame_count") / F.col("original_fps")))
    rows = table(spark, d, "video_info").where("video_id is not null").withColumn("s", s).where("s is not null")
    v = rows.groupBy("video_id").agg(F.max_by("s", "loaded_at").alias("s"), F.max_by("original_fps", "loaded_at").alias("fps")).where("s >= 0")
    return v.select("video_id", F.round("s", 4).alias("seconds"), T.length_bucket(F.col("s")).alias("bucket"), T.frame_step(F.col("fps")).alias("step"))


@query("""SELECT o_orderkey AS id, (o_orderkey % 90000)::DOUBLE + (o_orderkey % 1000) / 1000e0 AS seconds, (o_orderkey % 90000)::BIGINT AS whole,
lpad((o_orderkey % 90000 // 3600)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 90000 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 90000 % 60)::VARCHAR, 2, '0') || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS srt,
lpad((o_orderkey % 90000 // 3600)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 90000 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 90000 % 60)::VARCHAR, 2, '0') AS clock,
CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 77)::DOUBLE + 0.5 WHEN 1 THEN 3661e0 END AS any_form FROM orders""")
def clock_values(spark: SparkSession, d: str) -> DataFrame:
    """Clock texts and seconds, both ways."""
    n = F.col("o_orderkey")
    s = (n % 90000).cast("double") + (n % 1000) / 1000
    text = T.srt_clock(s)
    form = F.when(n % 3 == 0, F.concat((n % 77).cast("string"), F.lit(".5"))).when(n % 3 == 1, "01:01:01").otherwise("soon")
    return table(spark, d, "orders").select(n.alias("id"), F.round(T.clock_seconds(text), 3).alias("seconds"), T.clock_whole_seconds(F.replace(text, F.lit(","), F.lit("."))).alias("whole"), text.alias("srt"), T.clock(s).alias("clock"), T.any_seconds(form).alias("any_form"))


@query("""SELECT p_partkey AS id, 0 AS cue, (p_partkey % 60)::DOUBLE + 0.25 AS start, (p_partkey % 60)::DOUBLE + 2.5 AS "end", p_type || ' and ' || p_brand AS line FROM part UNION ALL SELECT p_partkey, 3, 3600e0, 3601e0, 'last' FROM part""")
def srt_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues of SRT texts; short and broken blocks are skipped."""
    sec = F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")
    head = F.concat(F.lit("1\r\n00:00:"), sec, F.lit(",250 --> "), T.srt_clock((F.col("p_partkey") % 60).cast("double") + 2.5))
    text = F.concat(head, F.lit('\r\n<font color="red">'), "p_type", F.lit("</font> and\r\n"), "p_brand", F.lit("\r\n\r\n2\r\nno arrow\r\nx\r\n\n3\n00:00:01,000 --> 00:00:02,000\n\n4\n01:00:00.000 --> 01:00:01.000\nlast\n"))
    return parse_srt(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("srt")), ["id"], "srt")


@query("""WITH c AS (SELECT event_id, value - 20 - event_id % 3 AS s, CASE WHEN event_id % 11 = 0 THEN 60e0 ELSE value - 20 + (event_id % 5) * 0.4 END - event_id % 3 AS e, 60e0 AS dur FROM events),
r AS (SELECT event_id, s, e, CASE WHEN e - s < 1 THEN (s + e) / 2 - 0.5 ELSE s END AS a, CASE WHEN e - s < 1 THEN (s + e) / 2 + 0.5 ELSE e END AS b, dur FROM c)
SELECT event_id, round(greatest(0, a), 6) + 0e0 AS start, round(least(dur, b), 6) + 0e0 AS "end", round((s + e) / 2, 6) + 0e0 AS middle FROM r WHERE b >= 0 AND a <= dur""")
def repaired_cues(spark: SparkSession, d: str) -> DataFrame:
    """T4 T5: cues moved by the video's start, lengthened to a second and cut at its ends; an end that is no number is the video's."""
    start, offset = F.col("value") - 20, F.col("event_id") % 3
    end = F.when(F.col("event_id") % 11 == 0, "end").otherwise((start + (F.col("event_id") % 5) * 0.4).cast("string"))
    at = T.cue_span(start, end, offset, F.lit(60.0))
    cue = T.repaired_cue(at["start"], at["end"], F.lit(60.0))
    return table(spark, d, "events").select("event_id", cue.alias("c"), at["middle"].alias("middle")).where("c is not null").select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in (("c.start", "start"), ("c.end", "end"), ("middle", "middle"))])


RATIOS = sorted({(i, j) for i in range(1, 7) for j in range(1, 7) if i * j <= 6}, key=lambda r: (r[0] * r[1], r))


@query(f"""WITH f AS (SELECT DISTINCT video_id, frame_width AS w, frame_height AS h FROM video_info WHERE frame_width > 0 AND frame_height > 0),
r AS (SELECT * FROM (VALUES {', '.join(f'({k}, {i}, {j})' for k, (i, j) in enumerate(RATIOS))}) AS r(k, i, j)),
o AS (SELECT video_id, w, h, k, i, j, abs(w::DOUBLE / h - i::DOUBLE / j) AS d FROM f, r), m AS (SELECT *, min(d) OVER (PARTITION BY video_id, w, h) AS least FROM o),
c AS (SELECT *, min(k) OVER (PARTITION BY video_id, w, h) AS first FROM m WHERE d = least),
b AS (SELECT video_id, w, h, arg_max(i || 'x' || j, k) AS tiles FROM c WHERE k = first OR w * h > 0.5 * 448 * 448 * i * j GROUP BY 1, 2, 3)
SELECT video_id, w, h, round(least(1, 448e0 / w, 336e0 / h), 6) AS box, round(least(1, 512e0 / greatest(w, h)), 6) AS side, tiles
FROM f JOIN b USING (w, h) WHERE f.video_id IS NOT DISTINCT FROM b.video_id""".replace("SELECT video_id, w, h, round(least(1, 448e0", "SELECT f.video_id, w, h, round(least(1, 448e0"))
def frame_scales(spark: SparkSession, d: str) -> DataFrame:
    """Factors that fit frames into a box or a longest side, and the tiling of the closest aspect ratio."""
    w, h = F.col("frame_width"), F.col("frame_height")
    rows = table(spark, d, "video_info").where("frame_width > 0 and frame_height > 0")
    best = T.closest_ratio(w, h, RATIOS, 448)
    tiles = F.concat(best[0].cast("string"), F.lit("x"), best[1].cast("string"))
    return rows.select("video_id", w.alias("w"), h.alias("h"), F.round(T.fit_scale(w, h, 448, 336), 6).alias("box"), F.round(T.longest_side_scale(w, h, 512), 6).alias("side"), tiles.alias("tiles")).distinct()


@query("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_concat(range(p_size::BIGINT, p_size::BIGINT + 4), range(greatest(p_partkey % 9 - 3, 0), p_partkey % 9 + 4)))), ',') AS frames,
round(p_size / (100 * 2 / 3e0), 6) AS important, round((300 - p_size) / (100 / 3e0), 6) AS other FROM part""")
def important_segments(spark: SparkSession, d: str) -> DataFrame:
    """Frames of position pairs with a lone last one, and speeds of both parts."""
    positions = F.array(F.col("p_size"), F.col("p_size") + 3, (F.col("p_partkey") % 9).cast("int"))
    speed = T.speed_factors(F.col("p_size"), F.lit(300), F.lit(100))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), joined(T.segments_of_positions(positions, 3)).alias("frames"), speed.alias("s"))
    return rows.select("id", "frames", F.round("s.important", 6).alias("important"), F.round("s.other", 6).alias("other"))


@query("SELECT p_partkey AS id, '#C 1: ' || p_type || chr(10) || '#C 2: ' || p_type || chr(10) || '#C 3: b' || chr(10) || '#C 4: b' AS captions, 4::BIGINT AS n FROM part")
def numbered_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions repeated to a frame rate and numbered."""
    text = T.numbered_captions(T.repeated_captions(F.array(F.col("p_type"), F.lit("b")), 2))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("captions"), F.regexp_count(text, F.lit("#C")).cast("long").alias("n"))


CALLS = "calls AS (SELECT l_orderkey AS request, l_linenumber AS call, CAST(l_partkey % 5 AS INT) AS slot, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE CAST(l_suppkey % 20 AS INT) END AS frame_idx, l_partkey, l_suppkey FROM lineitem)"


@query(f"""WITH {CALLS}, k AS (SELECT request, call, slot, coalesce(frame_idx, 999999 + call * 100 + slot) AS place FROM calls), f AS (SELECT request, place, min(call * 10 + slot) AS cs FROM k GROUP BY 1, 2)
SELECT request, place, (cs // 10)::INT AS call, (cs % 10)::INT AS slot, row_number() OVER (PARTITION BY request ORDER BY place) - 1 AS "order" FROM f""")
def merged_calls(spark: SparkSession, d: str) -> DataFrame:
    """Frames of parallel calls as one chronological list."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("call"), (F.col("l_partkey") % 5).cast("int").alias("slot"), F.when(F.col("l_suppkey") % 6 != 0, (F.col("l_suppkey") % 20).cast("int")).alias("frame_idx"))
    return retrieval.merged_calls(rows).select("request", "place", "call", "slot", F.col("order").cast("long").alias("order"))


@query("""WITH w AS (SELECT DISTINCT video_id, window_idx FROM window_embeddings WHERE video_id IS NOT NULL), r AS (SELECT video_id, list_sort(list(window_idx)) AS ws FROM w GROUP BY 1), t AS (SELECT video_id, list_slice(ws, 1, 4) AS ws FROM r),
f AS (SELECT video_id, flatten(list_transform(ws, lambda x: range(x * 8, x * 8 + 8))) AS fr FROM t)
SELECT video_id, array_to_string(CASE WHEN len(fr) > 16 THEN list_transform(range(16), lambda i: list_extract(fr, 1 + floor(i * (len(fr) - 1) / 15)::BIGINT)) ELSE fr END, ',') AS frames FROM f""")
def limited_frames(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved windows in order, expanded to frames, at most 16 spread evenly."""
    distinct = table(spark, d, "window_embeddings").where("video_id is not null and window_idx is not null").select("video_id", "window_idx").distinct()
    first = distinct.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy("window_idx"))).where("place <= 4")
    w = first.groupBy("video_id").agg(F.array_sort(F.array_agg("window_idx")).alias("ws"))
    frames = w.select("video_id", F.flatten(F.transform("ws", lambda x: F.sequence(x * 8, x * 8 + 7))).alias("fr"))
    return frames.select("video_id", joined(F.transform(T.uniform_sample(F.size("fr"), 16), lambda i: F.col("fr")[i])).alias("frames"))
