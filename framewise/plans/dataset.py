"""Queries that build, split, merge and repair question datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions import text as T
from framewise.operators import answers, dataset
from framewise.plans.views import query, table


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_input")


@query("SELECT video_id, arg_min(data_source, entry_id) AS data_source, min(entry_id) AS entry_id FROM data_input WHERE video_id IS NOT NULL GROUP BY 1")
def first_entry_per_video(spark: SparkSession, d: str) -> DataFrame:
    """First entry of each video."""
    rows = dataset.keep_first(entries(spark, d).where("video_id is not null"), ["video_id"], ["entry_id"])
    return rows.select("video_id", "data_source", "entry_id")


@query("SELECT video_id, arg_max(video_path, loaded_at) FILTER (WHERE video_path IS NOT NULL) AS video_path FROM video_info WHERE video_id IS NOT NULL GROUP BY 1 HAVING count(video_path) > 0")
def last_path_per_video(spark: SparkSession, d: str) -> DataFrame:
    """Last value of each key wins."""
    rows = table(spark, d, "video_info").where("video_id is not null and video_path is not null")
    return dataset.keep_last(rows, ["video_id"], F.col("video_path"), F.col("loaded_at"), "video_path")


KEY = "md5(concat_ws(':', '42', entry_id::VARCHAR))"


@query(f"WITH r AS (SELECT entry_id, row_number() OVER (ORDER BY {KEY}, entry_id) - 1 AS place, floor(count(*) OVER () * 0.9) AS n FROM data_input) SELECT entry_id, CASE WHEN place < n THEN 'train' ELSE 'test' END AS split FROM r")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Exact nine tenths for training by seeded shuffle."""
    return dataset.train_test_split(entries(spark, d).select("entry_id"), "entry_id", 0.9)


@query(f"WITH r AS (SELECT entry_id, row_number() OVER (ORDER BY {KEY}, entry_id) - 1 AS place, count(*) OVER () AS n FROM data_input) SELECT entry_id, place, CASE WHEN place < (n // 4 + 1) * (n % 4) THEN place // (n // 4 + 1) ELSE (place - n % 4) // (n // 4) END AS shard, (place % 3)::INT AS robin FROM r")
def shards(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous shards and round-robin shards of a shuffled set."""
    rows = entries(spark, d).select("entry_id")
    total = rows.count()
    placed = dataset.ranked(rows, [dataset.shuffle_key(F.col("entry_id"), 42), F.col("entry_id")])
    return dataset.round_robin(placed.withColumn("part", dataset.shard_of(F.col("place"), F.lit(total), 4)), 3).select("entry_id", "place", F.col("part").alias("shard"), F.col("shard").alias("robin"))


@query(f"SELECT entry_id FROM data_input ORDER BY {KEY}, entry_id LIMIT 200")
def sampled_entries(spark: SparkSession, d: str) -> DataFrame:
    """Seeded sample in the original order."""
    return dataset.sample_positions(entries(spark, d).select("entry_id"), "entry_id", 200)


@query("SELECT entry_id, data_source FROM data_input ORDER BY entry_id LIMIT 100")
def first_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first examples in order."""
    return entries(spark, d).select("entry_id", "data_source").orderBy("entry_id").limit(100)


@query("""SELECT 'a' || s_suppkey AS id, s_name AS name, s_acctbal AS score, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'b' || c_custkey, c_name, NULL, c_mktsegment FROM customer""")
def merged_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union of sets with different columns, ids as text."""
    a = table(spark, d, "supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    b = table(spark, d, "customer").select(F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return dataset.merged([a, b])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur in more than one shard."""
    return dataset.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT video_id FROM video_info WHERE video_id IS NOT NULL EXCEPT SELECT video_id FROM frame_subtitles")
def videos_without_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """Videos whose artefact is missing."""
    return table(spark, d, "video_info").where("video_id is not null").select("video_id").subtract(table(spark, d, "frame_subtitles").select("video_id"))


@query("SELECT video_id FROM video_info WHERE video_id IS NOT NULL INTERSECT SELECT video_id FROM window_embeddings")
def indexed_videos(spark: SparkSession, d: str) -> DataFrame:
    """Videos of both sets."""
    return table(spark, d, "video_info").where("video_id is not null").select("video_id").intersect(table(spark, d, "window_embeddings").select("video_id"))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE ends) AS complete FROM (SELECT DISTINCT video_id, video_id IN (SELECT video_id FROM subtitle_embeddings WHERE video_id IS NOT NULL) AS ends FROM video_info WHERE video_id IS NOT NULL)")
def index_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Indexed videos of all videos."""
    videos = table(spark, d, "video_info").where("video_id is not null").select("video_id").distinct()
    done = table(spark, d, "subtitle_embeddings").select("video_id").distinct().withColumn("done", F.lit(True))
    return videos.join(done, "video_id", "left").agg(F.count("*").alias("files"), F.count_if(F.coalesce("done", F.lit(False))).alias("complete"))


@query("SELECT video_id, count(*) AS embeddings, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS broken FROM window_embeddings GROUP BY 1")
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings per video."""
    bad = F.col("embedding").isNull() | (F.size("embedding") != 64)
    return table(spark, d, "window_embeddings").groupBy("video_id").agg(F.count("*").alias("embeddings"), F.count_if(bad).alias("broken"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'new ' || p_brand ELSE p_type END AS spec, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS size FROM part")
def overlaid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Processed rows replace the old ones, also with nulls."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("spec"), F.col("p_size").alias("size"))
    new = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("new "), "p_brand").alias("spec"), F.lit(None).cast("int").alias("size"))
    return dataset.overlay(base, new, "id", ["spec", "size"])


@query("""SELECT data_source, entry_id, row_number() OVER (ORDER BY data_source, entry_id) - 1 AS "index" FROM data_input""")
def running_index(spark: SparkSession, d: str) -> DataFrame:
    """Index that runs on over files."""
    return dataset.running_offset(entries(spark, d).select("data_source", "entry_id"), "data_source", "entry_id").select("data_source", "entry_id", F.col("index").cast("long").alias("index"))


@query("""WITH w AS (SELECT data_source, video_id, count(question) AS k FROM data_input WHERE split = 'validation' AND video_id IS NOT NULL AND data_source IS NOT NULL GROUP BY 1, 2)
SELECT e.entry_id FROM data_input e JOIN w ON e.data_source = w.data_source AND e.video_id = w.video_id WHERE k = 0
 OR EXISTS (SELECT 1 FROM data_input q WHERE q.split = 'validation' AND q.data_source = e.data_source AND q.video_id = e.video_id AND q.question = e.question)""")
def selected_members(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the videos and questions that validation asks; a video it asks no question of counts whole."""
    wanted = entries(spark, d).where("split = 'validation' and video_id is not null").select("data_source", "video_id", "question")
    return dataset.members(entries(spark, d), wanted, ["data_source", "video_id"], "question").select("entry_id")


@query("SELECT entry_id FROM data_input WHERE NOT regexp_matches(video_id, 'burned|mkv|raw') AND contains(question, 'the')")
def excluded_videos(spark: SparkSession, d: str) -> DataFrame:
    """Rows without certain parts in the id and with a pattern in the question."""
    return entries(spark, d).where(~F.col("video_id").rlike("burned|mkv|raw") & F.col("question").contains("the")).select("entry_id")


@query("SELECT c_custkey AS id, r.part FROM customer JOIN (SELECT DISTINCT substr(r_name, 2, 2) AS part FROM region) r ON contains(c_mktsegment, r.part)")
def substring_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text contains a key of a small table."""
    small = table(spark, d, "region").select(F.substring("r_name", 2, 2).alias("part")).distinct()
    big = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    return dataset.substring_join(big, "text", small, "part").select("id", "part")


@query("""WITH f AS (SELECT DISTINCT video_path AS name, regexp_replace(lower(video_path), '[^a-z0-9]+', '', 'g') AS k FROM video_info WHERE video_path IS NOT NULL),
w AS (SELECT DISTINCT video_id AS key, regexp_replace(lower(video_id), '[^a-z0-9]+', '', 'g') AS k FROM video_info WHERE video_id IS NOT NULL)
SELECT key, min(name) AS name, false AS exact FROM w JOIN f ON contains(f.k, w.k) GROUP BY 1""")
def matched_files(spark: SparkSession, d: str) -> DataFrame:
    """File of each video, equal name first, else by part of the name."""
    info = table(spark, d, "video_info")
    files = info.where("video_path is not null").select(F.col("video_path").alias("name")).distinct()
    return dataset.fuzzy_match(info.where("video_id is not null").select(F.col("video_id").alias("key")).distinct(), files, "key", "name")


@query("WITH v AS (SELECT video_id, count(*) AS n FROM window_embeddings WHERE video_id IS NOT NULL GROUP BY 1) SELECT entry_id, e.video_id, n AS windows FROM data_input e JOIN v ON e.video_id = v.video_id")
def features_per_entry(spark: SparkSession, d: str) -> DataFrame:
    """One computation per video, fanned out to its entries."""
    v = table(spark, d, "window_embeddings").where("video_id is not null").groupBy("video_id").agg(F.count("*").alias("windows"))
    return entries(spark, d).select("entry_id", "video_id").join(v, "video_id")


@query("SELECT count(*) AS uids, count(DISTINCT video_id) AS videos, round(count(*) / count(DISTINCT video_id), 4) AS ratio, round(100 * (1 - count(DISTINCT video_id) / count(*)), 4) AS saved FROM data_input WHERE video_id IS NOT NULL")
def dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Work saved by computing once a video."""
    n, v = F.count("*"), F.count_distinct("video_id")
    return entries(spark, d).where("video_id is not null").agg(n.alias("uids"), v.alias("videos"), F.round(n / v, 4).alias("ratio"), F.round(100 * (1 - v / n), 4).alias("saved"))


@query("""WITH c AS (SELECT video_id, list(list_extract(subtitles, 1) ORDER BY window_start) AS caps FROM (SELECT video_id, window_start, arg_max(subtitles, loaded_at) AS subtitles FROM window_subtitles WHERE video_id IS NOT NULL AND len(subtitles) > 0 GROUP BY 1, 2) GROUP BY 1)
SELECT video_id, coalesce(caps[1], '') || '|' || coalesce(caps[3], '') AS picked FROM c""")
def picked_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions chosen by a 1-based list of places."""
    rows = table(spark, d, "window_subtitles").where("video_id is not null and size(subtitles) > 0").groupBy("video_id", "window_start").agg(F.max_by("subtitles", "loaded_at").alias("s"))
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy("window_start"))).where("place <= 3")
    pick = lambda i: F.coalesce(F.max(F.when(F.col("place") == i, F.col("s")[0])), F.lit(""))
    return placed.groupBy("video_id").agg(F.concat(pick(1), F.lit("|"), pick(3)).alias("picked"))


@query("""WITH a AS (SELECT video_id, min(entry_id) AS pos FROM data_input WHERE video_id IS NOT NULL GROUP BY 1), t AS (SELECT * FROM a WHERE video_id NOT IN (SELECT video_id FROM frame_subtitles WHERE video_id IS NOT NULL))
SELECT video_id, pos, (row_number() OVER (ORDER BY pos, video_id) - 1)::INT AS place, ((row_number() OVER (ORDER BY pos, video_id) - 1) % 4)::INT AS worker FROM t""")
def caption_plan(spark: SparkSession, d: str) -> DataFrame:
    """Videos still to caption, in first-seen order, over workers."""
    asked = entries(spark, d).where("video_id is not null").select("video_id", F.col("entry_id").alias("pos"))
    return dataset.caption_plan(asked, table(spark, d, "frame_subtitles").where("video_id is not null"))


@query("SELECT l.l_orderkey AS qid, l.l_linenumber AS line, l.l_partkey AS part, l.l_suppkey AS supp, coalesce(o.o_orderpriority, 'none') AS meta FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o.o_orderkey")
def result_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of results by question, with defaults."""
    meta = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("meta"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return lines.join(meta, "qid", "left").withColumn("meta", F.coalesce("meta", F.lit("none")))


@query("WITH p AS (SELECT video_id, entry_id, row_number() OVER (ORDER BY entry_id) - 1 AS place FROM data_input), r AS (SELECT o_orderkey AS qid, 'v' || lpad((o_orderkey % 2 * 7)::VARCHAR, 9, '0') AS video_id FROM orders) SELECT qid, p.entry_id FROM r JOIN p ON r.qid = p.place AND r.video_id = p.video_id")
def positional_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows found by position, only where the video agrees."""
    placed = dataset.running_offset(entries(spark, d).select("video_id", "entry_id"), None, "entry_id")
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.concat(F.lit("v"), F.lpad((F.col("o_orderkey") % 2 * 7).cast("string"), 9, "0")).alias("video_id"))
    return r.join(placed, ["index", "video_id"]).select(F.col("index").alias("qid"), "entry_id")


@query("SELECT w.video_id, w.window_start // 8 AS window_idx, coalesce(list_sort(list_distinct(list(f.frame_idx)))[1], -1) AS first_frame FROM (SELECT DISTINCT video_id, window_start FROM window_subtitles WHERE video_id IS NOT NULL) w LEFT JOIN frame_subtitles f ON w.video_id = f.video_id AND f.frame_idx // 8 = w.window_start // 8 GROUP BY 1, 2")
def precomputed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Stored frames of a window, none gives the default."""
    w = table(spark, d, "window_subtitles").where("video_id is not null").select("video_id", F.floor(F.col("window_start") / 8).cast("int").alias("window_idx")).distinct()
    f = table(spark, d, "frame_subtitles").select("video_id", F.floor(F.col("frame_idx") / 8).cast("int").alias("window_idx"), "frame_idx")
    return w.join(f, ["video_id", "window_idx"], "left").groupBy("video_id", "window_idx").agg(F.coalesce(F.min("frame_idx"), F.lit(-1)).alias("first_frame"))


@query("""SELECT video_id, paths.subtitle_path AS subtitle_path, min(entry_id) AS entry_id FROM data_input WHERE video_id IS NOT NULL AND paths.subtitle_path IS NOT NULL
AND video_id NOT IN (SELECT video_id FROM frame_subtitles WHERE video_id IS NOT NULL) GROUP BY 1, 2""")
def burn_list(spark: SparkSession, d: str) -> DataFrame:
    """Work list without repeats and without the videos that are done, here those with frame subtitles."""
    rows = entries(spark, d).where("video_id is not null and paths.subtitle_path is not null").select("video_id", "paths.subtitle_path", "entry_id")
    return answers.resume(dataset.keep_first(rows, ["video_id", "subtitle_path"], ["entry_id"]), table(spark, d, "frame_subtitles").select("video_id"), "video_id").select("video_id", "subtitle_path", "entry_id")


@query("""SELECT entry_id, data_source, coalesce(video_id, '') AS video_id, coalesce(answer, '') AS ground_truth, 'rule' AS style, coalesce(split, 'train') AS split, coalesce(paths.video_path, paths.raw_video_path, '') AS path FROM data_input""")
def rl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entries as rows for training, with defaults for missing parts."""
    from framewise.sources.loaders import rl_row

    rows = rl_row(entries(spark, d))
    e = F.col("extra_info")
    kw = e["tools_kwargs"]["video_search"]["execute_kwargs"]
    return rows.select(e["index"].alias("entry_id"), "data_source", F.coalesce(kw["video_id"], F.lit("")).alias("video_id"), F.coalesce(F.col("reward_model")["ground_truth"], F.lit("")).alias("ground_truth"), F.col("reward_model")["style"].alias("style"), F.coalesce(e["split"], F.lit("train")).alias("split"), F.coalesce(e["paths"]["video_path"], e["paths"]["raw_video_path"], F.lit("")).alias("path"))


NORMAL = """CASE WHEN regexp_full_match(a, '[(\\[]?[A-Za-z][)\\]]?') AND ascii(upper(regexp_extract(a, '([A-Za-z])', 1))) - 65 < n THEN (ascii(upper(regexp_extract(a, '([A-Za-z])', 1))) - 65)::VARCHAR
WHEN regexp_full_match(a, '\\d+') AND a::INT < n THEN (a::INT)::VARCHAR WHEN regexp_full_match(a, '\\d+') AND a::INT BETWEEN 1 AND n THEN (a::INT - 1)::VARCHAR
WHEN list_contains(list_transform(c, lambda x: lower(trim(x))), lower(a)) THEN (list_position(list_transform(c, lambda x: lower(trim(x))), lower(a)) - 1)::VARCHAR END"""


@query(f"""WITH r AS (SELECT p_partkey AS id, [p_type, p_brand, 'none'] AS c, 3 AS n, CASE p_partkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN '(C)' WHEN 2 THEN '3' WHEN 3 THEN upper(p_type) WHEN 4 THEN '9' ELSE p_brand END AS a FROM part)
SELECT id, {NORMAL} AS by_rules, CASE WHEN regexp_full_match(a, '\\d+') THEN CASE WHEN a::INT <= 4 THEN a::INT ELSE -1 END WHEN regexp_full_match(upper(a), '[A-E]') THEN ascii(upper(a)) - 65 ELSE coalesce(list_position(c, a), 0) - 1 END AS truth,
coalesce(CASE WHEN regexp_full_match(a, '\\d+') THEN c[a::INT + 1] WHEN regexp_full_match(a, '[A-Za-z]') THEN c[ascii(upper(a)) - 64] END, '') AS chosen FROM r""")
def normalised_choices(spark: SparkSession, d: str) -> DataFrame:
    """Choices from letters, numbers or texts by three rules."""
    n = F.col("p_partkey") % 6
    a = F.when(n == 0, "b").when(n == 1, "(C)").when(n == 2, "3").when(n == 3, F.upper("p_type")).when(n == 4, "9").otherwise(F.col("p_brand"))
    c = F.array("p_type", "p_brand", F.lit("none"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.choice_to_index(a, c).alias("by_rules"), T.truth_index(a, c).alias("truth"), T.choice_text(c, a).alias("chosen"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size AS s FROM part) SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE '1,' || s || ',7' END AS relevance, CASE WHEN id % 3 = 0 THEN '3,3,3,3,3' ELSE '1,' || least(s, 3) || ',3,3,3' END AS scores, (id % 5)::INT AS prediction, CASE WHEN id % 2 = 0 THEN (id % 5)::INT ELSE -1 END AS first_char, (id % 5)::INT AS anchored, '1-' || s || ';0-9' AS intervals FROM r""")
def prompt_parsers(spark: SparkSession, d: str) -> DataFrame:
    """Predictions, relevance lists and intervals of model texts."""
    n, s = F.col("p_partkey"), F.col("p_size").cast("string")
    letter = F.char(65 + n % 5)
    raw = F.when(n % 3 != 0, F.concat(F.lit("frame relevance: [1, "), s, F.lit(", 7]"))).otherwise("nothing")
    spans = F.concat(F.lit("[1, "), s, F.lit("] and [None, 9]. Then more"))
    pairs = F.array_join(F.transform(T.intervals(spans), lambda p: F.concat(p[0].cast("string"), F.lit("-"), p[1].cast("string"))), ";")
    return table(spark, d, "part").select(
        n.alias("id"), F.array_join(T.relevance_list(raw).cast("array<string>"), ",").alias("relevance"), F.array_join(T.relevance_scores(raw, 5).cast("array<string>"), ",").alias("scores"), T.prediction_index(F.concat(F.lit("Prediction: "), F.lower(letter))).alias("prediction"),
        T.first_char_answer(F.when(n % 2 == 0, letter).otherwise("?")).alias("first_char"), T.char_after_anchor(F.concat(F.lit("So (answer: "), letter, F.lit(")")), "answer: ").alias("anchored"), pairs.alias("intervals"),
    )


@query("SELECT doc_id, '{\"a\": ' || doc_id || '}' AS found, md5(coalesce(source, '')) AS cache_key FROM documents")
def json_in_text(spark: SparkSession, d: str) -> DataFrame:
    """JSON object inside a text, cache key of a path."""
    raw = F.concat(F.lit("Sure:\n"), F.lit('{"a": '), F.col("doc_id").cast("string"), F.lit("} done"))
    return table(spark, d, "documents").select("doc_id", T.json_object(raw).alias("found"), F.md5(F.coalesce("source", F.lit(""))).alias("cache_key"))


@query("SELECT data_source, coalesce(split, 'none') AS split, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY data_source), 6)::DOUBLE AS share FROM data_input GROUP BY 1, 2")
def split_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows per split with their share of the source."""
    g = entries(spark, d).groupBy("data_source", F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("data_source")), 6))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON columns."""
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
