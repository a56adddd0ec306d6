"""Queries on small column rules, files written and read again, and events by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions import text
from framewise.operators import clustering, extension
from framewise.plans.views import query, table
from framewise.sources import files, index, paths
from framewise.streaming import progress


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN false ELSE coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size % 3)::VARCHAR END = (p_partkey % 3)::VARCHAR, false) END AS is_right FROM part")
def right_answers(spark: SparkSession, d: str) -> DataFrame:
    """equal answers count only where there is a truth."""
    pred = F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 3).cast("string"))
    gt = F.when(F.col("p_size") % 4 == 0, "").otherwise((F.col("p_partkey") % 3).cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), extension.right_answer(pred, gt).alias("is_right"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g') AS line, 'out/run.v1_' || strftime(loaded_at, '%Y-%m-%dT%H:%M:%S') || '.json' AS file FROM documents""")
def single_lines(spark: SparkSession, d: str) -> DataFrame:
    """texts on one line, and file names with a time before the ending."""
    return table(spark, d, "documents").select("doc_id", extension.single_line(F.col("text")).alias("line"), extension.stamped(F.lit("out/run.v1.json"), F.col("loaded_at")).alias("file"))


@query("""SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN '''query'' must be a non-empty string' WHEN coalesce(CASE kind WHEN 'question' THEN 'base' WHEN 'summary' THEN 'summary' ELSE kind END, '') NOT IN ('base', 'subtitle', 'summary') THEN '''mode'' must be ''base'', ''subtitle'' or ''summary''' END AS error FROM documents""")
def search_requests(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a request, as data."""
    mode = F.when(F.col("kind") == "question", "base").otherwise(F.col("kind"))
    return table(spark, d, "documents").select("doc_id", extension.search_errors(F.col("source"), mode).alias("error"))


@query("SELECT data_source AS name, count(*) AS n FROM data_input GROUP BY 1")
def found_columns(spark: SparkSession, d: str) -> DataFrame:
    """The first column the table has of several names."""
    rows = table(spark, d, "data_input")
    return rows.groupBy(F.col(extension.find_column(rows, ["dataset", "DATA_SOURCE", "source"])).alias("name")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, '{"' || p_size || '":"' || p_brand || '","' || (p_size + 1) || '":"x"}' AS json, p_brand AS back FROM part""")
def key_maps(spark: SparkSession, d: str) -> DataFrame:
    """Number keys as text for JSON, and back."""
    m = F.create_map(F.col("p_size").cast("int"), F.col("p_brand"), (F.col("p_size") + 1).cast("int"), F.lit("x"))
    as_text = F.to_json(extension.text_keys(m))
    back = extension.number_keys(F.from_json(as_text, "map<string,string>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), as_text.alias("json"), F.element_at(back, F.col("p_size").cast("int")).alias("back"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN text END AS body FROM documents")
def data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Contents of base64 data URLs; other text has none."""
    url = F.concat(F.when(F.col("doc_id") % 3 > 0, "data:text/plain;base64,").otherwise("plain,"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", ""))
    return table(spark, d, "documents").select("doc_id", F.decode(text.data_url(url), "UTF-8").alias("body"))


@query("SELECT p_partkey AS id, (p_size % 3)::DOUBLE AS score, p_size - 1 AS position, upper(p_type) AS kind FROM part")
def reward_positions(spark: SparkSession, d: str) -> DataFrame:
    """A score at the last valid token, and a column after an injected step."""
    rows = table(spark, d, "part").withColumn("valid_tokens", F.col("p_size"))
    scored = extension.reward_rows(extension.post_processed(rows, "p_type", F.upper), (F.col("p_size") % 3).cast("double"))
    return scored.select(F.col("p_partkey").alias("id"), "reward.score", "reward.position", F.col("p_type").alias("kind"))


@query(r"""WITH k AS (SELECT *, lower(regexp_replace(regexp_replace(question, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g')) AS q FROM data_input),
m AS (SELECT data_source, video_id, max(entry_id) AS max_turn, count(*) AS correct_count, count(q) AS asked FROM k WHERE split = 'test' AND video_id IS NOT NULL AND data_source IS NOT NULL GROUP BY 1, 2)
SELECT k.entry_id, m.max_turn, m.correct_count FROM k JOIN m USING (data_source, video_id) WHERE asked = 0 OR EXISTS (SELECT 1 FROM k w WHERE w.split = 'test' AND w.data_source = k.data_source AND w.video_id = k.video_id AND w.q = k.q)""")
def selected_payload(spark: SparkSession, d: str) -> DataFrame:
    """Rows of mined videos and questions with what was mined."""
    rows = table(spark, d, "data_input").select("entry_id", "data_source", "video_id", "question", "split")
    test = rows.where("split = 'test' and video_id is not null")
    mined = test.groupBy("data_source", "video_id").agg(F.max("entry_id").alias("max_turn"), F.count("*").alias("correct_count"), F.collect_set("question").alias("questions"))
    return extension.selected_payload(rows, mined).select("entry_id", "selection_meta.max_turn", "selection_meta.correct_count")


@query("SELECT p_partkey AS id, p_type AS kind, p_size AS size FROM part")
def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results added as JSON lines in two runs and read with a declared schema."""
    to = paths.scratch(spark, "lines")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    files.append_results(rows.where("id % 2 = 0"), to)
    files.append_results(rows.where("id % 2 = 1"), to)
    return files.read_jsonl(spark, to, rows.schema)


@query("""SELECT s_suppkey AS id, s_name || ', "' || s_suppkey || '"' AS name, s_acctbal AS balance FROM supplier""")
def annotation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with quotes and commas as CSV, and a verified parquet copy of them."""
    to = paths.scratch(spark, "annotations")
    name = F.concat("s_name", F.lit(', "'), F.col("s_suppkey").cast("string"), F.lit('"'))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"), F.col("s_acctbal").alias("balance"))
    rows.write.csv(f"{to}/csv", header=True, escape='"')
    files.write_verified(files.read_annotations(spark, f"{to}/csv", rows.schema), f"{to}/parquet")
    return spark.read.parquet(f"{to}/parquet")


@query("SELECT r_regionkey AS id, r_name AS name, (row_number() OVER (ORDER BY r_regionkey) - 1) AS pos FROM region WHERE r_regionkey < (SELECT max(r_regionkey) FROM region)")
def cut_off_array(spark: SparkSession, d: str) -> DataFrame:
    """The valid prefix of a JSON array whose last item is cut off."""
    to = paths.scratch(spark, "array")
    item = F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    whole = table(spark, d, "region").agg(F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("r_regionkey", item.alias("j")))), lambda x: x["j"]), ",\n").alias("t"))
    whole.select(F.concat(F.lit("[ "), F.expr("left(t, length(t) - 3)")).alias("value")).coalesce(1).write.option("lineSep", " ").text(to)
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return files.read_json_prefix(spark, f"{to}/*.txt", kinds).select("item.id", "item.name", "pos")


@query("""WITH w AS (SELECT video_id, window_idx::BIGINT AS item, embedding::DOUBLE[] AS e FROM window_embeddings WHERE video_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
s AS (SELECT probe_id AS query_id, video_id, item::INT AS "window", round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS sim FROM w, probes)
SELECT query_id, rank, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, "window")::INT AS rank FROM s) WHERE rank <= 5""")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings saved as an index table and searched over all its videos."""
    root = paths.scratch(spark, "index")
    rows = table(spark, d, "window_embeddings").select(F.lit("all").alias("dataset"), F.lit(8).alias("window_size"), "video_id", "vec_id", "window_idx", "embedding")
    index.save_table(rows, root, "window_embeddings")
    asked = table(spark, d, "probes").select(F.col("probe_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return index.search(spark, root, "all", asked, 5).select("query_id", "rank", "sim")


GROUPS = "p AS (SELECT label AS key, vec_id AS point, vec_id % 3 AS cluster, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE vec_id % 2 END AS sub, CASE WHEN vec_id % 3 = 2 THEN vec_id % 5 ELSE -1 END AS subsub, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"""WITH {GROUPS}, g AS (SELECT key, point, cluster, -1 AS sub, -1 AS subsub, e FROM p UNION ALL SELECT key, point, cluster, sub, subsub, e FROM p WHERE sub >= 0),
m AS (SELECT key, cluster, sub, subsub, list(x ORDER BY i) AS centre FROM (SELECT key, cluster, sub, subsub, i, avg(x) AS x FROM (SELECT key, cluster, sub, subsub, unnest(range(64)) AS i, unnest(e) AS x FROM g) GROUP BY ALL) GROUP BY ALL),
b AS (SELECT key, cluster, sub, subsub, arg_min(point, round(1 - list_cosine_similarity(e, centre), 6) * 1e6 + point / 1e6) AS point FROM g JOIN m USING (key, cluster, sub, subsub) GROUP BY ALL)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY point)::INT AS place, point FROM (SELECT DISTINCT key, point FROM b)""")
def level_representatives(spark: SparkSession, d: str) -> DataFrame:
    """K6: representatives of clusters and of their deepest groups, each point once, in temporal order."""
    n = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(F.col("label").alias("key"), n.alias("point"), (n % 3).alias("cluster"), F.when(n % 3 == 0, -1).otherwise(n % 2).alias("sub"), F.when(n % 3 == 2, n % 5).otherwise(-1).alias("subsub"), "embedding")
    return clustering.tree_representatives(rows.drop("embedding"), rows.select("key", "point", "embedding"), distinct=True)


@query("""WITH s AS (SELECT user_id AS key, count(*) AS points FROM events GROUP BY 1), t AS (SELECT DISTINCT key, least(k, points) AS k FROM s, (SELECT unnest([8, 16, 32]) AS k)),
h AS (SELECT key, k, len(list_filter(range(k), lambda c: (key + c) % 7 = 0)) AS high FROM t)
SELECT key, coalesce(min(CASE WHEN high >= 4 THEN k END), max(k))::INT AS k FROM h GROUP BY 1""")
def breadth_per_key(spark: SparkSession, d: str) -> DataFrame:
    """K4: clusters of each key, doubled until enough are highly relevant."""
    sizes = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("points"))
    tried = sizes.select("key", F.explode(F.array_distinct(F.transform(F.array(F.lit(8), F.lit(16), F.lit(32)), lambda x: F.least(x, F.col("points").cast("int"))))).alias("k"))
    clusters = tried.select("key", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    return clustering.breadth_levels(sizes, clusters.select("key", "k", F.when((F.col("key") + F.col("c")) % 7 == 0, 3).otherwise(1).alias("relevance")))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """2.11: events by hour and kind."""
    return progress.windowed_counts(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    """2.11: events by hours that begin every half hour."""
    return progress.windowed_counts(table(spark, d, "events"), slide="30 minutes").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER w < INTERVAL 30 MINUTE AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, island""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """2.11: sessions of users, ended by half an hour without an event."""
    return progress.sessions(table(spark, d, "events")).select("user_id", "start", "end", "n")


@query("SELECT event_type, count(*) AS n, round(avg((event_type = CASE user_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'signup' ELSE 'purchase' END)::INT), 6) AS accuracy FROM events GROUP BY 1")
def streamed_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """2.11: result files read as a stream, kept exactly once in numbered batches, and their running accuracy."""
    at = paths.scratch(spark, "stream")
    gt = F.when(F.col("user_id") % 3 == 0, "error").when(F.col("user_id") % 3 == 1, "signup").otherwise("purchase")
    rows = table(spark, d, "events").select(F.col("event_type").alias("parsed"), gt.alias("gt"))
    rows.repartition(4).write.json(f"{at}/in")
    done = progress.append_once(progress.read_results(spark, f"{at}/in", rows.schema, files_a_batch=1), f"{at}/out", f"{at}/state")
    done.awaitTermination()
    out = progress.running_accuracy(spark.read.parquet(f"{at}/out"), "parsed")
    return out.select(F.col("parsed").alias("event_type"), "n", F.round("accuracy", 6).alias("accuracy"))
