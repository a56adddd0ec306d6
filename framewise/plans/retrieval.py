"""Queries on embeddings: rankings, propositions, labels and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import vector
from framewise.operators import clustering, retrieval
from framewise.plans.views import query, table

GOOD = "video_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0"
NOT_ZERO = "list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"
WIN = f"w AS (SELECT video_id, vec_id AS item, embedding::DOUBLE[] AS e FROM window_embeddings WHERE {GOOD} AND {NOT_ZERO}), q AS (SELECT probe_id AS query_id, embedding::DOUBLE[] AS qe FROM probes)"


def probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "probes").select(F.col("probe_id").alias("query_id"), F.col("embedding").alias("query_embedding"), "proposition")


def windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "window_embeddings").select("video_id", F.col("vec_id").alias("item"), "embedding")


@query(f"""WITH {WIN}, s AS (SELECT query_id, video_id, item, round(list_cosine_similarity(e, qe), 6) AS sim FROM w, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY sim DESC, item)::INT AS rank FROM s) WHERE rank <= 4""")
def top_windows(spark: SparkSession, d: str) -> DataFrame:
    """O1 M1: windows of each video most similar to each query."""
    return retrieval.top_windows(windows(spark, d), probes(spark, d).drop("proposition"), 4)


@query(f"""WITH {WIN}, s AS (SELECT query_id, video_id, item, round(list_cosine_similarity(e, qe), 6) AS sim FROM w, q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item)::INT AS rank FROM s) WHERE rank <= 10""")
def top_windows_overall(spark: SparkSession, d: str) -> DataFrame:
    """O1: search over all videos."""
    return retrieval.top_windows(windows(spark, d), probes(spark, d).drop("proposition"), 10, per_video=False)


@query(f"""WITH s0 AS (SELECT video_id, vec_id AS item, windows, embedding::DOUBLE[] AS e FROM subtitle_embeddings WHERE {GOOD}), q AS (SELECT probe_id AS query_id, embedding::DOUBLE[] AS qe FROM probes),
s AS (SELECT query_id, video_id, item, windows, round(list_dot_product(e, qe) / (greatest(sqrt(list_dot_product(e, e)), 1e-8) * greatest(sqrt(list_dot_product(qe, qe)), 1e-8)), 6) AS sim FROM s0, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY sim DESC, item) AS rank FROM s),
f AS (SELECT query_id, video_id, frame // 8 AS win, min(rank) AS first_rank FROM (SELECT query_id, video_id, rank, unnest(windows) AS frame FROM r) GROUP BY 1, 2, 3),
c AS (SELECT *, count(*) OVER (PARTITION BY query_id, video_id ORDER BY first_rank RANGE UNBOUNDED PRECEDING) AS found FROM f),
t AS (SELECT *, min(first_rank) FILTER (WHERE found >= 4) OVER (PARTITION BY query_id, video_id) AS stop FROM c)
SELECT query_id, video_id, win AS "window", first_rank::INT AS first_rank FROM t WHERE first_rank <= coalesce(stop, first_rank)""")
def top_subtitles(spark: SparkSession, d: str) -> DataFrame:
    """O2: windows of the best subtitles until at least four are found."""
    rows = table(spark, d, "subtitle_embeddings").select("video_id", F.col("vec_id").alias("item"), "windows", "embedding")
    return retrieval.top_subtitles(rows, probes(spark, d).drop("proposition"), 4)


@query(f"""WITH {WIN}, p AS (SELECT proposition, embedding::DOUBLE[] AS pe FROM probes)
SELECT query_id, proposition, max(CASE WHEN starts_with(proposition, 'subtitle_') THEN CASE WHEN contains(proposition, CASE WHEN query_id % 2 = 0 THEN 'ferry' ELSE 'harbour' END) THEN 1e0 ELSE 0e0 END ELSE round(list_cosine_similarity(e, pe), 6) END) AS score
FROM (SELECT item % 5 AS query_id, e FROM w), p GROUP BY 1, 2""")
def proposition_scores(spark: SparkSession, d: str) -> DataFrame:
    """Propositions against retrieved windows, those about subtitles against the query's text."""
    good = windows(spark, d).where(F.col("video_id").isNotNull() & vector.usable(F.col("embedding")))
    got = good.select((F.col("item") % 5).alias("query_id"), "embedding").withColumn("asked", F.when(F.col("query_id") % 2 == 0, "ferry").otherwise("harbour"))
    return retrieval.proposition_scores(got, probes(spark, d).select("proposition", F.col("query_embedding").alias("proposition_embedding")), "asked")


@query("""WITH s AS (SELECT e.vec_id AS clip, p.probe_id AS label, 100 * list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS z FROM embeddings e, probes p),
x AS (SELECT clip, label, exp(z - max(z) OVER (PARTITION BY clip)) AS ez FROM s), y AS (SELECT clip, label, round(ez / sum(ez) OVER (PARTITION BY clip), 6) AS p FROM x)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY p DESC, label)::INT AS rank FROM y) WHERE rank <= 2""")
def softmax_labels(spark: SparkSession, d: str) -> DataFrame:
    """Likeliest labels of a clip."""
    clips = table(spark, d, "embeddings").select(F.col("vec_id").alias("clip"), "embedding")
    return retrieval.softmax_labels(clips, probes(spark, d).select(F.col("query_id").alias("label"), F.col("query_embedding").alias("label_embedding")), 2)


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point"), F.col("label").alias("cluster"), "embedding")


MEANS = "means AS (SELECT cluster, list(m ORDER BY i) AS centre FROM (SELECT cluster, i, avg(x) AS m FROM (SELECT label AS cluster, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
DIST = "list_sum(list_transform(list_zip(embedding::DOUBLE[], centre), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


@query(f"""WITH {MEANS}, s AS (SELECT vec_id AS point, cluster, round({DIST}, 6) AS distance FROM embeddings, means) SELECT point, arg_min(cluster, distance * 1000 + cluster / 1e6) AS cluster, min(distance) AS distance FROM s GROUP BY 1""")
def nearest_centres(spark: SparkSession, d: str) -> DataFrame:
    """K1 K2: one step of k-means: means of the clusters, then the nearest mean of every point."""
    p = points(spark, d)
    return retrieval.nearest_centre(p.drop("cluster"), retrieval.cluster_means(p))


@query(f"""WITH {MEANS}, s AS (SELECT label AS cluster, vec_id AS point, round(sqrt({DIST}), 6) AS distance FROM embeddings JOIN means ON label = cluster) SELECT cluster, arg_min(point, distance * 1e6 + point / 1e6) AS point, min(distance) AS distance FROM s GROUP BY 1""")
def cluster_medoids(spark: SparkSession, d: str) -> DataFrame:
    """K3: member of each cluster closest to its mean."""
    return retrieval.medoids(points(spark, d))


@query(f"""WITH {MEANS}, s AS (SELECT label AS cluster, vec_id AS point, round(1 - list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS distance FROM embeddings JOIN means ON label = cluster)
SELECT row_number() OVER (ORDER BY point)::INT AS place, point, cluster FROM (SELECT cluster, arg_min(point, distance * 1e6 + point / 1e6) AS point FROM s GROUP BY 1)""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """K6: one representative per cluster by cosine, in temporal order."""
    return clustering.representatives(points(spark, d))


@query()
def kmeans_per_video(spark: SparkSession, d: str) -> DataFrame:
    """K1: seeded k-means of each video's windows (iterative; held against brute force in the tests)."""
    rows = windows(spark, d).where(F.col("video_id").isNotNull() & vector.usable(F.col("embedding")))
    return clustering.kmeans_per_key(rows.select(F.col("video_id").alias("key"), F.col("item").alias("point"), "embedding"), 4)


@query()
def depth_tree(spark: SparkSession, d: str) -> DataFrame:
    """K4 K5 K6: breadth clusters split by relevance into two levels with Ward's method (iterative; tested on fixtures)."""
    rows = windows(spark, d).where(F.col("video_id").isNotNull() & vector.usable(F.col("embedding")))
    return clustering.depth_expansion(clustering.kmeans_per_key(rows.select(F.col("video_id").alias("key"), F.col("item").alias("point"), "embedding"), 4), rows.select(F.col("video_id").alias("key"), F.col("item").alias("point"), "embedding"))
