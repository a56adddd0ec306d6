"""Queries on passes of questions: votes, pass@k, accuracy, rollups, selection and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import scoring, text, timeline
from framewise.operators import answers, rewards
from framewise.plans.views import BUCKET, PASS_AT_K, PASSES, QUESTIONS, passes, query, table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return answers.question_table(passes(spark, d), ["qid", "duration", "method"])


WITH = f"WITH {PASSES}, {QUESTIONS} "


@query(WITH + f"""SELECT {BUCKET} AS bucket, count(*) AS questions, round(avg({PASS_AT_K.format(k=1)}), 6) AS pass_1, round(avg({PASS_AT_K.format(k=2)}), 6) AS pass_2,
round(avg({PASS_AT_K.format(k=4)}), 6) AS pass_4, round(avg(CASE WHEN vote = gt THEN 1e0 ELSE 0e0 END), 6) AS vote_accuracy FROM questions GROUP BY 1""")
def pass_at_k_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Parse, vote, join durations, bucket, roll up."""
    q = questions(spark, d)
    k = lambda x: F.round(F.avg(scoring.pass_at_k(F.col("n"), F.col("c"), x)), 6).alias(f"pass_{x}")
    return q.groupBy(timeline.length_bucket(F.col("duration")).alias("bucket")).agg(F.count("*").alias("questions"), k(1), k(2), k(4), F.round(answers.share(F.col("vote_right")), 6).alias("vote_accuracy"))


FIXED_K = "CASE WHEN {n} - c < {k} THEN 1e0 ELSE 1e0 - list_product(list_transform(range({k}), lambda i: ({n} - c - i)::DOUBLE / ({n} - i))) END"


@query(WITH + " UNION ALL ".join(f"SELECT {k} AS k, round(avg({FIXED_K.format(n=7, k=k)}), 6) AS pass_at_k, count(*) AS questions FROM questions" for k in (1, 2, 4, 5, 7)))
def pass_at_k_report(spark: SparkSession, d: str) -> DataFrame:
    """A2: mean pass@k over all questions at the configured number of passes, that number among the k."""
    return answers.pass_at_k_report(questions(spark, d), 7).withColumn("pass_at_k", F.round("pass_at_k", 6))


@query(WITH + ", ks AS (SELECT unnest([1, 2, 4, 5, 8, 10, 16]) AS k) SELECT k, round(avg(CASE WHEN n - c < k THEN 1e0 ELSE 1e0 - list_product(list_transform(range(k), lambda i: (n - c - i)::DOUBLE / (n - i))) END), 6) AS pass_at_k, count(*) AS questions FROM questions, ks WHERE n >= k GROUP BY k")
def pass_at_k_counted(spark: SparkSession, d: str) -> DataFrame:
    """A2: mean pass@k by the passes each question has, over questions with at least k."""
    return answers.pass_at_k_report(questions(spark, d)).withColumn("pass_at_k", F.round("pass_at_k", 6))


@query(f"""WITH {PASSES}, q AS (SELECT qid, method, count(*) AS n, count(*) FILTER (WHERE parsed = gt) AS c FROM passes WHERE pass_idx <= 4 GROUP BY 1, 2),
m AS (SELECT method, round(avg(c) / 4, 6) AS average_4 FROM q GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT method, {k} AS k, round(avg({PASS_AT_K.format(k=k)}), 6) AS pass_at_k, average_4, count(*) AS num_samples FROM q JOIN m USING (method) WHERE n >= {k} GROUP BY method, average_4" for k in (1, 2, 4)))
def capped_pass_table(spark: SparkSession, d: str) -> DataFrame:
    """pass@k over the first four passes, with the number of questions of each k."""
    t = answers.capped_pass_table(passes(spark, d), ["method"], 4)
    return t.select("method", "k", F.round("pass_at_k", 6).alias("pass_at_k"), F.round("average_4", 6).alias("average_4"), "num_samples")


@query(WITH + "SELECT qid, vote, CAST(max(m) AS BIGINT) AS votes FROM questions JOIN counted USING (qid) GROUP BY 1, 2")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent answer, ties to the first seen."""
    return answers.majority_vote(passes(spark, d), ["qid"], "parsed", "pass_idx")


@query(WITH + "SELECT q.qid, vote, first - 1 AS position FROM questions q JOIN counted c ON q.qid = c.qid AND vote = parsed")
def voted_index(spark: SparkSession, d: str) -> DataFrame:
    """Place of the voted answer among the passes."""
    return answers.voted_index(passes(spark, d), ["qid"], "parsed", "pass_idx")


METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


LABELS = [name for _, name in timeline.LENGTHS]


@query(WITH + f"""SELECT label AS bucket, {", ".join(f"round(avg(CASE WHEN vote = gt THEN 1e0 ELSE 0e0 END) FILTER (WHERE method = '{m}'), 4) AS accuracy_{i}, count(*) FILTER (WHERE method = '{m}') AS questions_{i}" for i, m in enumerate(METHODS))}
FROM (SELECT unnest([{", ".join(f"'{x}'" for x in LABELS)}]) AS label) l LEFT JOIN (SELECT *, {BUCKET} AS bucket FROM questions) q ON label = bucket GROUP BY 1""")
def accuracy_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and questions by length bucket and method as a table with a row for every label."""
    rows = questions(spark, d).select(timeline.length_bucket(F.col("duration")).alias("bucket"), "method", F.col("vote_right").cast("double").alias("right"))
    aggs = {"accuracy": lambda hit: F.round(F.avg(F.when(hit, F.col("right"))), 4), "questions": F.count_if}
    return answers.pivoted(rows, "bucket", "method", METHODS, aggs, LABELS, {"questions": 0})


@query(WITH + f", b AS (SELECT method, {BUCKET} AS bucket, avg(CASE WHEN vote = gt THEN 1e0 ELSE 0e0 END) AS a, count(*) AS n FROM questions GROUP BY 1, 2) SELECT method, round(sum(a * n) / sum(n), 6) AS weighted, CAST(sum(n) AS BIGINT) AS weight FROM b GROUP BY 1")
def weighted_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A10: accuracy of buckets weighted by their size."""
    b = questions(spark, d).groupBy("method", timeline.length_bucket(F.col("duration")).alias("bucket")).agg(answers.share(F.col("vote_right")).alias("a"), F.count("*").alias("n"))
    return answers.weighted_rollup(b, "method", "a", "n").withColumn("weighted", F.round("weighted", 6))


@query(f"WITH {PASSES} SELECT method, {BUCKET} AS bucket, round(avg(turns), 6) AS mean_turns, median(turns::DOUBLE) AS median_turns, count(*) AS n, CAST(sum(turns) AS BIGINT) AS frames FROM passes GROUP BY 1, 2")
def method_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median, count and sum by method and bucket."""
    return passes(spark, d).groupBy("method", timeline.length_bucket(F.col("duration")).alias("bucket")).agg(F.round(F.avg("turns"), 6).alias("mean_turns"), F.median(F.col("turns").cast("double")).alias("median_turns"), F.count("*").alias("n"), F.sum("turns").cast("long").alias("frames"))


@query(f"""WITH {PASSES}, p AS (SELECT CASE WHEN pass_idx % 7 = 0 THEN '' WHEN pass_idx % 5 = 0 THEN parsed || ' b' ELSE parsed END AS pred, gt, coalesce(parsed = gt AND pass_idx % 3 <> 0, false) AS correct FROM passes),
w AS (SELECT CASE WHEN pred = '' THEN 'no_answer_extracted' WHEN pred IS DISTINCT FROM gt THEN 'wrong_answer' ELSE 'other' END AS kind FROM p WHERE NOT correct)
SELECT kind, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM w), 6)::DOUBLE AS percent FROM w GROUP BY 1""")
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the answers not marked right, with their share."""
    turn = F.col("pass_idx")
    pred = F.when(turn % 7 == 0, "").when(turn % 5 == 0, F.concat("parsed", F.lit(" b"))).otherwise(F.col("parsed"))
    right = (F.col("parsed") == F.col("gt")) & (turn % 3 != 0)
    return answers.error_taxonomy(passes(spark, d), pred, F.col("gt"), right).withColumn("percent", F.round("percent", 6))


@query(f"""WITH {PASSES}, g AS (SELECT video, count(DISTINCT parsed || turns::VARCHAR) / count(*) AS dv FROM passes GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS groups, round(avg(dv), 6) AS mean, round(min(dv), 6) AS least, round(max(dv), 6) AS most FROM g""")
def response_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Distinct responses per video."""
    rows = passes(spark, d).withColumn("r", F.concat("parsed", F.col("turns").cast("string")))
    return answers.response_diversity(rows, "video", "r").select("groups", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most")])


@query(WITH + "SELECT CAST(sum(n) AS BIGINT) AS responses, CAST(sum(c) AS BIGINT) AS correct, count(*) AS questions, count(*) FILTER (WHERE c > 0) AS solved, count(*) FILTER (WHERE c = 0) AS unsolved, round(count(*) FILTER (WHERE c > 0) / count(*), 6) AS success FROM questions")
def generation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals of generated responses and solved questions."""
    solved = F.col("c") > 0
    return questions(spark, d).agg(F.sum("n").alias("responses"), F.sum("c").alias("correct"), F.count("*").alias("questions"), F.count_if(solved).alias("solved"), F.count_if(~solved).alias("unsolved"), F.round(answers.share(solved), 6).alias("success"))


@query(f"WITH {PASSES} SELECT count(*) AS total, count(*) FILTER (WHERE parsed = gt) AS correct, round(avg(CASE WHEN parsed = gt THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(turns), 6) AS mean_turns, count(DISTINCT video) AS videos, round(count(*) / count(DISTINCT video), 6) AS per_video FROM passes")
def basic_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts, accuracy and rows per video in one pass."""
    right = F.col("parsed") == F.col("gt")
    return passes(spark, d).agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.round(answers.share(right), 6).alias("accuracy"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.count_distinct("video").alias("videos"), F.round(F.try_divide(F.count("*"), F.count_distinct("video")), 6).alias("per_video"))


@query(f"WITH {PASSES} SELECT turns, count(*) AS n FROM passes GROUP BY 1 ORDER BY n DESC, turns LIMIT 10")
def top_turn_histogram(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent turn counts."""
    return answers.count_shares(passes(spark, d), F.col("turns"), "turns", 10)


@query(f"WITH {PASSES} SELECT method, parsed, gt, count(*) AS n FROM passes GROUP BY 1, 2, 3")
def answer_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Answers against the truth."""
    return passes(spark, d).groupBy("method", "parsed", "gt").agg(F.count("*").alias("n"))


@query(f"WITH {PASSES}, q AS (SELECT qid, sum(latency) AS total FROM passes GROUP BY 1) SELECT round((SELECT avg(total) FROM q), 4) AS question_latency, round((SELECT avg(latency) FROM passes), 4) AS pass_latency")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean latency of a question and of a pass."""
    q = passes(spark, d).groupBy("qid").agg(F.sum("latency").alias("total"), F.count("*").alias("n"))
    return q.agg(F.round(F.avg("total"), 4).alias("question_latency"), F.round(F.sum("total") / F.sum("n"), 4).alias("pass_latency"))


RUNS = "runs AS (SELECT qid AS uid, CAST(pass_idx AS INTEGER) AS run, CASE WHEN turns % 9 = 0 THEN -1 ELSE ascii(parsed) END AS pred, ascii(gt) AS truth FROM passes WHERE pass_idx <= 4)"


@query(f"""WITH {PASSES}, {RUNS}, p AS (SELECT uid, arg_min(truth, run) AS truth, {', '.join(f'coalesce(max(pred) FILTER (WHERE run = {i}), -1) AS p{i}' for i in range(1, 5))} FROM runs GROUP BY 1)
SELECT uid, truth, concat_ws(',', p1, p2, p3, p4) AS preds,
 concat_ws(',', CASE WHEN p1 <> -1 THEN 1 END, CASE WHEN p2 <> -1 THEN 2 END, CASE WHEN p3 <> -1 THEN 3 END, CASE WHEN p4 <> -1 THEN 4 END) AS valid,
 truth IN (p1, p2, p3, p4) AS pass_at_k_correct, CASE WHEN truth IN (p1, p2, p3, p4) THEN truth ELSE p1 END AS pred FROM p""")
def any_right_runs(spark: SparkSession, d: str) -> DataFrame:
    """Merge of runs, right if any run is."""
    rows = passes(spark, d).where("pass_idx <= 4").select(F.col("qid").alias("uid"), F.col("pass_idx").cast("int").alias("run"), F.when(F.col("turns") % 9 == 0, -1).otherwise(F.ascii("parsed")).alias("pred"), F.ascii("gt").alias("truth"))
    return answers.any_right_runs(rows, 4).select("uid", "truth", F.array_join(F.col("preds").cast("array<string>"), ",").alias("preds"), F.array_join(F.col("valid").cast("array<string>"), ",").alias("valid"), "pass_at_k_correct", "pred")


@query("SELECT o_orderkey AS qid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that have no result yet."""
    return answers.resume(table(spark, d, "orders").select(F.col("o_orderkey").alias("qid")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid")), "qid")


@query("SELECT m.o_orderkey AS uid, CASE WHEN m.o_orderkey % 4 = 0 THEN CASE WHEN b.qid IS NULL THEN -1 ELSE b.pred END ELSE m.o_orderkey % 5 END AS pred FROM orders m LEFT JOIN (SELECT l_orderkey AS qid, min(l_linenumber) AS pred FROM lineitem GROUP BY 1) b ON m.o_orderkey = b.qid")
def backup_fill(spark: SparkSession, d: str) -> DataFrame:
    """Failed predictions from a backup run."""
    main = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(-1)).otherwise(F.col("o_orderkey") % 5).cast("long").alias("pred"))
    backup = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.min("l_linenumber").cast("long").alias("pred"))
    return answers.filled_from_backup(main, backup, "uid")


CONTRAST = f"""WITH {PASSES}, a AS (SELECT qid AS video, parsed = gt AS correct FROM passes WHERE pass_idx = 1),
b AS (SELECT qid AS video, parsed = gt AS correct, turns, method AS dataset FROM passes WHERE pass_idx > 1),
one AS (SELECT video FROM a GROUP BY 1 HAVING count(*) = 1 AND NOT bool_or(correct))
SELECT video, max(turns) AS max_turn, round(avg(turns), 6) AS avg_turn, count(*) AS correct_count, min(dataset) AS dataset FROM b WHERE correct AND turns >= 6 AND video IN (SELECT video FROM one) GROUP BY 1"""


@query(CONTRAST)
def contrast_mining(spark: SparkSession, d: str) -> DataFrame:
    """Items one model (the first pass) fails and another (the later ones) solves in many turns."""
    right = (F.col("parsed") == F.col("gt")).alias("correct")
    p = passes(spark, d)
    a = p.where("pass_idx = 1").select(F.col("qid").alias("video"), right)
    b = p.where("pass_idx > 1").select(F.col("qid").alias("video"), right, "turns", F.col("method").alias("dataset"))
    return answers.contrast(a, b, 6, F.col("dataset")).withColumn("avg_turn", F.round("avg_turn", 6))


@query(f"WITH {PASSES}, a AS (SELECT qid, parsed = gt AS correct FROM passes WHERE pass_idx = 1), b AS (SELECT qid, parsed = gt AS correct FROM passes WHERE pass_idx = 2) SELECT a.qid, b.correct AS other_right FROM a JOIN b ON a.qid = b.qid WHERE NOT a.correct")
def right_wrong_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Questions model A gets wrong, with model B's result."""
    p = passes(spark, d).select("qid", "pass_idx", (F.col("parsed") == F.col("gt")).alias("correct"))
    return answers.right_and_wrong(p.where("pass_idx = 1"), p.where("pass_idx = 2"), "qid")


@query(f"WITH {PASSES} SELECT qid, min(pass_idx) AS pass_idx FROM passes WHERE parsed = gt GROUP BY 1")
def best_of_n_first(spark: SparkSession, d: str) -> DataFrame:
    """First right response."""
    return answers.best_of_n(passes(spark, d).withColumn("right", F.col("parsed") == F.col("gt")), "qid", "pass_idx", "right").select("qid", "pass_idx")


@query(f"WITH {PASSES} SELECT qid, pass_idx, row_number() OVER (PARTITION BY qid ORDER BY pass_idx) AS rank FROM passes WHERE parsed = gt")
def best_of_n_all(spark: SparkSession, d: str) -> DataFrame:
    """All right responses with their rank."""
    return answers.best_of_n(passes(spark, d).withColumn("right", F.col("parsed") == F.col("gt")), "qid", "pass_idx", "right", "all_correct").select("qid", "pass_idx", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PASSES} SELECT qid, min(pass_idx) FILTER (WHERE parsed = gt) AS chosen, max(pass_idx) FILTER (WHERE parsed <> gt) AS rejected FROM passes GROUP BY 1 HAVING bool_or(parsed = gt) AND bool_or(parsed <> gt)")
def best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    """First right and last wrong response."""
    return answers.best_of_n(passes(spark, d).withColumn("right", F.col("parsed") == F.col("gt")), "qid", "pass_idx", "right", "best_and_worst")


@query("""WITH r AS (SELECT CASE p_type WHEN 'PROMO' THEN 'LARGE' ELSE p_type END AS kind, CASE WHEN p_size % 3 = 0 THEN 1e0 ELSE 0e0 END AS r FROM part)
SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(substr(kind, 1, 1)) = 0 THEN 'letter' ELSE 'all' END AS level, coalesce(kind, substr(kind, 1, 1), 'Acc') AS name, round(avg(r) * 100, 6) AS accuracy, count(*) AS n
FROM r GROUP BY GROUPING SETS ((kind), (substr(kind, 1, 1)), ())""")
def grouped_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by kind, first letter and overall, one kind folded into another."""
    return answers.grouped_accuracy(table(spark, d, "part"), "p_type", F.col("p_size") % 3 == 0, {"PROMO": "LARGE"}).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH r AS (SELECT unnest([p_size % 5 + 1, p_partkey % 5 + 1]) AS category, CASE WHEN p_size % 7 = 0 THEN 0.2e0 WHEN p_size % 3 = p_partkey % 3 THEN 1e0 ELSE 0e0 END AS s FROM part)
SELECT coalesce(category::VARCHAR, 'all') AS category, round(avg(s), 6) AS accuracy, count(*) AS n FROM r GROUP BY ROLLUP (category)""")
def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per label, failed decodes earning a fifth."""
    rows = table(spark, d, "part").select(F.array(F.col("p_size") % 5 + 1, F.col("p_partkey") % 5 + 1).alias("cats"), F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size") % 3).alias("pred"), (F.col("p_partkey") % 3).alias("truth"))
    return answers.category_accuracy(rows, "cats", F.col("pred"), F.col("truth")).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_size % 7 <> 0) AS valid, count(*) FILTER (WHERE p_size % 7 <> 0 AND p_size % 3 = p_partkey % 3) AS correct, round(count(*) FILTER (WHERE p_size % 7 <> 0 AND p_size % 3 = p_partkey % 3) / count(*), 6) AS accuracy FROM part")
def qa_stat(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy over all rows, failed decodes included."""
    valid = F.col("p_size") % 7 != 0
    right = valid & (F.col("p_size") % 3 == F.col("p_partkey") % 3)
    return table(spark, d, "part").agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(right).alias("correct"), F.round(answers.share(right), 6).alias("accuracy"))


SPANS = "spans AS (SELECT l_orderkey AS qid, l_quantity AS rs, l_quantity + l_linenumber * 3 AS re, o_orderkey % 37 * 1e0 AS ps, o_orderkey % 37 + o_orderkey % 9 * 1e0 AS pe, o_orderkey % 2 = 0 AS qa FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""WITH {SPANS}, o AS (SELECT qid, qa, CASE WHEN ps = pe THEN 0e0 ELSE (least(re, pe) - greatest(rs, ps)) / (greatest(re, pe) - least(rs, ps)) END AS iou,
CASE WHEN ps = pe THEN CASE WHEN ps BETWEEN rs AND re THEN 1e0 ELSE 0e0 END ELSE (least(re, pe) - greatest(rs, ps)) / (pe - ps) END AS iop FROM spans),
b AS (SELECT qid, bool_or(qa) AS qa, greatest(max(iou), 0) AS iou, greatest(max(iop), 0) AS iop FROM o GROUP BY 1)
SELECT round(avg(iou) * 100, 6) AS miou, round(avg(iop) * 100, 6) AS miop, round(avg((iou >= 0.3)::INT) * 100, 6) AS iou_03, round(avg((iou >= 0.5)::INT) * 100, 6) AS iou_05,
round(avg((iop >= 0.3)::INT) * 100, 6) AS iop_03, round(avg((iop >= 0.5)::INT) * 100, 6) AS iop_05, round(avg((iop >= 0.5 AND qa)::INT) * 100, 6) AS acc_gqa FROM b""")
def grounding_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Temporal grounding of predicted spans."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = (F.col("o_orderkey") % 37).cast("double")
    rows = j.select(F.col("l_orderkey").alias("qid"), F.col("l_quantity").alias("rs"), (F.col("l_quantity") + F.col("l_linenumber") * 3).alias("re"), start.alias("ps"), (start + F.col("o_orderkey") % 9).alias("pe"), (F.col("o_orderkey") % 2 == 0).alias("qa"))
    out = answers.grounding(rows, "qid", ("rs", "re"), ("ps", "pe"), "qa")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {SPANS}, m AS (SELECT qid, max(ps) AS rs, max(pe) + 1 AS re, sum(greatest(0, least(re, pe + 1) - greatest(rs, ps))) AS shared, sum(re - rs) AS len FROM spans GROUP BY 1, ps, pe)
SELECT qid, round(shared / (re - rs + len - shared), 6) AS iou, round(shared / len, 6) AS iop FROM m""")
def multi_span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Several predicted spans against one reference."""
    start = (F.col("l_orderkey") % 37).cast("double")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_agg(F.struct(F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber") * 3).alias("end"))).alias("spans"))
    o = scoring.multi_span_overlap(start, start + F.col("l_orderkey") % 9 + 1, F.col("spans"))
    return g.select(F.col("l_orderkey").alias("qid"), o.alias("o")).select("qid", F.round("o.iou", 6).alias("iou"), F.round("o.iop", 6).alias("iop"))


JUDGED = "j AS (SELECT p_partkey % 3 AS a, p_size % 3 AS b, (p_partkey + p_size) % 3 AS c, CASE p_size % 4 WHEN 0 THEN ' Correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'odd' END AS verdict, p_size % 5 = 0 AS revise FROM part), n AS (SELECT *, a + b + c AS total, CASE WHEN lower(trim(verdict)) IN ('correct', 'partially_correct', 'incorrect') THEN lower(trim(verdict)) WHEN a + b + c = 6 THEN 'correct' WHEN a + b + c >= 3 THEN 'partially_correct' ELSE 'incorrect' END AS v FROM j)"


@query(f"WITH {JUDGED} SELECT v AS verdict, count(*) AS n, round(avg(a), 4) AS inclusion, round(avg(b), 4) AS temporal, round(avg(c), 4) AS operators, round(avg(total), 4) AS overall, round(avg((v <> 'correct' AND revise)::INT), 4) AS revision_rate FROM n GROUP BY 1")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Normalised judge records, summed up by verdict."""
    verdict = F.when(F.col("p_size") % 4 == 0, " Correct").when(F.col("p_size") % 4 == 1, "incorrect").when(F.col("p_size") % 4 == 2, "odd")
    raw = F.struct((F.col("p_partkey") % 3).cast("string").alias("inclusion"), (F.col("p_size") % 3).cast("string").alias("temporal_alignment"), ((F.col("p_partkey") + F.col("p_size")) % 3).cast("string").alias("operator_correctness"), verdict.alias("verdict"), (F.col("p_size") % 5 == 0).cast("string").alias("needs_revision"))
    j = table(spark, d, "part").select(raw.alias("raw")).select(scoring.judge_record(F.col("raw")).alias("j")).select("j.*")
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return j.groupBy("verdict").agg(F.count("*").alias("n"), mean("inclusion", "inclusion"), mean("temporal_alignment", "temporal"), mean("operator_correctness", "operators"), mean("overall_score", "overall"), mean(F.col("needs_revision").cast("int"), "revision_rate"))


@query("""WITH c AS (SELECT p_partkey AS id, p_size % 2 = 0 AS asked, p_size % 5 <> 0 AND p_type <> 'PROMO' AS valid, p_size AS new, p_partkey % 50 AS old, p_type, p_brand FROM part)
SELECT id, asked AND valid AS first_revised, CASE WHEN asked AND NOT valid THEN 'invalid revision' END AS error, CASE WHEN asked AND valid THEN p_brand ELSE 'first' END AS first_kept,
asked AND valid AND new > old AS second_revised, CASE WHEN asked AND valid AND new > old THEN p_type ELSE 'first' END AS second_kept FROM c""")
def revision_selection(spark: SparkSession, d: str) -> DataFrame:
    """A valid revision is taken; in a second step only if strictly better."""
    part = lambda proposition, text: F.struct(proposition.alias("proposition"), text.alias("specification"))
    first = part(F.array(F.lit("x")), F.lit("first"))
    said = F.when(F.col("p_size") % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(""), "p_brand"))
    text = lambda c: F.when(F.col("p_type") == "PROMO", " ").otherwise(F.col(c))
    asked = F.col("p_size") % 2 == 0
    one = answers.revised(first, asked, part(said, text("p_brand")))
    two = answers.revised(first, asked, part(said, text("p_type")), F.col("p_partkey") % 50, F.col("p_size"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), one.alias("a"), two.alias("b"))
    return rows.select("id", F.col("a.revised").alias("first_revised"), "a.error", F.col("a.kept.specification").alias("first_kept"), F.col("b.revised").alias("second_revised"), F.col("b.kept.specification").alias("second_kept"))


@query("""WITH k AS (SELECT *, -(ln(1 / ((0.78 - 0.01) / 0.98) - 1)) / ((0.60 - 0.40) / 0.55 - 0.30) * 0.7 AS k FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity / 50)::DOUBLE AS c FROM lineitem)),
t AS (SELECT *, (0.60 - 0.40) / 0.55 + ln(1 / ((0.78 - 0.01) / 0.98) - 1) / k AS t FROM k),
s AS (SELECT *, 1 / (1 + exp(-k * ((c - 0.4) / 0.55 - t))) AS y, 1 / (1 + exp(k * t)) AS y0, 1 / (1 + exp(-k * (1 - t))) AS y1 FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN c <= 0.4 THEN 0.01 WHEN c >= 0.95 THEN 0.99 ELSE 0.01 + (y - y0) / (y1 - y0) * 0.98 END, 6)::DOUBLE AS p FROM s""")
def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    """M3: confidence to probability."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(scoring.calibrate(F.col("l_quantity") / 50), 6).alias("p"))


@query("SELECT event_id, round(exp(-value / 100) / (exp(-value / 100) + exp(-(event_id % 7) / 2e0)), 3) AS p FROM events")
def yes_probability(spark: SparkSession, d: str) -> DataFrame:
    """M4: probability of yes from two log probabilities."""
    return table(spark, d, "events").select("event_id", scoring.yes_probability(-F.col("value") / 100, -(F.col("event_id") % 7) / F.lit(2.0)).alias("p"))


RESPONSES = """responses AS (SELECT l_orderkey AS qid, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
 CASE WHEN l_linenumber % 6 = 0 THEN 'no tag ' || l_returnflag ELSE '<think>x</think><answer> The ' || l_returnflag || '!</answer>' || repeat('<answer>an ' || l_linestatus || '</answer>', CASE WHEN l_linenumber % 5 = 0 THEN 11 ELSE l_linenumber % 3 END) END AS response FROM lineitem),
golds AS (SELECT o_orderkey, ['A' || lower(o_orderstatus), o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END] AS golds FROM orders)"""
NORM = "trim(regexp_replace(regexp_replace(translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
SCORED = f"""WITH {RESPONSES}, s AS (SELECT qid, line, part, supp, response, golds, list_extract(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1), -1) AS answer, len(regexp_extract_all(response, '<answer>')) AS opened FROM responses JOIN golds ON qid = o_orderkey),
e AS (SELECT *, len(list_filter(golds, lambda g: {NORM.format(x='g')} = {NORM.format(x='answer')})) > 0 AS hit, len(list_filter(golds, lambda g: contains({NORM.format(x='answer')}, {NORM.format(x='g')}))) > 0 AS part_hit FROM s)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    body = F.concat(F.lit("<think>x</think><answer> The "), "l_returnflag", F.lit("!</answer>"), F.expr("repeat(concat('<answer>an ', l_linestatus, '</answer>'), case when l_linenumber % 5 = 0 then 11 else l_linenumber % 3 end)"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), line.alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_quantity", F.when(line % 6 == 0, F.concat(F.lit("no tag "), "l_returnflag")).otherwise(body).alias("response"))
    status = F.col("o_orderstatus")
    golds = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.array(F.concat(F.lit("A"), F.lower(status)), status, F.when(status == "F", "A").when(status == "O", "N").otherwise("R")).alias("golds"))
    return lines.join(golds.withColumn("golds", rewards.normalized(F.col("golds"))), "qid")


@query(SCORED + " SELECT qid, line, part, supp, CASE WHEN answer IS NULL OR NOT hit THEN 0e0 WHEN opened > 10 THEN 0.25e0 ELSE 1e0 END AS score FROM e")
def exact_match_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Exact-match reward."""
    return rewards.exact_match(responses(spark, d), normal=True).select("qid", "line", "part", "supp", "score")


@query(SCORED + " SELECT qid, line, part, supp, CASE WHEN answer IS NULL OR NOT part_hit THEN 0e0 ELSE 1e0 END AS score FROM e")
def sub_match_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Substring reward, else the format score of a valid sequence."""
    return rewards.sub_match(responses(spark, d), normal=True).select("qid", "line", "part", "supp", "score")


@query(SCORED + """, r AS (SELECT l_orderkey AS qid, count(*) FILTER (WHERE k <> 'summary' AND v > 0.15) + 0.5 * count(*) FILTER (WHERE k = 'summary') AS num, count(*) AS den
 FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN 'summary' ELSE 'p' || (l_partkey % 3) END AS k, max(l_quantity / 100) AS v FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2) GROUP BY 1)
SELECT e.qid, line, part, supp, round(CASE WHEN answer IS NULL THEN 0e0 WHEN den IS NULL THEN em ELSE (num / den * 0.5 + em) / 1.5 END, 6)::DOUBLE AS score
FROM (SELECT *, CASE WHEN NOT hit THEN 0e0 WHEN opened > 10 THEN 0.25e0 ELSE 1e0 END AS em FROM e) e LEFT JOIN r ON e.qid = r.qid""")
def proposition_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Proposition reward merged over tool calls, mixed with exact match."""
    key = F.when(F.col("l_linenumber") % 4 == 0, "summary").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")))
    tools = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("qid"), key.alias("key"), (F.col("l_quantity") / 100).alias("value"))
    return rewards.mixed(responses(spark, d), tools, "qid", "key", "value", normal=True).select("qid", "line", "part", "supp", F.round("score", 6).alias("score"))


@query("""WITH w AS (SELECT doc_id, len(string_split(replace(replace(replace(text, '.', ' '), ',', ' '), chr(10), ' '), ' ')) AS n FROM documents WHERE text IS NOT NULL)
SELECT min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, round(stddev_samp(n), 4) AS std FROM w""")
def word_count_summary(spark: SparkSession, d: str) -> DataFrame:
    """Word counts of texts."""
    n = F.size(F.split(F.translate("text", ".,\n", "   "), " ")).cast("long")
    return table(spark, d, "documents").where("text is not null").select(n.alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_samp("n"), 4).alias("std"))


@query(f"""WITH {PASSES}, q AS (SELECT qid, method, max(turns) AS most, round(avg(turns), 2) AS mean, (max(turns) / 2e0 - 1) * 16 AS frames FROM passes GROUP BY 1, 2)
SELECT method, count(*) AS questions, round(avg(frames), 4) AS mean_frames, median(frames) AS median_frames, round(avg(mean), 4) AS mean_turns FROM q GROUP BY 1""")
def frame_usage(spark: SparkSession, d: str) -> DataFrame:
    """Frames used by question from the number of turns."""
    q = passes(spark, d).groupBy("qid", "method").agg(F.max("turns").alias("most"), F.round(F.avg("turns"), 2).alias("mean"))
    frames = (F.col("most") / 2 - 1) * 16
    return q.groupBy("method").agg(F.count("*").alias("questions"), F.round(F.avg(frames), 4).alias("mean_frames"), F.median(frames).alias("median_frames"), F.round(F.avg("mean"), 4).alias("mean_turns"))


@query(WITH + ", f AS (SELECT qid, max(parsed = gt AND pass_idx = 1) AS one, max(parsed = gt AND pass_idx <= 4) AS four, sum(turns) AS frames FROM passes GROUP BY 1) SELECT method, round(avg(one::INT), 6) AS pass_1, round(avg(four::INT), 6) AS pass_4, round(avg((vote = gt)::INT), 6) AS majority, CAST(sum(frames) AS BIGINT) AS frames, round(avg(frames), 6) AS mean_frames FROM questions JOIN f USING (qid) GROUP BY 1")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """pass@1, pass@4, majority and frames per dataset."""
    p = passes(spark, d)
    right = F.col("parsed") == F.col("gt")
    f = p.groupBy("qid").agg(F.max((right & (F.col("pass_idx") == 1)).cast("int")).alias("one"), F.max((right & (F.col("pass_idx") <= 4)).cast("int")).alias("four"), F.sum("turns").alias("frames"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return questions(spark, d).join(f, "qid").groupBy("method").agg(mean("one", "pass_1"), mean("four", "pass_4"), mean(F.col("vote_right").cast("int"), "majority"), F.sum("frames").alias("frames"), mean("frames", "mean_frames"))


@query(WITH + """, v AS (SELECT method, CASE WHEN qid % 2 = 0 THEN lower(vote) ELSE vote END AS vote, CASE WHEN qid % 9 = 0 THEN '' ELSE gt END AS gt, qid % 13 = 0 AS failed FROM questions)
SELECT method, count(*) FILTER (WHERE upper(vote) = upper(gt)) AS correct, count(*) AS valid, round(avg((upper(vote) = upper(gt))::INT), 6) AS accuracy FROM v WHERE gt <> '' AND NOT failed GROUP BY 1""")
def case_insensitive_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of votes in any case, over questions with a truth and without an error."""
    q = F.col("qid")
    rows = questions(spark, d).select("qid", "method", F.when(q % 2 == 0, F.lower("vote")).otherwise(F.col("vote")).alias("vote"), F.when(q % 9 == 0, "").otherwise(F.col("gt")).alias("gt"))
    return answers.caseless_accuracy(rows, failed=q % 13 == 0, keys=["method"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT count(*) AS total, count(v.video_id) AS matched, round(count(v.video_id) / count(*), 6) AS coverage FROM data_input i LEFT JOIN (SELECT DISTINCT video_id FROM video_info) v ON i.video_id = v.video_id")
def duration_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows whose video has a duration."""
    v = table(spark, d, "video_info").select("video_id").distinct().withColumn("known", F.lit(1))
    j = table(spark, d, "data_input").select("video_id").join(v, "video_id", "left")
    return j.agg(F.count("*").alias("total"), F.count("known").alias("matched"), F.round(F.try_divide(F.count("known"), F.count("*")), 6).alias("coverage"))
