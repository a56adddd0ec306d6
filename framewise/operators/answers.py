"""Operators on passes of questions: votes, pass@k, accuracy, rollups, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewise.functions.scoring import pass_at_k, span_overlap

KS = (1, 2, 4, 5, 8, 10, 16)


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def majority_vote(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``keys``, ``vote``, ``votes``: the most frequent non-empty value, ties to the first seen; "" where there is none."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    real = F.col(value).isNotNull() & (F.trim(value) != "")
    return counted.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(real, F.col(value)), F.when(real, F.struct("n", -F.col("first")))), F.lit("")).alias("vote"),
        F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("votes"),
    )


def question_table(passes: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """One row a question: passes ``n``, right ones ``c``, vote and whether it is right.

    ``passes`` has pass_idx (from 1), parsed and gt; a null gt is never right.
    """
    if cap:
        passes = passes.where(F.col("pass_idx") <= cap)
    right = F.coalesce(F.col("parsed") == F.col("gt"), F.lit(False))
    counted = passes.groupBy(*keys, "parsed").agg(F.count("*").alias("m"), F.min("pass_idx").alias("first"), F.count_if(right).alias("hits"), F.max("gt").alias("gt"))
    real = F.col("parsed").isNotNull() & (F.trim("parsed") != "")
    out = counted.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum("hits").alias("c"), F.max("gt").alias("gt"), F.coalesce(F.max_by(F.when(real, F.col("parsed")), F.when(real, F.struct("m", -F.col("first")))), F.lit("")).alias("vote"))
    return out.withColumn("vote_right", F.coalesce(F.col("vote") == F.col("gt"), F.lit(False)))


def pass_at_k_report(questions: DataFrame, n_passes: int | None = None, keys: list[str] | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """Mean pass@k, one row a k.

    With ``n_passes`` every question counts with so many passes, whatever it has: ``ks`` up to it and itself, the mean
    over all rows, null where there are none.  Without, a question counts with its own passes ``n``, in every k it
    reaches.
    """
    keys = keys or []
    if n_passes is None:
        rows = questions.select(*keys, "n", "c", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("n >= k")
        return rows.groupBy(*keys, "k").agg(F.avg(pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("pass_at_k"), F.count("*").alias("questions"))
    wanted = sorted({k for k in ks if k <= n_passes} | ({n_passes} if n_passes > 1 else set()))
    means = questions.groupBy(*keys).agg(*[F.avg(pass_at_k(F.lit(n_passes), F.col("c"), k)).alias(f"_{k}") for k in wanted], F.count("*").alias("questions"))
    return means.select(*keys, "questions", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("pass_at_k")) for k in wanted]))).select(*keys, "k", "pass_at_k", "questions")


def capped_pass_table(passes: DataFrame, keys: list[str], cap: int = 4, ks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """A row a k that any question reaches, over the first ``cap`` passes: mean pass@k and number of the questions with k
    passes or more, and the mean of right passes over ``cap`` of all questions."""
    q = question_table(passes, ["qid", *keys], cap)
    n, c = F.col("n"), F.col("c")
    per_k = [F.struct(F.lit(k).alias("k"), F.avg(F.when(n >= k, pass_at_k(n, c, k))).alias("pass_at_k"), F.count_if(n >= k).alias("num_samples")) for k in ks]
    rows = q.groupBy(*keys).agg(F.array(*per_k).alias("_k"), (F.avg(c) / F.lit(float(cap))).alias(f"average_{cap}"))
    return rows.select(*keys, f"average_{cap}", F.inline("_k")).where("num_samples > 0").select(*keys, "k", "pass_at_k", f"average_{cap}", "num_samples")


def voted_index(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """First position (from 0) of the voted value in each question's sequence."""
    votes = majority_vote(df, keys, value, order)
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("first"))
    return votes.join(firsts, (F.col("vote") == F.col(value)) & _same(votes, firsts, keys)).select(*[votes[k] for k in keys], "vote", (F.col("first") - 1).alias("position"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def pivoted(df: DataFrame, row: str, column: str, values: list[str], aggs: dict[str, Column], labels: list[str] | None = None, fill: dict[str, float] | None = None) -> DataFrame:
    """Pivot with a fixed list of columns, so the plan needs no extra pass over the data; columns ``name_i`` for value i.

    With ``labels`` the rows are exactly these, in any data; ``fill`` gives the value of empty cells by name.
    """
    out = df.groupBy(row).agg(*[agg(F.col(column) == v).alias(f"{name}_{i}") for name, agg in aggs.items() for i, v in enumerate(values)])
    if labels is not None:
        out = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(row)).join(out, row, "left")
    for name, value in (fill or {}).items():
        out = out.fillna(value, [f"{name}_{i}" for i in range(len(values))])
    return out


def weighted_rollup(df: DataFrame, key: str, mean: str, weight: str) -> DataFrame:
    return df.groupBy(key).agg((F.sum(F.col(mean) * F.col(weight)) / F.sum(weight)).alias("weighted"), F.sum(weight).alias("weight"))


def error_taxonomy(df: DataFrame, pred: Column, truth: Column, right: Column) -> DataFrame:
    """Kinds of the rows not marked right, with their share: no prediction, one that differs from the truth, the rest."""
    kind = F.when(pred == "", "no_answer_extracted").when(~pred.eqNullSafe(truth), "wrong_answer").otherwise("other")
    counted = df.where(~F.coalesce(right, F.lit(False))).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("kind", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def caseless_accuracy(votes: DataFrame, vote: str = "vote", truth: str = "gt", failed: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Accuracy of votes without regard to case, over rows with a truth and without an error: correct, valid, accuracy."""
    valid = F.col(truth).isNotNull() & (F.col(truth) != "") & ~(F.lit(False) if failed is None else F.coalesce(failed, F.lit(False)))
    right = F.upper(F.coalesce(F.col(vote), F.lit(""))) == F.upper(F.col(truth))
    return votes.where(valid).groupBy(*(keys or [])).agg(F.count_if(right).alias("correct"), F.count("*").alias("valid"), share(right).alias("accuracy"))


def revised(first: Column, needs: Column, candidate: Column, score: Column | None = None, candidate_score: Column | None = None) -> Column:
    """(kept, revised, error) of a specification (struct of proposition, an array, and specification, a text) and its revision.

    A revision is taken if it is asked for and says something in both parts; with scores it must also be strictly
    better.  One that is asked for and says nothing is an error.
    """
    said = F.filter(candidate["proposition"], lambda p: F.trim(p) != "")
    valid = (F.coalesce(F.size(said), F.lit(0)) > 0) & (F.coalesce(F.trim(candidate["specification"]), F.lit("")) != "")
    asked = F.coalesce(needs, F.lit(False))
    better = F.lit(True) if score is None else F.coalesce(candidate_score > score, F.lit(False))
    take = asked & F.coalesce(valid, F.lit(False)) & better
    return F.struct(F.when(take, candidate).otherwise(first).alias("kept"), take.alias("revised"), F.when(asked & ~F.coalesce(valid, F.lit(False)), "invalid revision").alias("error"))


def response_diversity(df: DataFrame, key: str, response: str) -> DataFrame:
    """Distinct over all responses of keys with more than one, as count, mean, least and most."""
    per = df.groupBy(key).agg((F.count_distinct(response) / F.count(response)).alias("d"), F.count(response).alias("n")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"))


def any_right_runs(runs: DataFrame, n: int) -> DataFrame:
    """Full outer merge of ``n`` runs (uid, run from 1, pred, truth); missing predictions are -1.

    Keeps 1-based lists of valid and right runs; ``pred`` is the truth if any run is right, else the first run's.  Of a
    run repeated for a uid the largest prediction counts.
    """
    runs = runs.groupBy("uid", "run").agg(F.max("pred").alias("pred"), F.min("truth").alias("truth"))
    per = runs.groupBy("uid").agg(F.map_from_entries(F.array_agg(F.struct("run", "pred"))).alias("m"), F.min_by("truth", "run").alias("truth"))
    preds = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(-1)))
    return (
        per.withColumn("preds", preds)
        .withColumn("valid", F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at("preds", i) != -1))
        .withColumn("right", F.filter(F.col("valid"), lambda i: F.element_at("preds", i) == F.col("truth")))
        .select("uid", "truth", "preds", "valid", "right", (F.size("right") > 0).alias("pass_at_k_correct"), F.when(F.size("right") > 0, F.col("truth")).otherwise(F.col("preds")[0]).alias("pred"))
    )


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def filled_from_backup(main: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """``pred`` of the backup where the main run failed (-1)."""
    other = backup.select(key, F.col("pred").alias("backup_pred"))
    return main.join(other, key, "left").withColumn("pred", F.when(F.col("pred") == -1, F.coalesce("backup_pred", "pred")).otherwise(F.col("pred"))).drop("backup_pred")


def contrast(a: DataFrame, b: DataFrame, least_turns: int, priority: Column) -> DataFrame:
    """Videos where model A has one row and it is wrong, while model B is right in at least ``least_turns`` turns; ordered."""
    only = a.groupBy("video").agg(F.count("*").alias("n"), F.max(F.col("correct").cast("int")).alias("any")).where("n = 1 and any = 0").select("video")
    good = b.where(F.col("correct") & (F.col("turns") >= least_turns))
    found = good.join(only, "video", "left_semi").groupBy("video").agg(F.max("turns").alias("max_turn"), F.avg("turns").alias("avg_turn"), F.count("*").alias("correct_count"), F.min("dataset").alias("dataset"))
    return found.orderBy(priority, F.desc("max_turn"), F.desc("avg_turn"), F.desc("correct_count"), "video")


def right_and_wrong(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys both models answered: A wrong, and whether B is right."""
    both = a.select(key, F.col("correct").alias("a")).join(b.select(key, F.col("correct").alias("b")), key)
    return both.where("not a").select(key, F.col("b").alias("other_right"))


def best_of_n(df: DataFrame, question: str, pos: str, right: str, mode: str = "first_correct") -> DataFrame:
    """Responses chosen per question: the first right one, all right ones with their rank, or the pair of first right and last wrong."""
    good = df.where(F.col(right))
    asc = W.partitionBy(question).orderBy(pos)
    if mode == "first_correct":
        return good.withColumn("rank", F.row_number().over(asc)).where("rank = 1").drop("rank")
    if mode == "all_correct":
        return good.withColumn("rank", F.row_number().over(asc))
    if mode == "best_and_worst":
        best = F.min(F.when(F.col(right), F.col(pos)))
        worst = F.max(F.when(~F.col(right), F.col(pos)))
        return df.groupBy(question).agg(best.alias("chosen"), worst.alias("rejected")).where("chosen is not null and rejected is not null")
    raise ValueError(f"unknown mode {mode}")


def grouped_accuracy(df: DataFrame, kind: str, right: Column, fold: dict[str, str] | None = None) -> DataFrame:
    """Accuracy in per cent by kind, by the kind's first letter and overall, in one pass with grouping sets."""
    k = F.col(kind)
    for old, new in (fold or {}).items():
        k = F.when(k == old, new).otherwise(k)
    rows = df.select(k.alias("kind"), F.substring(k, 1, 1).alias("letter"), right.cast("double").alias("right"))
    sets = rows.groupingSets([[F.col("kind")], [F.col("letter")], []], F.col("kind"), F.col("letter"))
    level = F.when(F.grouping("kind") == 0, "kind").when(F.grouping("letter") == 0, "letter").otherwise("all")
    return sets.agg(level.alias("level"), (F.avg("right") * 100).alias("accuracy"), F.count("*").alias("n")).select("level", F.coalesce("kind", "letter", F.lit("Acc")).alias("name"), "accuracy", "n")


def category_accuracy(df: DataFrame, categories: str, pred: Column, truth: Column, credit: float = 0.2) -> DataFrame:
    """Accuracy per label of a multi-label row; a failed prediction (-1) earns ``credit``; ``all`` weighs every label."""
    score = F.when(pred == -1, credit).otherwise((pred == truth).cast("double"))
    rows = df.select(F.explode(categories).alias("category"), score.alias("score"))
    return rows.rollup("category").agg(F.avg("score").alias("accuracy"), F.count("*").alias("n")).withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("all")))


def grounding(df: DataFrame, key: str, ref: tuple[str, str], span: tuple[str, str], right: str) -> DataFrame:
    """Mean best iou and iop over references, shares at 0.3 and 0.5, and the share grounded (iop >= 0.5) and right; per cent."""
    o = span_overlap(F.col(ref[0]), F.col(ref[1]), F.col(span[0]), F.col(span[1]))
    best = df.select(key, right, o.alias("o")).groupBy(key).agg(F.greatest(F.max("o.iou"), F.lit(0.0)).alias("iou"), F.greatest(F.max("o.iop"), F.lit(0.0)).alias("iop"), F.max(F.col(right).cast("int")).alias("qa"))
    pc = lambda c: share(c) * 100
    return best.agg(
        (F.avg("iou") * 100).alias("miou"), (F.avg("iop") * 100).alias("miop"), pc(F.col("iou") >= 0.3).alias("iou_03"), pc(F.col("iou") >= 0.5).alias("iou_05"),
        pc(F.col("iop") >= 0.3).alias("iop_03"), pc(F.col("iop") >= 0.5).alias("iop_05"), pc((F.col("iop") >= 0.5) & (F.col("qa") == 1)).alias("acc_gqa"),
    )


def count_shares(df: DataFrame, key: Column, name: str, top: int | None = None) -> DataFrame:
    """Histogram, largest first; ``top`` keeps the leading ones."""
    out = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), name).limit(top) if top else out
