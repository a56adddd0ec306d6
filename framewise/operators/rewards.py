"""Rewards of responses, staged so that no expensive expression is evaluated twice a row.

The column functions of :mod:`framewise.functions.scoring` state the same in one expression each; over many rows the
answer, the tag counts and the propositions are better computed once and kept as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.scoring import EM_WEIGHT, PULS_THRESHOLD, PULS_WEIGHT
from framewise.functions.text import extract_solution, is_valid_sequence, normalize_answer


def normalized(golds: Column) -> Column:
    """Gold answers in normal form; best done once a question, before passes are joined to it."""
    return F.transform(golds, normalize_answer)


def with_answers(df: DataFrame, response: str, golds: str, normal: bool = False) -> DataFrame:
    """``df`` with ``answer``, ``hit`` (exact match) and ``many`` (more than ten answer tags of a kind).

    ``normal`` says that the gold answers are in normal form already.
    """
    tags = lambda tag: F.regexp_count(response, F.lit(tag))
    staged = df.withColumn("answer", extract_solution(F.col(response))).withColumn("many", (tags("<answer>") > 10) | (tags("</answer>") > 10))
    mine = staged.withColumn("_mine", normalize_answer(F.col("answer")))
    return mine.withColumn("hit", F.coalesce(F.array_contains(F.col(golds) if normal else normalized(F.col(golds)), F.col("_mine")), F.lit(False)))


def exact_match(df: DataFrame, response: str = "response", golds: str = "golds", normal: bool = False) -> DataFrame:
    """``df`` with ``score``: 1 for a match, a quarter with too many tags, else 0."""
    rows = with_answers(df, response, golds, normal)
    return rows.withColumn("score", F.when(F.col("hit"), F.when(F.col("many"), 0.25).otherwise(1.0)).otherwise(0.0)).drop("answer", "many", "_mine", "hit")


def sub_match(df: DataFrame, response: str = "response", golds: str = "golds", format_score: float = 0.0, normal: bool = False) -> DataFrame:
    """``df`` with ``score``: 1 if a gold answer is part of the answer, else the format score of a valid sequence."""
    rows = with_answers(df, response, golds, normal).withColumn("_golds", F.col(golds) if normal else normalized(F.col(golds)))
    inside = F.coalesce(F.exists("_golds", lambda g: F.contains(F.col("_mine"), g)), F.lit(False))
    formed = F.when(is_valid_sequence(F.col(response)), F.lit(format_score)).otherwise(0.0) if format_score else F.lit(0.0)
    return rows.withColumn("score", F.when(F.col("answer").isNull(), 0.0).when(inside, 1.0).otherwise(formed)).drop("answer", "many", "_mine", "hit", "_golds")


def proposition_table(tools: DataFrame, question: str, key: str, value: str, threshold: float = PULS_THRESHOLD) -> DataFrame:
    """Proposition score of each question of (question, key, value): the best value of every key, combined before the shuffle."""
    best = tools.groupBy(question, key).agg(F.max(value).alias("v"))
    earned = F.when(F.col(key) == "summary", 0.5).when(F.col("v") > threshold, 1.0).otherwise(0.0)
    return best.groupBy(question).agg(F.avg(earned).alias("puls"))


def mixed(df: DataFrame, tools: DataFrame, question: str, key: str, value: str, response: str = "response", golds: str = "golds", em_weight: float = EM_WEIGHT, puls_weight: float = PULS_WEIGHT, threshold: float = PULS_THRESHOLD, normal: bool = False) -> DataFrame:
    """``df`` with ``score``: weighted mean of propositions and exact match; a question without propositions counts by match alone."""
    rows = with_answers(df, response, golds, normal).join(proposition_table(tools, question, key, value, threshold), question, "left")
    em = F.when(F.col("hit"), F.when(F.col("many"), 0.25).otherwise(1.0)).otherwise(0.0)
    both = F.when(F.col("puls").isNull(), em).otherwise((F.col("puls") * puls_weight + em * em_weight) / (puls_weight + em_weight))
    return rows.withColumn("score", F.when(F.col("answer").isNull(), 0.0).otherwise(both)).drop("answer", "many", "_mine", "hit", "puls")
