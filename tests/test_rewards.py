"""The staged rewards against the column functions that the registry names, on the test tables."""

import os

import pytest
from pyspark.sql import functions as F

from framewise.functions import scoring
from framewise.operators import rewards
from framewise.plans import answers
from framewise.plans.views import table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_staged_rewards_equal_the_column_functions(spark):
    rows = answers.responses(spark, DIR)
    response, golds = F.col("response"), F.col("golds")
    for staged, column in (
        (rewards.exact_match(rows), scoring.compute_score(response, golds)),
        (rewards.sub_match(rows), scoring.compute_score_subem(response, golds)),
        (rewards.sub_match(rows, format_score=0.1), scoring.compute_score_subem(response, golds, 0.1)),
    ):
        both = staged.withColumn("other", column)
        assert both.count() > 5000 and both.where(~F.col("score").eqNullSafe(F.col("other"))).count() == 0


def test_staged_propositions_equal_the_column_function(spark):
    key = F.when(F.col("l_linenumber") % 4 == 0, "summary").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")))
    tools = table(spark, DIR, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("qid"), key.alias("key"), (F.col("l_quantity") / 100).alias("value"))
    calls = tools.groupBy("qid").agg(F.array_agg(F.create_map("key", "value")).alias("calls"))
    staged = rewards.mixed(answers.responses(spark, DIR), tools, "qid", "key", "value").join(calls, "qid", "left")
    none = F.array().cast("array<map<string,double>>")
    both = staged.withColumn("other", scoring.compute_score(F.col("response"), F.col("golds"), F.coalesce("calls", none), "puls"))
    assert both.where(F.abs(F.col("score") - F.col("other")) > 1e-9).count() == 0 and both.where("score is null or other is null").count() == 0
