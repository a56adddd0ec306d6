"""Relations of the reference domain over the test tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that states its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Answers of passes: each order is a question, its lines are the passes, line status the answers.
PASSES = """passes AS (
  SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS pass_idx,
         l_returnflag AS parsed, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS gt,
         CAST((o_orderkey * 37) % 7200 AS DOUBLE) AS duration, o_orderpriority AS method, o_custkey AS video,
         CAST(l_quantity AS INTEGER) AS turns, l_extendedprice AS latency, l_partkey, l_suppkey, l_linenumber, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

BUCKET = "CASE WHEN duration < 60 THEN '0-1min' WHEN duration < 600 THEN '1-10min' WHEN duration < 3600 THEN '10-60min' ELSE '60min+' END"

#: One row a question: passes, right ones, majority vote (ties to the first seen).
QUESTIONS = """counted AS (
  SELECT qid, parsed, count(*) AS m, min(pass_idx) AS first, count(*) FILTER (WHERE parsed = gt) AS hits, max(gt) AS gt, max(duration) AS duration, max(method) AS method
  FROM passes GROUP BY qid, parsed),
questions AS (
  SELECT qid, CAST(sum(m) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS c, max(gt) AS gt, max(duration) AS duration, max(method) AS method,
         arg_max(parsed, m * 1000 - first) AS vote
  FROM counted GROUP BY qid)"""

PASS_AT_K = "CASE WHEN n < {k} THEN 0e0 WHEN n - c < {k} THEN 1e0 ELSE 1e0 - list_product(list_transform(range({k}), lambda i: (n - c - i)::DOUBLE / (n - i))) END"


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    gt = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("qid"), F.row_number().over(w).cast("long").alias("pass_idx"), F.col("l_returnflag").alias("parsed"), gt.alias("gt"),
        ((F.col("o_orderkey") * 37) % 7200).cast("double").alias("duration"), F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("video"),
        F.col("l_quantity").cast("int").alias("turns"), F.col("l_extendedprice").alias("latency"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
    )
