"""Keys, ranges, matrices and a graph derived from the driver tables, in Spark and as SQL.

Graph: parts returned together in one order.  Keys: whole event values; ranges: touching ones of width 5 up to 300, so
that inner ends match two ranges and larger keys none.  Matrices: order x part and part x supplier quantities, and the
symmetric part x part matrix of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import load
from tessera.operators import blocks
from tessera.operators.ranges import RANGES

N_RANGES, WIDTH, M = 60, 5, 4


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.floor("value").cast("bigint").alias("key"))


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, (i - 1) * WIDTH, i * WIDTH) for i in range(1, N_RANGES + 1)], RANGES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v: parts returned in the same order, u < v."""
    return weighted(spark, sf_dir).select("u", "v")


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w: as edges, with the summed product of the quantities."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")
    other = lines.select("l_orderkey", F.col("l_partkey").alias("p2"), F.col("l_quantity").alias("q2"))
    pairs = lines.join(other, "l_orderkey").where("l_partkey < p2")
    return pairs.groupBy(F.col("l_partkey").alias("u"), F.col("p2").alias("v")).agg(F.sum(F.col("l_quantity") * F.col("q2")).cast("bigint").alias("w"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def matrix_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, k, x: quantities of each part (k) in each order (i), in thousandths."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("k")).agg((F.sum("l_quantity") * 1000).cast("bigint").alias("x"))


def matrix_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, j, y: quantities of each part (k) from each supplier (j), in thousandths."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("j")).agg((F.sum("l_quantity") * 1000).cast("bigint").alias("y"))


def symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, k, x: the graph's symmetric matrix of weights."""
    half = weighted(spark, sf_dir).select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("v"))
    return blocks.mirror(half).select("i", F.col("j").alias("k"), F.col("v").alias("x"))


KEYS_SQL = "SELECT event_id AS pos, cast(floor(value) AS BIGINT) AS key FROM events"
RANGES_SQL = f"SELECT cast(i AS INTEGER) AS range_id, cast((i - 1) * {WIDTH} AS BIGINT) AS lo, cast(i * {WIDTH} AS BIGINT) AS hi FROM range(1, {N_RANGES + 1}) t(i)"
WEIGHTED_SQL = """SELECT a.l_partkey AS u, b.l_partkey AS v, cast(sum(a.l_quantity * b.l_quantity) AS BIGINT) AS w FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' GROUP BY 1, 2"""
A_SQL = "SELECT l_orderkey AS i, l_partkey AS k, cast(sum(l_quantity) * 1000 AS BIGINT) AS x FROM lineitem GROUP BY 1, 2"
B_SQL = "SELECT l_partkey AS k, l_suppkey AS j, cast(sum(l_quantity) * 1000 AS BIGINT) AS y FROM lineitem GROUP BY 1, 2"
S_SQL = f"SELECT u AS i, v AS k, w AS x FROM ({WEIGHTED_SQL}) UNION ALL SELECT v, u, w FROM ({WEIGHTED_SQL})"
