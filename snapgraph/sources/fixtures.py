"""Graphs and keyed maps over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.plans.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs_ps(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers: dense, two layers."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()


def pairs_cops(spark: SparkSession, d: str) -> DataFrame:
    """Customers, orders, parts, suppliers: four layers with hubs; repeats go where the graph is made."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    co = orders.select((F.col("o_custkey") * 4).alias("a"), (F.col("o_orderkey") * 4 + 1).alias("b"))
    op = line.select((F.col("l_orderkey") * 4 + 1).alias("a"), (F.col("l_partkey") * 4 + 2).alias("b"))
    ps = line.select((F.col("l_partkey") * 4 + 2).alias("a"), (F.col("l_suppkey") * 4 + 3).alias("b"))
    return co.union(op).union(ps)


def pairs_co(spark: SparkSession, d: str) -> DataFrame:
    """Customers and parts of large lines: sparse, long paths, several components."""
    line = table(spark, d, "lineitem").where("l_quantity >= 48")
    both = table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select((F.col("o_custkey") * 4).alias("a"), (F.col("l_partkey") * 4 + 2).alias("b")).distinct()


def graph(spark: SparkSession, d: str, name: str = "ps") -> Graph:
    return Graph.from_pairs({"ps": pairs_ps, "cops": pairs_cops, "co": pairs_co}[name](spark, d))


#: The same graphs in SQL: U is the undirected pairs, e the edges.
SQL_U = {
    "ps": "SELECT DISTINCT l_partkey*2 a, l_suppkey*2+1 b FROM lineitem",
    "cops": "SELECT DISTINCT o_custkey*4 a, o_orderkey*4+1 b FROM orders UNION SELECT DISTINCT l_orderkey*4+1, l_partkey*4+2 FROM lineitem UNION SELECT DISTINCT l_partkey*4+2, l_suppkey*4+3 FROM lineitem",
    "co": "SELECT DISTINCT o_custkey*4 a, l_partkey*4+2 b FROM orders JOIN lineitem ON o_orderkey=l_orderkey WHERE l_quantity>=48",
}


def sql_edges(name: str) -> str:
    """CTEs u, e(src, dst), v(id) of a fixture graph."""
    return f"u AS MATERIALIZED ({SQL_U[name]}), e AS MATERIALIZED (SELECT a AS src, b AS dst FROM u UNION SELECT b, a FROM u), v AS MATERIALIZED (SELECT DISTINCT src AS id FROM e)"


def edge_log(spark: SparkSession, d: str) -> DataFrame:
    """(version, op, src, dst): seven insert batches by line number, then seven delete batches of returned lines, one direction each."""
    line = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("k"), (F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), "l_returnflag")
    adds = line.select(F.col("k").alias("version"), F.lit("+").alias("op"), "src", "dst")
    drops = line.where("l_returnflag = 'R'").select((F.col("k") + 7).alias("version"), F.lit("-").alias("op"), "src", "dst")
    return adds.union(drops).distinct()


SQL_LOG = "log AS MATERIALIZED (SELECT DISTINCT l_linenumber::BIGINT AS version, '+' AS op, l_partkey*2 AS src, l_suppkey*2+1 AS dst FROM lineitem UNION SELECT DISTINCT l_linenumber::BIGINT+7, '-', l_partkey*2, l_suppkey*2+1 FROM lineitem WHERE l_returnflag='R')"
