"""Graphs derived from the tables of a sales database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from communis.operators.graph import Graph, from_pairs
from communis.plans.storage import Tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(tables: Tables, pairs: DataFrame, both: bool, order: str) -> Graph:
    pairs = tables.put(pairs).select("a", "b", F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("pos"))
    if both:
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", "pos"))
    return from_pairs(tables, pairs, order)


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each customer and each supplier of a line of its orders, once."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey")
    ids = orders.join(lines, "k").select("o_custkey", "l_suppkey").distinct()
    return ids.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))


def trade(spark: SparkSession, sf_dir: str, order: str = "name") -> Graph:
    """Customers and the suppliers of their orders' lines, undirected and without parallel edges."""
    return _graph(Tables(spark, "graph"), trade_pairs(spark, sf_dir), True, order)


def trade_truth(spark: SparkSession, sf_dir: str, graph: Graph) -> DataFrame:
    """(id, label): the nation of each customer and supplier."""
    c = _read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_nationkey").alias("label"))
    s = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").alias("label"))
    return c.unionByName(s).join(graph.nodes.select("id", "name"), "name").select("id", "label")


def handover(spark: SparkSession, sf_dir: str) -> Graph:
    """From each event of a type to the user of the next one of that type on the same day: directed, with parallel edges
    and loops."""
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    pairs = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("a"), F.lead("user_id").over(w).cast("string").alias("b"))
    return _graph(Tables(spark, "graph"), pairs.where("b IS NOT NULL"), False, "name")


def copurchase_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, degree): distinct other parts bought in the same orders."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("other"))
    pairs = lines.join(other, "l_orderkey").where("l_partkey <> other").select("l_partkey", "other").distinct()
    return pairs.groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("degree"))
