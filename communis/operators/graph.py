"""Graphs as two tables: nodes (id, name, degree) and edges (src, dst, weight, pos), each direction a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communis.operators.order import exclusive_sum, ranked
from communis.plans.storage import Tables


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    tables: Tables

    def counts(self) -> DataFrame:
        """One row (nodes, edges); edges are the stored, directed ones."""
        return self.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(self.edges.agg(F.count(F.lit(1)).alias("edges")))

    def sources(self) -> DataFrame:
        """The source of each edge, in edge order of the adjacency (src, pos, dst)."""
        return self.edges.select("src", "pos", "dst")

    def degrees(self) -> DataFrame:
        """Out-degree of each node, parallel edges counted; 0 for sinks."""
        d = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
        return self.nodes.select("id").join(d, F.col("id") == F.col("src"), "left").select("id", F.coalesce("k", F.lit(0)).alias("degree"))

    def offsets(self) -> DataFrame:
        """Where each node's edges begin in edge order: (id, degree, offset)."""
        return exclusive_sum(self.tables, self.degrees(), ["id"], "degree", "offset")

    def next_offset(self) -> DataFrame:
        """(id, offset, next_offset): the next larger offset, the number of edges after the last."""
        o = self.offsets().select("id", "degree", "offset")
        return o.withColumn("next_offset", F.col("offset") + F.col("degree")).where("degree > 0").select("id", "offset", "next_offset")

    def adjacent(self) -> DataFrame:
        """Adjacent ordered pairs, however many parallel edges."""
        return self.edges.select("src", "dst").distinct()

    def neighbours(self, node: int) -> DataFrame:
        """(dst, weight, pos) of one node's edges."""
        return self.edges.where(F.col("src") == node).select("dst", "weight", "pos")

    def ids_of(self, names: DataFrame) -> DataFrame:
        """names (name) with id; -1 for names that aren't in the graph."""
        return names.join(self.nodes.select("name", "id"), "name", "left").select("name", F.coalesce("id", F.lit(-1)).alias("id"))

    def names_of(self, ids: DataFrame) -> DataFrame:
        """ids (id) with name; "null" for ids that aren't in the graph."""
        return ids.join(self.nodes.select("id", "name"), "id", "left").select("id", F.coalesce("name", F.lit("null")).alias("name"))

    def adjacency(self) -> DataFrame:
        """(id, neighbours): each node's neighbours in edge order, for printing."""
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("l")).select(F.col("src").alias("id"), F.transform("l", lambda x: x["dst"]).alias("neighbours"))


def communities(labels: DataFrame) -> DataFrame:
    """The distinct labels."""
    return labels.select("label").distinct()


def count_communities(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("label").alias("communities"))


def from_pairs(tables: Tables, pairs: DataFrame, order: str = "name") -> Graph:
    """A graph of pairs (a, b, weight, pos) of names, each row a stored edge; a null pos stands for the neighbour's place
    in the order of names. order: ids by name ("name", in byte order) or by degree, then name ("degree").

    Every name that occurs is a node, so no node is isolated. Null names are no edges. Repeated rows are parallel edges.
    """
    if order not in ("name", "degree"):
        raise ValueError(f"unknown order {order}")
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    ends = pairs.select(F.col("a").alias("name"), F.lit(1).alias("one")).unionByName(pairs.select(F.col("b").alias("name"), F.lit(0).alias("one")))
    named = ends.groupBy("name").agg(F.sum("one").alias("degree"))
    nodes = ranked(tables, named, ["name"], "by_name")
    nodes = nodes.withColumn("id", F.col("by_name")) if order == "name" else ranked(tables, nodes, ["degree", "name"], "id")
    nodes = tables.put(nodes.select("id", "name", "degree", "by_name"))
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("b"), "by_name")
    edges = pairs.join(a, "a").join(b, "b").select("src", "dst", F.col("weight").cast("float").alias("weight"), F.coalesce(F.col("pos"), F.col("by_name")).alias("pos"))
    return Graph(nodes.select("id", "name", "degree"), tables.put(edges), tables)


def undirected(pairs: DataFrame) -> DataFrame:
    """Pairs and their opposites; with (pos) each opposite follows its pair."""
    double = pairs.withColumn("pos", F.col("pos") * 2)
    return double.unionByName(double.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", (F.col("pos") + 1).alias("pos")))


def closest_unvisited(distance: DataFrame, visited: DataFrame) -> DataFrame:
    """One row: the least id among the nodes of least distance (id, distance) that aren't visited (id)."""
    left = distance.join(visited.select("id"), "id", "left_anti")
    return left.agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance"))

