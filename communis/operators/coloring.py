"""Greedy colouring by id, in wavefronts: a node's colour depends on its neighbours of lower id alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communis.operators.graph import Graph


def color(graph: Graph, mode: str = "reference") -> DataFrame:
    """(id, color), colours from 0 on.

    "reference": one pass over the neighbours in edge order; the colour moves up by one whenever a neighbour has just
    that colour, so two neighbours may share a colour. "proper": the least colour that no lower neighbour has. Each
    wavefront colours all nodes whose lower neighbours have colours and is a table of its own; their number is the longest
    path of rising ids. Edges of coloured nodes are left behind whenever half of the nodes have gone.
    """
    if mode not in ("reference", "proper"):
        raise ValueError(f"unknown mode {mode}")
    tables = graph.tables
    lower = tables.put(graph.edges.where("dst < src").select("src", "dst", "pos"))
    ids = graph.nodes.select("id")
    done = tables.put(ids.join(lower.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).alias("color")))
    n, have = graph.nodes.count(), done.count()
    at_last = n - have  # uncoloured nodes when `lower` was last written
    step = lambda m, c: F.when(c == m, m + 1).otherwise(m)
    while have < n:
        open_ = lower.join(done.select(F.col("id").alias("src")), "src", "left_anti")
        if 2 * (n - have) <= at_last:
            lower, at_last = tables.put(open_), n - have
            open_ = lower
        seen = open_.join(done.select(F.col("id").alias("dst"), "color"), "dst", "left")
        if mode == "proper":
            seen = seen.groupBy("src", "color").agg(F.min("pos").alias("pos"))
        ready = seen.groupBy("src").agg(F.count_if(F.col("color").isNull()).alias("missing"), F.collect_list(F.struct("pos", "color")).alias("near")).where("missing = 0")
        near = F.transform(F.sort_array("near"), lambda x: x["color"])
        near = near if mode == "reference" else F.sort_array(near)
        new = tables.put(ready.select(F.col("src").alias("id"), F.aggregate(near, F.lit(0), step).alias("color")))
        done, have = done.unionByName(new), have + new.count()
    return done
