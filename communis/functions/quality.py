"""Quality of partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modularity(edges: DataFrame, labels: DataFrame, variant: str = "offdiagonal") -> DataFrame:
    """One row (modularity double) of edges (src, dst) and labels (id, label).

    With K_c the degrees of a community summed, W the ordered pairs of distinct adjacent nodes with the same label, and
    m half the stored edges: Q = (W - (sum K_c^2 - sum k_i^2) / 2m) / 2m. Pairs of a node with itself are left out
    ("offdiagonal") or, for variant="newman", counted. Degrees count parallel edges, adjacency doesn't. Null without
    edges.
    """
    if variant not in ("offdiagonal", "newman"):
        raise ValueError(f"unknown variant {variant}")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    total = degree.agg(F.sum("k").alias("stored"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"))
    by = labels.join(degree, labels["id"] == degree["src"], "left").groupBy("label").agg(F.sum(F.coalesce("k", F.lit(0))).cast("double").alias("c"))
    own = by.agg(F.sum(F.col("c") * F.col("c")).alias("communities"))
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    left, right = labels.select(F.col("id").alias("src"), F.col("label").alias("x")), labels.select(F.col("id").alias("dst"), F.col("label").alias("y"))
    inside = pairs.join(left, "src").join(right, "dst").agg(F.sum((F.col("x") == F.col("y")).cast("double")).alias("w"))
    two_m = 2 * F.floor(F.col("stored") / 2)
    spare = F.col("communities") - (F.lit(0.0) if variant == "newman" else F.col("squares"))
    q = F.when(two_m > 0, (F.coalesce("w", F.lit(0.0)) - spare / two_m) / two_m)
    return total.crossJoin(own).crossJoin(inside).select(q.alias("modularity"))  # three tables of one row


def contingency(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (t, l, n): nodes by true and found label, of truth (id, label) and labels (id, label)."""
    t, f = truth.select("id", F.col("label").alias("t")), labels.select("id", F.col("label").alias("l"))
    return t.join(f, "id").groupBy("t", "l").agg(F.count(F.lit(1)).alias("n"))


def marginals(cells: DataFrame) -> DataFrame:
    """Sums of rows, of columns and of all cells: (t, l, n) with null for what is summed over."""
    return cells.cube("t", "l").agg(F.sum("n").alias("n"), F.grouping_id().alias("g")).where("g > 0").drop("g")


def nmi(truth: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (nmi double): normalised mutual information; 0 if both have a single community, or no node in common."""
    cells = contingency(truth, labels)
    rows = cells.groupBy("t").agg(F.sum("n").alias("a"))
    columns = cells.groupBy("l").agg(F.sum("n").alias("b"))
    total = cells.agg(F.sum("n").cast("double").alias("all"))
    one = F.broadcast(total)  # one row
    shared = cells.join(rows, "t").join(columns, "l").crossJoin(one).agg(F.sum(F.col("n") * F.log10(F.col("n") * F.col("all") / (F.col("a").cast("double") * F.col("b")))).alias("u"))
    x = rows.crossJoin(one).agg(F.sum(F.col("a") * F.log10(F.col("a") / F.col("all"))).alias("x"))
    y = columns.crossJoin(one).agg(F.sum(F.col("b") * F.log10(F.col("b") / F.col("all"))).alias("y"))
    spread = F.coalesce(F.col("x") + F.col("y"), F.lit(0.0))
    return shared.crossJoin(x).crossJoin(y).select(F.when(spread == 0, F.lit(0.0)).otherwise(-2 * F.col("u") / F.when(spread == 0, F.lit(1.0)).otherwise(spread)).alias("nmi"))


def metrics(graph, labels: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row (nodes, edges, communities, modularity, nmi); nmi is null without truth (id, label)."""
    found = nmi(truth, labels) if truth is not None else labels.sparkSession.createDataFrame([(None,)], "nmi double")
    number = labels.agg(F.count_distinct("label").alias("communities"))
    return graph.counts().crossJoin(number).crossJoin(modularity(graph.edges, labels)).crossJoin(found)  # tables of one row


def hyperbola(b: float, n: int) -> list[float]:
    """b / x at x = 0, 1, ..., n - 1; infinite at 0."""
    return [math.copysign(math.inf, b) if b else math.nan, *(b / x for x in range(1, n))][:n]


def rmse(y: list[float], estimate: list[float]) -> float:
    return math.sqrt(sum((a - b) ** 2 for a, b in zip(y, estimate)) / len(y))


def fit_hyperbola(y: list[float], rate: float = 0.1, rounds: int = 100, enough: float = 1e-6) -> tuple[float, float]:
    """(b, error) of y close to b / x, x from 1, by gradient descent: a stop test on the series of community counts.

    A few points on the driver; offered apart from detection, whose own stop rule doesn't use it."""
    b, error = 0.5, math.inf
    for _ in range(rounds):
        guess = [b / x for x in range(1, len(y) + 1)]
        error = rmse(y, guess)
        if error < enough:
            break
        b -= rate * sum(2 * (g - v) / x for x, (g, v) in enumerate(zip(guess, y), 1)) / len(y)
    return b, error
