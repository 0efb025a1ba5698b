"""Data-parallel primitives under a voting round, as relational operators. Segments are nodes; votes are (src, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def initial_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("id").alias("label"))


def gather(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, label): each edge with its target's label."""
    return edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select("src", "dst", "label")


def boundaries(votes: DataFrame) -> DataFrame:
    """(src, label, at, last_of_run, last_of_segment): votes sorted within each segment, the ends of runs marked."""
    w = Window.partitionBy("src").orderBy("label", "dst")
    after = F.lead("label").over(w)
    return votes.select("src", "label", (F.row_number().over(w) - 1).cast("long").alias("at"), (after.isNull() | (after != F.col("label"))).cast("int").alias("last_of_run"), after.isNull().cast("int").alias("last_of_segment"))


def run_ends(marked: DataFrame) -> DataFrame:
    """(src, label, at): the last vote of each run; no run is lost."""
    return marked.where("last_of_run = 1").select("src", "label", "at")


def run_lengths(votes: DataFrame) -> DataFrame:
    """(src, label, n): what sorting, marking, scanning and differencing come to."""
    return votes.groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))


def lengths_of_runs(ends: DataFrame) -> DataFrame:
    """(src, label, n): differences between the ends of runs, as run_ends has them."""
    before = F.lag("at", 1, -1).over(Window.partitionBy("src").orderBy("at"))
    return ends.select("src", "label", (F.col("at") - before).alias("n"))


def number_of_runs(marked: DataFrame) -> DataFrame:
    """One row (runs)."""
    return marked.agg(F.count_if(F.col("last_of_run") == 1).alias("runs"))


def scatter(labels: DataFrame, winners: DataFrame) -> DataFrame:
    """labels (id, label) with those of winners (segment, at) put in their place."""
    new = winners.select(F.col("segment").alias("id"), F.col("at").alias("new"))
    return labels.join(new, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def segmented_argmax(values: DataFrame) -> DataFrame:
    """(segment, value, at) of (segment, at, value): the largest value and the least place that has it."""
    return values.groupBy("segment").agg(F.max("value").alias("value"), F.max_by("at", F.struct(F.col("value"), -F.col("at"))).alias("at"))


def global_argmax(values: DataFrame) -> DataFrame:
    """One row (at, value): the largest value and the least place that has it."""
    return values.agg(F.max_by("at", F.struct(F.col("value"), -F.col("at"))).alias("at"), F.max("value").alias("value"))


def histogram(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def count_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (changes): nodes whose labels differ, exactly."""
    both = old.select("id", F.col("label").alias("x")).join(new.select("id", F.col("label").alias("y")), "id")
    return both.agg(F.coalesce(F.sum((F.col("x") != F.col("y")).cast("long")), F.lit(0)).alias("changes"))


def owners(offsets: DataFrame) -> DataFrame:
    """(at, segment): the segment of each place, from segments (id, degree, offset)."""
    some = offsets.where("degree > 0")
    return some.select(F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("degree") - 1)).alias("at"), F.col("id").alias("segment"))


def random_segments(spark: SparkSession, size: int, segments: int, seed: int = 0) -> DataFrame:
    """(segment, at, value): equal segments of repeatable pseudo-random whole numbers below size."""
    each = max(1, size // segments)
    return spark.range(each * segments).select((F.col("id") / each).cast("long").alias("segment"), F.col("id").alias("at"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size)).alias("value"))
