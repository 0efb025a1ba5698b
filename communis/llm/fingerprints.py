"""Operator 4: document fingerprints as bottom-k sketches, in DataFrame functions only.

A sketch is the k least distinct hashes of a text's five-word shingles. Sketches of parts merge into that of the whole,
and two of them estimate resemblance (Jaccard similarity), containment and the number of distinct shingles. If the texts
have at most k shingles together, the estimates are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, WIDTH = 128, 5
#: Bytes of text that a task takes, about, and ranges of doc_id for each task, so that tasks are even.
TASK_BYTES, RANGES = 128 << 20, 4


def words(text: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def sketch(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch of an array of words, which should be a column of its own (it is looked up for every shingle).
    Fewer words than a shingle are one shingle; no words have an empty sketch."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    # A word beyond the end is null, which a hash passes over.
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, union: Column) -> Column:
    """Estimated Jaccard similarity; union = merged(a, b). Two empty sketches are alike."""
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, union: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1.0 for an empty a."""
    both = resemblance(a, b, union) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def text_of(sketch: Column) -> Column:
    """16 hex digits a hash, in the sketch's order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _tasks(docs: DataFrame) -> int:
    """As many as the texts' bytes need, and the session's shuffle partitions at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def _bucket(docs: DataFrame, n: int) -> Column:
    """The range of doc_id, of about n, that a row falls in; null ids come last. A row is held against about 2 * sqrt(n)
    cuts: every `step`th, and those that follow the last of these below it."""
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    if not cuts:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    step = math.isqrt(len(cuts)) + 1

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda x: x <= F.col("doc_id")))

    def literal(some: list[float]) -> Column:
        return F.split(F.lit(",".join(map(repr, some))), ",").cast("array<double>")

    group = F.greatest(below(literal(cuts[::step])) - 1, F.lit(0)) * step
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(group + below(F.slice(literal(cuts), group + 1, step))).cast("int")


def compare_with_edited(spark: SparkSession, docs: DataFrame, k: int = K) -> DataFrame:
    """One row for each row of docs (doc_id, text), by the contract of op4, and estimated distinct shingles and
    containment of the text in its edited form.

    The next document is that of the next row by (doc_id, text), null ids last; after the last comes the first. Null
    texts count as empty; very long ones are read whole; a table of one row is its own next, and an empty one gives no
    rows. Other columns are ignored, whatever their names. Rows move to ranges of doc_id once, as many as their bytes
    need; each range also gets a copy of the row that follows it, so no window crosses ranges. Rows that share one doc_id,
    or have none, are one range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = _tasks(docs)
    rows = docs.withColumn("range", _bucket(docs, tasks * RANGES))
    heads = sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    if not heads:
        follows = spark.createDataFrame([], "before int, range int, first long")
    else:
        follows = spark.createDataFrame([(heads[i - 1][0], b, first) for i, (b, first) in enumerate(heads)], "before int, range int, first long")
    tie = rows.join(F.broadcast(follows), "range")  # as many rows as ranges
    tie = tie.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("before").agg(F.min("text").alias("text"))
    copies = tie.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("range"), F.lit(True).alias("copy"))
    every = rows.withColumn("copy", F.lit(False)).unionByName(copies).repartition(tasks, "range")
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_last(), "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    out = every.select("doc_id", "copy", "range", "text", F.lead("text").over(order).alias("next"), n.alias("n"), cut.alias("cut"))
    out = out.withColumn("edited", F.concat(F.expr("left(text, n - cut)"), F.expr("left(coalesce(next, ''), cut)")))
    out = out.select("doc_id", "copy", "range", "text", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), words(F.col("text")).alias("w"), words(F.col("edited")).alias("e"))
    out = out.select("doc_id", "copy", "range", "text", "n_chars", "edited_sha256", sketch(F.col("w"), k).alias("a"), sketch(F.col("e"), k).alias("b"))
    out = out.withColumn("c", F.lead("a").over(order)).where(~F.col("copy"))
    out = out.select("doc_id", "n_chars", "edited_sha256", "a", "b", "c", merged(F.col("a"), F.col("b"), k).alias("ab"), merged(F.col("a"), F.col("c"), k).alias("ac"))
    a, b, c, ab, ac = map(F.col, ("a", "b", "c", "ab", "ac"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_of(a).alias("fingerprint"), text_of(b).alias("edited_fingerprint"),
        resemblance(a, b, ab).alias("near_edited"), resemblance(a, c, ac).alias("near_next"),
        distinct_shingles(a, k).alias("n_shingles"), containment(a, b, ab, k).alias("in_edited"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(spark, table(spark, sf_dir, "documents"))
