"""Graph files: edge lists with tabs, .net files, true communities; communities written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communis.functions.text import fields, leading_int, without_blanks
from communis.operators.graph import Graph, from_pairs, undirected
from communis.operators.order import ranked
from communis.plans.storage import Tables

FORMATS = {1: "directed", 2: "undirected", 3: "net"}


def read_lines(tables: Tables, path: str) -> DataFrame:
    """(line, value): lines with their numbers from 0 in the order of the file, or of files by name."""
    raw = tables.spark.read.text(path)
    keyed = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("within"))
    return ranked(tables, keyed, ["file", "block", "within"], "line").select("line", "value")


def read_tab(tables: Tables, path: str) -> DataFrame:
    """(a, b, weight, pos) of an edge list: the first two fields of each line between tabs. Lines that start with # and
    lines of fewer fields are left out; blanks within names go; repeated edges stay; weight is 1."""
    rows = read_lines(tables, path).where(~F.col("value").startswith("#")).select("line", fields(F.col("value"), "\t").alias("f"))
    rows = rows.where(F.size("f") >= 2)
    name = lambda i: F.nullif(without_blanks(F.get("f", F.lit(i))), F.lit(""))
    return rows.select(name(0).alias("a"), name(1).alias("b"), F.lit(1.0).alias("weight"), F.col("line").alias("pos"))


def read_net(tables: Tables, path: str) -> DataFrame:
    """(a, b, weight, pos) of a .net file, both directions: lines after the first that has *Edges or *Arcs, split at
    single spaces. Of repeated edges the first weight wins. pos is null: neighbours are in the order of names."""
    lines = read_lines(tables, path)
    mark = lines.where(F.col("value").contains("*Edges") | F.col("value").contains("*Arcs")).agg(F.min("line").alias("mark"))
    rows = lines.crossJoin(F.broadcast(mark)).where("line > mark").where(~F.col("value").startswith("*"))  # one row
    rows = rows.select("line", fields(F.col("value"), " ").alias("f")).where("size(f) >= 2")
    name = lambda i: without_blanks(F.get("f", F.lit(i)))
    weight = F.coalesce(F.regexp_replace(F.get("f", F.lit(2)), r"\s", "").try_cast("float"), F.lit(1.0).cast("float"))
    pairs = rows.select(name(0).alias("a"), name(1).alias("b"), weight.alias("weight"), F.col("line").alias("pos")).where("a <> '' AND b <> ''")
    both = undirected(pairs).groupBy("a", "b").agg(F.min_by("weight", "pos").alias("weight"))
    return both.select("a", "b", "weight", F.lit(None).cast("long").alias("pos"))


def load_graph(spark: SparkSession, path: str, form: str | int = "undirected", order: str = "name", dedupe: bool = False) -> Graph:
    """The graph of a file. form: "directed" or "undirected" edge list, or "net" (also by number: 1, 2, 3). dedupe: of
    parallel edges the first alone stays."""
    form = FORMATS.get(form, form)
    tables = Tables(spark, "graph")
    if form == "net":
        pairs = read_net(tables, path)
    elif form in ("directed", "undirected"):
        pairs = read_tab(tables, path)
        pairs = pairs if form == "directed" else undirected(pairs)
    else:
        raise ValueError(f"unknown form {form}")
    if dedupe:
        pairs = pairs.groupBy("a", "b").agg(F.min_by("weight", "pos").alias("weight"), F.min("pos").alias("pos"))
    return from_pairs(tables, pairs, order)


def load_truth(graph: Graph, path: str) -> DataFrame:
    """(id, label) of a file of names and labels between tabs; further fields, # lines, unknown names and labels that
    aren't numbers are left out; the first label of a name wins."""
    rows = read_lines(graph.tables, path).where(~F.col("value").startswith("#")).select("line", fields(F.col("value"), "\t").alias("f")).where("size(f) >= 2")
    rows = rows.select("line", without_blanks(F.get("f", F.lit(0))).alias("name"), leading_int(F.get("f", F.lit(1))).alias("label"))
    first = rows.groupBy("name").agg(F.min_by(F.struct("label"), "line").alias("x")).select("name", "x.label").where("label IS NOT NULL")
    return first.join(graph.nodes.select("id", "name"), "name").select("id", "label")


def coverage(graph: Graph, truth: DataFrame) -> DataFrame:
    """One row (nodes, labelled): how many nodes a truth (id, label) labels."""
    return graph.nodes.join(truth.select("id", F.lit(1).alias("one")), "id", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count("one").alias("labelled"))


def save_edges(graph: Graph, path: str) -> None:
    """Each stored edge as a line of two names with a tab between, in order of ids: a directed edge list."""
    names = graph.nodes.select("id", "name")
    named = graph.edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    named.orderBy("src", "pos", "dst").select(F.concat_ws("\t", "a", "b").alias("value")).write.text(path)


def save_net(graph: Graph, path: str) -> None:
    """A .net file of an undirected graph: its vertices by number, then each pair of neighbours once, with the weight."""
    names = graph.nodes.select("id", "name")
    head = graph.nodes.agg(F.concat(F.lit("*Vertices "), F.count(F.lit(1)).cast("string")).alias("value")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "value")
    vertices = names.select(F.lit(1).alias("part"), F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), F.concat((F.col("id") + 1).cast("string"), F.lit(' "'), "name", F.lit('"')).alias("value"))
    mark = head.select(F.lit(2).alias("part"), "x", "y", F.lit("*Edges").alias("value"))
    edges = graph.edges.where("src <= dst").join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    lines = edges.select(F.lit(3).alias("part"), F.col("src").alias("x"), F.col("dst").alias("y"), F.concat_ws(" ", "a", "b", F.col("weight").cast("string")).alias("value"))
    head.unionByName(vertices).unionByName(mark).unionByName(lines).orderBy("part", "x", "y").select("value").write.text(path)


def save_communities(graph: Graph, labels: DataFrame, path: str) -> None:
    """Lines of name, tab, label, in order of id."""
    named = graph.nodes.select("id", "name").join(labels, "id").orderBy("id")
    named.select(F.concat_ws("\t", "name", F.col("label").cast("string")).alias("value")).write.text(path)
