"""Label propagation: neighbours' majority votes, in rounds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from communis.operators.coloring import color
from communis.operators.graph import Graph
from communis.operators.primitives import boundaries, gather, initial_labels, lengths_of_runs, run_ends, run_lengths, scatter, segmented_argmax

ALGORITHMS = ("sync", "async", "async_exact", "semisync", "primitives")
MOST_ROUNDS = 500


def _preference(tie: str, seed: int, turn: int) -> Column:
    """What the largest of decides a vote: count, then a tie rule."""
    if tie == "min":
        return F.struct("n", -F.col("label"))
    if tie == "hash":
        return F.struct(F.col("n"), F.xxhash64(F.lit(seed), F.lit(turn), "src", "label"), -F.col("label"))
    raise ValueError(f"unknown tie rule {tie}")


def majority(edges: DataFrame, labels: DataFrame, tie: str = "min", seed: int = 0, turn: int = 0) -> DataFrame:
    """(src, label): the most frequent label of each node's out-neighbours. Parallel edges are votes each, weights count
    for nothing, a node has no vote of its own. Ties: the least label, or a repeatable pseudo-random one ("hash")."""
    return run_lengths(gather(edges, labels)).groupBy("src").agg(F.max_by("label", _preference(tie, seed, turn)).alias("label"))


def majority_mode(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """majority with tie="min", by the built-in aggregate."""
    return gather(edges, labels).groupBy("src").agg(F.mode("label", True).alias("label"))


def vote(edges: DataFrame, labels: DataFrame, tie: str = "min", seed: int = 0, turn: int = 0) -> DataFrame:
    """labels after a round in which all of the edges' sources vote on the labels given; others keep theirs."""
    new = majority(edges, labels, tie, seed, turn).select(F.col("src").alias("id"), F.col("label").alias("new"))
    return labels.join(new, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def vote_by_primitives(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A round of votes with ties to the least label, step by step: gather, sort and mark, ends of runs, their lengths,
    the longest of each segment, scatter. The same labels as vote's, by windows instead of hash aggregates."""
    runs = lengths_of_runs(run_ends(boundaries(gather(edges, labels))))
    return scatter(labels, segmented_argmax(runs.select(F.col("src").alias("segment"), F.col("label").alias("at"), F.col("n").alias("value"))))


@dataclass
class Result:
    labels: DataFrame
    trace: list[tuple] = field(default_factory=list)  # (round, changes, communities)

    def trace_rows(self) -> DataFrame:
        """The trace as a table (round, changes, communities), a row a round."""
        return self.labels.sparkSession.createDataFrame(self.trace, "round int, changes long, communities long")


def stop(counts: list[int], changes: int, nodes: int) -> bool:
    """No change; as many communities in three rounds on end; or min(nodes, MOST_ROUNDS) + 1 rounds."""
    return changes == 0 or (len(counts) > 2 and counts[-1] == counts[-2] == counts[-3]) or len(counts) > min(nodes, MOST_ROUNDS)


def detect(graph: Graph, algorithm: str = "sync", tie: str = "min", seed: int = 0, batches: int = 8, coloring: str = "reference", max_rounds: int | None = None) -> Result:
    """Communities of a graph: labels (id, label), each node's own id at first, and the trace of rounds.

    sync: all nodes vote on the labels of the round before; primitives: the same by vote_by_primitives, where ties go to
    the least label whatever `tie` says. async: a repeatable pseudo-random deal of the
    nodes into batches, which vote one after another and see earlier batches' labels. async_exact: nodes one by one, for
    graphs that fit a task. semisync: colour classes one after another. Nodes without out-neighbours keep their label.
    Each round's labels are a table in the shared folder, read with one action that counts changes and communities.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}")
    tables, edges = graph.tables, graph.edges
    n = graph.nodes.count()
    labels = tables.put(initial_labels(graph.nodes))
    classes = None
    if algorithm == "semisync":
        colors = color(graph, coloring)
        classes = [r[0] for r in colors.select("color").distinct().orderBy("color").collect()]
        colored = tables.put(edges.join(colors.select(F.col("id").alias("src"), "color"), "src"))
    out = Result(labels)
    while n and (max_rounds is None or len(out.trace) < max_rounds):
        turn, before = len(out.trace) + 1, labels
        if algorithm == "sync":
            labels = tables.put(vote(edges, labels, tie, seed, turn))
        elif algorithm == "primitives":
            labels = tables.put(vote_by_primitives(edges, labels))
        elif algorithm == "async_exact":
            labels = tables.put(_one_by_one(graph, labels, tie, seed, turn))
        elif algorithm == "async":
            deal = F.pmod(F.xxhash64("src", F.lit(seed), F.lit(turn)), F.lit(batches))
            for i in range(batches):
                labels = _step(tables, labels, before, vote(edges.where(deal == i), labels, tie, seed, turn))
        else:
            for c in classes:
                labels = _step(tables, labels, before, vote(colored.where(F.col("color") == c), labels, tie, seed, turn))
        both = labels.join(before.select("id", F.col("label").alias("old")), "id")
        row = both.agg(F.sum((F.col("label") != F.col("old")).cast("long")), F.count_distinct("label")).first()
        out.trace.append((turn, row[0], row[1]))
        tables.drop(before)
        if stop([x[2] for x in out.trace], row[0], n):
            break
    out.labels = labels
    return out


def _step(tables, labels: DataFrame, keep: DataFrame, new: DataFrame) -> DataFrame:
    made = tables.put(new)
    if labels is not keep:
        tables.drop(labels)
    return made


def _one_by_one(graph: Graph, labels: DataFrame, tie: str, seed: int, turn: int) -> DataFrame:
    """One asynchronous round in a single task: nodes in a repeatable pseudo-random order, each seeing all votes before
    it. Sequential by nature, so the whole graph must fit a task; the batched form has no such bound."""
    rows = labels.join(graph.edges.groupBy("src").agg(F.collect_list("dst").alias("to")), F.col("id") == F.col("src"), "left").select("id", "label", "to", F.xxhash64("id", F.lit(seed), F.lit(turn)).alias("order"), F.lit(0).alias("all"))

    def run(pdf):
        from collections import Counter

        now = dict(zip(pdf["id"], pdf["label"]))
        order, to_of = dict(zip(pdf["id"], pdf["order"])), dict(zip(pdf["id"], pdf["to"]))
        for i in sorted(order, key=lambda x: (order[x], x)):
            to = to_of[i]
            if to is not None and len(to):
                votes = Counter(now[j] for j in to)
                most = max(votes.values())
                best = sorted(x for x, c in votes.items() if c == most)
                now[i] = best[0] if tie == "min" else best[(int(order[i]) & 0xFFFFFFFF) % len(best)]
        pdf["label"] = pdf["id"].map(now)
        return pdf[["id", "label"]]

    return rows.groupBy("all").applyInPandas(run, "id long, label long")
