"""Command line: communities of a graph file, or of several with one algorithm or all.

python -m communis.cli detect PATH [--form undirected] [--order name] [--truth PATH] [--algorithm sync] [--out DIR]
python -m communis.cli suite PATH... [--form net] [--truth PATH]... [--all]

--truth may be given once for each path, in their order; "none" stands for no truth.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from communis.functions import quality
from communis.operators.graph import Graph
from communis.operators.propagate import ALGORITHMS, detect
from communis.sources.files import coverage, load_graph, load_truth, save_communities


def measured(graph: Graph, algorithm: str, truth: str | None = None, out: str | None = None, **how) -> dict:
    """Detects communities and gives the metric row: nodes, edges, communities, modularity, nmi (null without truth),
    seconds of the detection, the trace of rounds, and how many nodes the truth labels."""
    began = time.time()
    found = detect(graph, algorithm, **how)
    seconds = time.time() - began
    if out:
        save_communities(graph, found.labels, out)
    known = load_truth(graph, truth) if truth else None
    row = {"algorithm": algorithm} | quality.metrics(graph, found.labels, known).first().asDict()
    row["labelled"] = coverage(graph, known).first()["labelled"] if truth else None
    return row | {"seconds": round(seconds, 3), "trace": found.trace}


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("detect", "suite"):
        p = sub.add_parser(name)
        p.add_argument("path", nargs=1 if name == "detect" else "+")
        p.add_argument("--form", default="undirected" if name == "detect" else "net", choices=("directed", "undirected", "net"))
        p.add_argument("--order", default="name", choices=("name", "degree"))
        p.add_argument("--algorithm", default="sync", choices=ALGORITHMS)
        p.add_argument("--tie", default="hash", choices=("min", "hash"))
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("--truth", action="append", default=[])
        p.add_argument("--dedupe", action="store_true", help="leave out parallel edges")
        p.add_argument("--out")
        p.add_argument("--all", action="store_true", help="every algorithm on each graph, loaded once")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("communis").getOrCreate()
    if len(a.truth) > len(a.path):
        top.error("more truths than graphs")
    for path, truth in zip(a.path, a.truth + ["none"] * (len(a.path) - len(a.truth))):
        graph = load_graph(spark, path, a.form, a.order, a.dedupe)
        for algorithm in [x for x in ALGORITHMS if x != "async_exact"] if a.all else [a.algorithm]:
            print(path, measured(graph, algorithm, None if truth == "none" else truth, None if a.all else a.out, tie=a.tie, seed=a.seed))


if __name__ == "__main__":
    main()
