"""The graph engine against small plain models, closed forms and the SQL of its registry."""

import math
import random
from collections import Counter, defaultdict

import pytest

from communis.functions import quality
from communis.operators import centrality, coloring, graph as g, order, primitives as p, propagate
from communis.plans.storage import Tables
from communis.sources import files


def make(spark, pairs, order_by="name", both=True):
    rows = [(a, b, 1.0, i) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "a string, b string, weight float, pos long")
    return g.from_pairs(Tables(spark, "test"), g.undirected(df) if both else df, order_by)


def some_pairs(n=18, m=40, seed=3):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample([f"n{i}" for i in range(n)], 2))) for _ in range(m)})


def near(graph):
    out = defaultdict(list)
    for r in graph.edges.orderBy("src", "pos", "dst").collect():
        out[r["src"]].append(r["dst"])
    return out


def test_ids_and_counts(spark):
    x = make(spark, [("10", "2"), ("2", "1"), ("9", "1")])
    assert [r["name"] for r in x.nodes.orderBy("id").collect()] == ["1", "10", "2", "9"]
    y = make(spark, [("10", "2"), ("2", "1"), ("9", "1")], "degree")
    assert [(r["name"], r["degree"]) for r in y.nodes.orderBy("id").collect()] == [("10", 1), ("9", 1), ("1", 2), ("2", 2)]
    assert tuple(x.counts().first()) == (4, 6)
    assert [r["offset"] for r in x.offsets().orderBy("id").collect()] == [0, 2, 3, 5]
    found = {r["name"]: r["id"] for r in x.ids_of(spark.createDataFrame([("2",), ("?",)], "name string")).collect()}
    assert found == {"2": 2, "?": -1}


def test_voting_matches_plain_model(spark):
    x = make(spark, some_pairs())
    to = near(x)
    label = {r["id"]: r["id"] for r in x.nodes.collect()}
    for _ in range(3):
        new = {}
        for i in label:
            votes = Counter(label[j] for j in to[i])
            new[i] = min(k for k, v in votes.items() if v == max(votes.values())) if votes else label[i]
        label = new
    found = propagate.detect(x, "sync", max_rounds=3).labels
    assert {r["id"]: r["label"] for r in found.collect()} == label
    mode = {r["src"]: r["label"] for r in propagate.majority_mode(x.edges, found).collect()}
    assert mode == {r["src"]: r["label"] for r in propagate.majority(x.edges, found).collect()}


@pytest.mark.parametrize("how", [("async", {"tie": "hash", "batches": 3}), ("async_exact", {}), ("semisync", {"coloring": "proper"}), ("primitives", {})])
def test_algorithms_end_with_node_labels(spark, how):
    x = make(spark, some_pairs(12, 22))
    out = propagate.detect(x, how[0], seed=5, **how[1])
    ids = {r["id"] for r in x.nodes.collect()}
    rows = out.labels.collect()
    assert {r["id"] for r in rows} == ids and {r["label"] for r in rows} <= ids
    assert 1 <= len(out.trace) <= len(ids) + 1
    again = propagate.detect(x, how[0], seed=5, **how[1]).labels
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))


def test_sinks_keep_their_label(spark):
    x = make(spark, [("a", "b"), ("a", "b"), ("a", "c")], both=False)
    assert {r["id"]: r["label"] for r in propagate.vote(x.edges, p.initial_labels(x.nodes)).collect()} == {0: 1, 1: 1, 2: 2}


def test_stop_rule():
    assert propagate.stop([5], 0, 9) and not propagate.stop([5, 5], 3, 9) and propagate.stop([5, 5, 5], 3, 9)
    assert propagate.stop([9, 8, 7, 6], 2, 3) and not propagate.stop([9, 8, 7], 2, 3)


def test_colouring(spark):
    x = make(spark, some_pairs())
    to = near(x)
    for mode in ("reference", "proper"):
        color = {}
        for i in sorted(to):
            m, seen = 0, [color.get(j, -1) for j in to[i]]
            for c in seen if mode == "reference" else sorted(set(seen)):
                m += c == m
            color[i] = m
        found = {r["id"]: r["color"] for r in coloring.color(x, mode).collect()}
        assert found == color
        assert sorted(set(color.values())) == list(range(max(color.values()) + 1))
    assert all(color[i] != color[j] for i in to for j in to[i])


def test_quality_closed_forms(spark):
    x = make(spark, some_pairs())
    one = x.nodes.select("id").selectExpr("id", "0L AS label")
    k = [r["degree"] for r in x.nodes.collect()]
    assert math.isclose(quality.modularity(x.edges, one).first()[0], sum(i * i for i in k) / sum(k) ** 2)
    assert quality.modularity(x.edges, p.initial_labels(x.nodes)).first()[0] == 0
    two = x.nodes.selectExpr("id", "id % 2 AS label")
    assert math.isclose(quality.nmi(two, two).first()[0], 1) and quality.nmi(one, one).first()[0] == 0
    b, error = quality.fit_hyperbola([4.0, 2.0, 4 / 3, 1.0], rounds=2000)
    assert abs(b - 4) < 1e-3 and error < 1e-3 and quality.hyperbola(2.0, 3) == [math.inf, 2.0, 1.0]


def test_betweenness(spark):
    path = make(spark, [("a", "b"), ("b", "c")])
    assert [r["centrality"] for r in centrality.betweenness(path).orderBy("id").collect()] == [0, 1, 0]
    ring = make(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    assert [r["centrality"] for r in centrality.betweenness(ring, batch=2).orderBy("id").collect()] == [0.5] * 4


def test_betweenness_of_long_paths_writes_few_tables(spark):
    """A level is no table of its own: on a directed ring of n nodes each lies within (n - 1)(n - 2) / 2 shortest paths."""
    n = 150
    ring = make(spark, [(f"{i}", f"{(i + 1) % n}") for i in range(n)], both=False)
    before = ring.tables.n
    found = [r["centrality"] for r in centrality.betweenness(ring, halve=False).collect()]
    assert found == [(n - 1) * (n - 2) / 2] * n and ring.tables.n - before < 10


def test_betweenness_by_joins_is_that_by_arrays(spark):
    """Parallel edges, loops, sinks and parts that don't reach each other; all sources and some."""
    pairs = some_pairs() * 2 + some_pairs(9, 12, 4) + [("n1", "n1"), ("n2", "zz"), ("p", "q"), ("q", "r"), ("q", "r"), ("q", "s"), ("r", "t"), ("s", "t")]
    x = make(spark, pairs, both=False)
    for sources in (None, x.nodes.where("id % 3 = 0")):
        want = {r["id"]: r["centrality"] for r in centrality.betweenness(x, sources, batch=7, most_pairs=0).collect()}
        found = {r["id"]: r["centrality"] for r in centrality.betweenness(x, sources).collect()}
        assert found.keys() == want.keys() and all(math.isclose(found[i], want[i], abs_tol=1e-9) for i in want) and any(want.values())
    names = {r["name"]: r["id"] for r in x.nodes.collect()}
    every = {r["id"]: r["centrality"] for r in centrality.betweenness(x, halve=False).collect()}
    assert math.isclose(every[names["r"]], 4 / 3) and math.isclose(every[names["s"]], 2 / 3) and every[names["q"]] == 3
    assert centrality.betweenness(make(spark, [(None, "a")], both=False)).count() == 0


def test_dependencies_in_any_batches(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    degree = rng.integers(0, 7, 200)
    offset, dst = np.r_[0, np.cumsum(degree)], rng.integers(0, 200, degree.sum())
    ways, sources = rng.integers(1, 4, len(dst)).astype(float), rng.permutation(200)[:90]
    want = centrality.dependencies(offset, dst, ways, sources)
    monkeypatch.setattr(centrality, "STATE", 1500)
    monkeypatch.setattr(centrality, "STEP", 3)
    assert np.allclose(centrality.dependencies(offset, dst, ways, sources), want, rtol=1e-12) and want.any()


def test_dependencies_of_more_paths_than_doubles_hold():
    """A chain of 300 nodes, 100 parallel edges a step, has 1e598 shortest paths; node i lies between i * (299 - i) pairs."""
    import numpy as np

    offset, dst = np.r_[np.arange(300), 299], np.arange(1, 300)
    found = centrality.dependencies(offset, dst, np.full(299, 100.0), np.arange(300))
    assert np.allclose(found, [i * (299 - i) for i in range(300)])


def test_betweenness_of_parts_takes_joins_for_large_ones_alone(spark, monkeypatch):
    """Graphs of more pairs than tasks get as arrays: small parts go as arrays in groups, a loop and a part of one pair too."""
    joined, by_joins = [], centrality._by_joins
    monkeypatch.setattr(centrality, "_by_joins", lambda graph, ways, *how: joined.append(ways.count()) or by_joins(graph, ways, *how))
    r = random.Random(8)
    large = [(f"a{r.randrange(14)}", f"a{r.randrange(14)}") for _ in range(90)]
    small = [(f"{k}{r.randrange(6)}", f"{k}{r.randrange(6)}") for k in "bcdefgh" for _ in range(12)] + [("x", "x"), ("y", "z")]
    for pairs, most in ((small, 62), (small + large, 72)):
        x = make(spark, pairs, both=False)
        ids = {row["name"]: row["id"] for row in x.nodes.collect()}
        assert len(ids) <= most < len(set(pairs))
        want = plain_dependencies([(ids[a], ids[b]) for a, b in pairs], len(ids), range(len(ids)))
        found = {row["id"]: row["centrality"] for row in centrality.betweenness(x, halve=False, batch=50, most_pairs=most).collect()}
        assert len(found) == len(ids) and all(math.isclose(found[i], want[i], abs_tol=1e-9) for i in found) and any(want)
        assert sum(joined) == (len(set(large)) if pairs is not small else 0)


def in_edge_order(pairs, n):
    """(offset, dst, ways) of pairs, repeated ones as parallel edges."""
    import numpy as np

    ways = Counter(pairs)
    pairs = sorted(ways)
    return np.searchsorted([a for a, _ in pairs], np.arange(n + 1)), np.array([b for _, b in pairs]), np.array([float(ways[x]) for x in pairs])


def plain_dependencies(pairs, n, sources):
    """By whole numbers of paths, one source after another."""
    to, total = defaultdict(list), [0.0] * n
    for a, b in pairs:
        to[a].append(b)
    for s in sources:
        dist, sigma, queue = {s: 0}, Counter({s: 1}), [s]
        for v in queue:
            for w in to[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = Counter()
        for v in reversed(queue):
            delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in to[v] if dist[w] == dist[v] + 1)
            total[v] += delta[v] if v != s else 0
    return total


def with_chains(r, nodes, edges, longest):
    """(pairs, n): random pairs, loops and repeated ones too, of which each node is a chain of up to `longest`, with parallel
    edges; and a ring and a chain apart."""
    lengths = [r.randint(1, longest) for _ in range(nodes)]
    first = [sum(lengths[:i]) for i in range(nodes + 1)]
    pairs = [(first[a + 1] - 1, first[b]) for a, b in ((r.randrange(nodes), r.randrange(nodes)) for _ in range(edges))]
    pairs += [(i, i + 1) for a in range(nodes) for i in range(first[a], first[a + 1] - 1) for _ in range(r.randint(1, 3))]
    n = first[-1]
    pairs += [(n + i, n + (i + 1) % 5) for i in range(5)] + [(n + 5, n + 6), (n + 6, n + 7)]
    order = r.sample(range(n + 8), n + 8)
    return [(order[a], order[b]) for a, b in pairs], n + 8


@pytest.mark.parametrize("small", [False, True])
def test_dependencies_of_graphs_with_chains(monkeypatch, small):
    """Folded chains, also such that paths come back to, rings, parts; all sources, some, and repeated ones."""
    import numpy as np

    from communis.operators import folding

    if small:
        monkeypatch.setattr(centrality, "STATE", 64)
        monkeypatch.setattr(centrality, "STEP", 3)
        monkeypatch.setattr(folding, "BLOCK", 4)
    r = random.Random(11)
    for edges, longest in ((3, 5), (8, 4), (14, 1), (14, 6), (40, 3), (70, 2)):
        pairs, n = with_chains(r, 10, edges, longest)
        for sources in (range(n), r.sample(range(n), n // 2), [r.randrange(n) for _ in range(n)]):
            found = centrality.dependencies(*in_edge_order(pairs, n), np.array(sources))
            assert np.allclose(found, plain_dependencies(pairs, n, sources), rtol=1e-12, atol=1e-12)


def test_dependencies_follow_few_edges(monkeypatch):
    """Sources of one chain share a search, and a level's edges are followed from the side that has fewer."""
    import numpy as np

    followed, expand = [0], centrality._expand

    def counted(*how):
        for found in expand(*how):
            followed[0] += len(found[2])
            yield found

    monkeypatch.setattr(centrality, "_expand", counted)
    r = random.Random(4)
    base = [(r.randrange(40), r.randrange(40)) for _ in range(160)]
    chains = [(a * 20 + 19, b * 20) for a, b in base] + [(i, i + 1) for i in range(800) if i % 20 != 19]
    dense = [(r.randrange(300), r.randrange(300)) for _ in range(9000)]
    for pairs, n, most in ((chains, 800, 0.15), (dense, 300, 0.6)):
        followed[0] = 0
        graph = in_edge_order(pairs, n)
        found = centrality.dependencies(*graph, np.arange(n))
        assert np.allclose(found, plain_dependencies(pairs, n, range(n)), rtol=1e-9)
        assert 0 < followed[0] < most * n * len(graph[1])  # twice that is each edge in both directions for each source


def test_few_paths_beside_very_many():
    """Two ways of 300 nodes from one to another, each with a leaf: 1e600 shortest paths on one, a single one on the other."""
    import numpy as np

    m = 300
    lane = lambda at: [(at + i, at + i + 1) for i in range(m - 1)] + [(at + i, at + m + i) for i in range(m)]
    n = 4 * m + 2
    pairs = lane(0) * 100 + lane(2 * m) + [(n - 2, 0), (n - 2, 2 * m), (m - 1, n - 1), (3 * m - 1, n - 1)]
    found = centrality.dependencies(*in_edge_order(pairs, n), np.array([n - 2]))
    after = 2 * (m - np.arange(m)) - 1
    assert np.allclose(found[:m], after + 1) and np.allclose(found[2 * m : 3 * m], after)


def test_primitives(spark):
    t = Tables(spark, "test")
    n = spark.range(1500).selectExpr("id", "1L AS one")
    assert all(r["before"] == r["id"] for r in order.exclusive_sum(t, n, ["id"], "one").collect())
    s = p.random_segments(spark, 300, 7)
    best = {}
    for r in s.orderBy("segment", "at").collect():
        if r["segment"] not in best or r["value"] > best[r["segment"]][0]:
            best[r["segment"]] = (r["value"], r["at"])
    assert {r["segment"]: (r["value"], r["at"]) for r in p.segmented_argmax(s).collect()} == best


def test_readers(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n1\t2\n1\t2\tx\n2 \t3\n3\t3\nodd\n")
    x = files.load_graph(spark, str(tmp_path / "e.txt"), "undirected")
    assert tuple(x.counts().first()) == (3, 8)
    assert tuple(files.load_graph(spark, str(tmp_path / "e.txt"), 1).counts().first()) == (3, 4)
    (tmp_path / "e.net").write_text("*Vertices 3\n1 \"a\"\n*Edges\n1 2 2.0\n2 1 3.0\n2 3 1.0\n")
    y = files.load_graph(spark, str(tmp_path / "e.net"), "net")
    assert sorted((r["src"], r["dst"], r["weight"]) for r in y.edges.collect()) == [(0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0)]
    (tmp_path / "t.txt").write_text("#\n1\t7x\n1\t8\n2\t4\t\n3\tz\n9\t1\n")
    assert sorted(map(tuple, files.load_truth(y, str(tmp_path / "t.txt")).collect())) == [(0, 7), (1, 4)]
    files.save_communities(y, p.initial_labels(y.nodes), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1\t0", "2\t1", "3\t2"]


def test_registry_agrees_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from communis.plans import queries

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(f"{at}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name in ("flagship", "nodes_by_degree", "boundaries", "prefix_sum", "nmi", "bfs_levels", "majority_multigraph", "closest_unvisited", "betweenness", "sync_until_stop", "trace", "metrics",
                 "primitives_three_rounds", "lengths_of_runs", "number_of_runs", "adjacency", "text_functions", "read_tab_undirected", "read_tab_directed", "read_written_edges", "read_net", "read_truth",
                 "truth_coverage", "write_communities", "coloring_reference", "coloring_proper", "semisync"):
        df = queries.QUERIES[name](spark, at)
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(repr, (tuple(map(float_or, r)) for r in df.select(*columns).collect()))) == sorted(map(repr, (tuple(map(float_or, r)) for r in want))), name


def float_or(x):
    return float(x) if isinstance(x, (int, float)) else x


def hashed(*values):
    """Spark's xxhash64 of integers: ("i", n) or ("l", n) each."""
    import xxhash

    h = 42
    for kind, n in values:
        h = xxhash.xxh64_intdigest(n.to_bytes(4 if kind == "i" else 8, "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def until_stop(to, groups, prefer):
    """Labels by the stop rule; groups(turn): nodes that vote together, one group after another."""
    label, counts = {i: i for i in to}, []
    while True:
        turn, before = len(counts) + 1, dict(label)
        for group in groups(turn):
            new = {}
            for i in group:
                votes = Counter(label[j] for j in to[i])
                new[i] = max(votes, key=lambda c: (votes[c], *prefer(turn, i, c)))
            label |= new
        counts.append(len(set(label.values())))
        if propagate.stop(counts, sum(label[i] != before[i] for i in to), len(to)):
            return label, len(counts)


def test_registered_queries_do_the_whole_job(spark):
    """Betweenness from every source, async and semisync to their stop rule, against plain models."""
    import os

    from communis.plans import queries
    from communis.sources import tables

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    to = near(tables.trade(spark, at))
    total = dict.fromkeys(to, 0.0)
    for s in to:
        dist, sigma, order_, at_ = {s: 0}, Counter({s: 1}), [s], 0
        while at_ < len(order_):
            v = order_[at_]
            at_ += 1
            for w in to[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order_.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = Counter()
        for w in reversed(order_):
            for v in to[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    found = {r["id"]: r["centrality"] for r in centrality.betweenness(tables.trade(spark, at)).collect()}
    assert found.keys() == total.keys() and all(math.isclose(found[i], total[i] / 2, abs_tol=2e-4) for i in total)

    def deal(turn):
        for k in range(4):
            yield [i for i in to if hashed(("l", i), ("i", 7), ("i", turn)) % 4 == k]

    want, rounds = until_stop(to, deal, lambda turn, i, c: (hashed(("i", 7), ("i", turn), ("l", i), ("l", c)), -c))
    assert {r["id"]: r["label"] for r in queries.QUERIES["async_batches"](spark, at).collect()} == want and rounds > 2
    color = {}
    for i in sorted(to):
        taken = {color[j] for j in to[i] if j in color}
        color[i] = min(set(range(len(to))) - taken)
    want, rounds = until_stop(to, lambda turn: [[i for i in to if color[i] == k] for k in range(max(color.values()) + 1)], lambda turn, i, c: (-c,))
    assert {r["id"]: r["label"] for r in queries.QUERIES["semisync"](spark, at).collect()} == want and rounds > 1


#: The karate club graph (fixed values): for each node, its neighbours of lower number; and the nodes of the first group.
KARATE = {
    2: [1], 3: [1, 2], 4: [1, 2, 3], 5: [1], 6: [1], 7: [1, 5, 6], 8: [1, 2, 3, 4], 9: [1, 3], 10: [3], 11: [1, 5, 6], 12: [1], 13: [1, 4], 14: [1, 2, 3, 4], 17: [6, 7], 18: [1, 2], 20: [1, 2],
    22: [1, 2], 26: [24, 25], 28: [3, 24, 25], 29: [3], 30: [24, 27], 31: [2, 9], 32: [1, 25, 26, 29], 33: [3, 9, 15, 16, 19, 21, 23, 24, 30, 31, 32],
    34: [9, 10, 14, 15, 16, 19, 20, 21, 23, 24, 27, 28, 29, 30, 31, 32, 33],
}
FIRST_GROUP = {1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 17, 18, 20, 22}


@pytest.fixture(scope="module")
def karate(tmp_path_factory):
    at = tmp_path_factory.mktemp("karate")
    lines = [f"{a} {b} 1.0" for a, some in KARATE.items() for b in some]
    (at / "k.net").write_text("*Vertices 34\n" + "".join(f'{i} "{i}"\n' for i in range(1, 35)) + "*Edges\n" + "\n".join(lines) + "\n")
    (at / "k.txt").write_text("# both directions\n" + "".join(f"{a}\t{b}\n{b}\t{a}\n" for a, some in KARATE.items() for b in some))
    (at / "groups.txt").write_text("".join(f"{i}\t{1 if i in FIRST_GROUP else 2}\n" for i in range(1, 35)))
    return at


def test_karate_is_as_known(spark, karate):
    """Rounds, changes, communities, modularity, NMI, colours and betweenness worked out once by plain models."""
    for ids, want, q in (("name", (7, 12, 3), 0.034270), ("degree", (7, 23, 4), 0.099195)):
        x = files.load_graph(spark, str(karate / "k.net"), "net", ids)
        assert tuple(x.counts().first()) == (34, 156)
        found = propagate.detect(x)
        assert found.trace[-1] == want and [tuple(r) for r in found.trace_rows().collect()] == found.trace
        truth = files.load_truth(x, str(karate / "groups.txt"))
        row = quality.metrics(x, found.labels, truth).first()
        assert row["communities"] == want[2] and abs(row["modularity"] - q) < 1e-6
        if ids == "name":
            assert abs(row["nmi"] - 0.088996) < 1e-6
            assert [r["name"] for r in x.nodes.orderBy("id").limit(4).collect()] == ["1", "10", "11", "12"]
        color = {r["id"]: r["color"] for r in coloring.color(x).collect()}
        same = sum(color[r["src"]] == color[r["dst"]] for r in x.edges.collect())
        assert (len(set(color.values())), same // 2) == (5, 1)
    one = x.nodes.selectExpr("id", "0L AS label")
    assert abs(quality.modularity(x.edges, one).first()[0] - 0.0498028) < 1e-6
    assert abs(quality.modularity(x.edges, truth).first()[0] - 0.408037) < 1e-6
    assert tuple(files.coverage(x, truth).first()) == (34, 34)
    names = {r["id"]: r["name"] for r in x.nodes.collect()}
    between = {names[r["id"]]: r["centrality"] for r in centrality.betweenness(x, batch=20).collect()}
    assert abs(sum(between.values()) - 790) < 1e-6
    assert all(abs(between[k] - v) < 1e-4 for k, v in {"1": 231.0714, "34": 160.5516, "33": 76.6905, "3": 75.8508}.items())


def test_parallel_edges_stay_unless_told(spark, karate):
    x = files.load_graph(spark, str(karate / "k.txt"))
    assert tuple(x.counts().first()) == (34, 312)
    truth = files.load_truth(x, str(karate / "groups.txt"))
    k = Counter(i for a, some in KARATE.items() for b in some for i in (a, b, a, b))  # each edge twice in both directions
    inside = 2 * sum((a in FIRST_GROUP) == (b in FIRST_GROUP) for a, some in KARATE.items() for b in some)
    whole = [sum(n for i, n in k.items() if (i in FIRST_GROUP) == first) for first in (True, False)]
    want = (inside - (sum(n * n for n in whole) - sum(n * n for n in k.values())) / 312) / 312
    assert abs(quality.modularity(x.edges, truth).first()[0] - want) < 1e-9
    assert tuple(files.load_graph(spark, str(karate / "k.txt"), dedupe=True).counts().first()) == (34, 156)


def test_voting_by_primitives_is_voting(spark):
    pairs = some_pairs(10, 20) * 2 + [("n1", "n1"), ("n2", "zz")]
    x = make(spark, pairs, both=False)
    labels = p.initial_labels(x.nodes)
    for _ in range(3):
        new = propagate.vote(x.edges, labels)
        assert sorted(map(tuple, propagate.vote_by_primitives(x.edges, labels).collect())) == sorted(map(tuple, new.collect()))
        labels = x.tables.put(new)


def test_ties_by_hash_vary_with_the_seed_alone(spark):
    x = make(spark, [(f"l{i}", f"r{j}") for i in range(5) for j in range(5)])
    runs = [tuple(sorted(map(tuple, propagate.majority(x.edges, p.initial_labels(x.nodes), "hash", seed, 1).collect()))) for seed in (1, 1, 2, 3, 4)]
    assert runs[0] == runs[1] and len(set(runs)) > 2
    for run in runs:
        assert all(label >= 5 if src < 5 else label < 5 for src, label in run)


def test_long_labels_stay_apart(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\tb\nb\tc\n")
    (tmp_path / "t.txt").write_text("a\t1234567890\nb\t1234567891\nc\t99999999999999999999\n")
    x = files.load_graph(spark, str(tmp_path / "e.txt"))
    assert sorted(map(tuple, files.load_truth(x, str(tmp_path / "t.txt")).collect())) == [(0, 1234567890), (1, 1234567891)]


def test_command_line(spark, karate, capsys, tmp_path):
    from communis import cli

    cli.main(["detect", str(karate / "k.txt"), "--dedupe", "--tie", "min", "--truth", str(karate / "groups.txt"), "--out", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "'nodes': 34" in said and "'edges': 156" in said and "'labelled': 34" in said and "'nmi': 0." in said
    assert spark.read.text(str(tmp_path / "out")).count() == 34
    cli.main(["suite", str(karate / "k.net"), str(karate / "k.net"), "--tie", "min", "--truth", str(karate / "groups.txt")])
    first, second = capsys.readouterr().out.strip().splitlines()
    assert "'communities': 3" in first and "'nmi': 0.0889" in first and "'nmi': None" in second
    with pytest.raises(SystemExit):
        cli.main(["detect", "x", "--truth", "a", "--truth", "b"])
    spark.sparkContext.setLogLevel("ERROR")
