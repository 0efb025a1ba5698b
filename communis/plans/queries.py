"""Queries over graphs derived from the sales tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from communis.functions import quality
from communis.functions.text import fields, leading_int, without_blanks
from communis.operators import centrality, coloring, graph as g, order, primitives as p, propagate
from communis.sources import files, tables as t

#: Levels that the SQL of searches unrolls; the graphs of the tables have fewer, and empty levels add nothing.
DEPTH = 7


def _labels(graph: g.Graph, rounds: int) -> DataFrame:
    return propagate.detect(graph, "sync", max_rounds=rounds).labels if rounds else p.initial_labels(graph.nodes)


def _trade(f: Callable[[g.Graph], DataFrame]) -> Callable:
    return lambda spark, sf_dir: f(t.trade(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of voting on the trade graph, and how good the communities are."""
    graph = t.trade(spark, sf_dir)
    labels = _labels(graph, 3)
    q = quality.modularity(graph.edges, labels).select(F.round("modularity", 9).alias("modularity"))
    return graph.counts().crossJoin(g.count_communities(labels)).crossJoin(q)  # tables of one row


def _nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.trade(spark, sf_dir)
    return quality.nmi(t.trade_truth(spark, sf_dir, graph), _labels(graph, 2)).select(F.round("nmi", 9).alias("nmi"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.trade(spark, sf_dir)
    return quality.contingency(t.trade_truth(spark, sf_dir, graph), _labels(graph, 1))


def _marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.marginals(_cells(spark, sf_dir))


def _hub(graph: g.Graph) -> DataFrame:
    """The node of most edges, of several the first: where a search starts."""
    return graph.nodes.agg(F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("id"))


def _written(write: Callable, read: Callable) -> Callable:
    """Writes the trade graph to a file in the shared folder and reads it back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = t.trade(spark, sf_dir)
        path = f"{graph.tables.top}/file"
        write(spark, sf_dir, graph, path)
        return read(spark, graph, path)

    return run


def _save_pairs(spark, sf_dir, graph, path) -> None:
    lines = t.trade_pairs(spark, sf_dir).select(F.concat("a", F.lit(" \t"), "b", F.lit("\tmore")).alias("value"))
    spark.createDataFrame([("# customers and suppliers",)], "value string").unionByName(lines).write.text(path)


def _save_truth(spark, sf_dir, graph, path) -> None:
    truth = t.trade_truth(spark, sf_dir, graph).join(graph.nodes.select("id", "name"), "id")
    truth.select(F.concat("name", F.lit("\t"), F.col("label").cast("string"), F.lit("x\t")).alias("value")).write.text(path)


def _edges_by_name(graph: g.Graph) -> DataFrame:
    a, b = graph.nodes.select(F.col("id").alias("src"), F.col("name").alias("a")), graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return graph.edges.join(a, "src").join(b, "dst").select("a", "b", "weight")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = t.trade(spark, sf_dir)
    found = quality.metrics(graph, _labels(graph, 2), t.trade_truth(spark, sf_dir, graph))
    return found.select("nodes", "edges", "communities", F.round("modularity", 9).alias("modularity"), F.round("nmi", 9).alias("nmi"))


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagate.detect(t.trade(spark, sf_dir)).trace_rows()


def _closest(graph: g.Graph) -> DataFrame:
    distance = centrality.bfs(graph, _hub(graph)).select(F.col("node").alias("id"), F.col("dist").alias("distance"))
    return g.closest_unvisited(distance, distance.where("distance <= 1").select("id"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions of the readers on the customers' names."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit("\t|"), F.col("c_nationkey").cast("string"), F.lit("x\t")).alias("line"))
    parts = rows.withColumn("f", fields(F.col("line"), "|"))
    return parts.select("c_custkey", without_blanks(F.get("f", F.lit(0))).alias("name"), leading_int(F.get("f", F.lit(1))).alias("number"), F.size(fields(F.col("line"), "\t")).cast("long").alias("fields"))


def _sync(spark: SparkSession, sf_dir: str, algorithm: str = "sync", **how) -> DataFrame:
    return propagate.detect(t.trade(spark, sf_dir), algorithm, **how).labels


def _values(graph: g.Graph) -> DataFrame:
    """Segments of the edges' targets in edge order."""
    return graph.edges.select(F.col("src").alias("segment"), F.col("pos").alias("at"), F.pmod(F.col("dst") * 7919, F.lit(101)).alias("value"))


QUERIES: dict[str, Callable] = {
    "flagship": flagship,
    "nodes_by_name": _trade(lambda x: x.nodes),
    "nodes_by_degree": lambda spark, d: t.trade(spark, d, "degree").nodes,
    "edges": _trade(lambda x: x.edges.select("src", "dst", "weight")),
    "offsets": _trade(lambda x: x.offsets()),
    "next_offset": _trade(lambda x: x.next_offset()),
    "edge_sources": _trade(lambda x: x.sources().select("src", "dst")),
    "graph_counts": _trade(lambda x: x.counts()),
    "degrees": _trade(lambda x: x.degrees()),
    "adjacent": _trade(lambda x: x.adjacent()),
    "neighbours": _trade(lambda x: x.neighbours(1).select("dst", "weight")),
    "lookup_ids": _trade(lambda x: x.ids_of(x.nodes.select(F.concat("name", F.when(F.col("id") % 2 == 0, "").otherwise("?")).alias("name")))),
    "lookup_names": _trade(lambda x: x.names_of(x.nodes.select((F.col("id") * 2).alias("id")))),
    "gather": _trade(lambda x: p.gather(x.edges, _labels(x, 1))),
    "boundaries": _trade(lambda x: p.boundaries(p.gather(x.edges, _labels(x, 1)))),
    "run_ends": _trade(lambda x: p.run_ends(p.boundaries(p.gather(x.edges, _labels(x, 1))))),
    "run_lengths": _trade(lambda x: p.run_lengths(p.gather(x.edges, _labels(x, 1)))),
    "prefix_sum": _trade(lambda x: order.exclusive_sum(x.tables, _values(x), ["segment", "at"], "value")),
    "segmented_argmax": _trade(lambda x: p.segmented_argmax(_values(x))),
    "global_argmax": _trade(lambda x: p.global_argmax(x.nodes.select(F.col("id").alias("at"), F.col("degree").alias("value")))),
    "histogram": _trade(lambda x: p.histogram(_labels(x, 1))),
    "owners": _trade(lambda x: p.owners(x.offsets())),
    "count_changes": _trade(lambda x: p.count_changes(p.initial_labels(x.nodes), _labels(x, 1))),
    "majority": _trade(lambda x: propagate.majority(x.edges, p.initial_labels(x.nodes))),
    "majority_mode": _trade(lambda x: propagate.majority_mode(x.edges, _labels(x, 1))),
    "majority_multigraph": lambda spark, d: (lambda x: propagate.vote(x.edges, p.initial_labels(x.nodes)))(t.handover(spark, d)),
    "degrees_multigraph": lambda spark, d: t.handover(spark, d).nodes,
    "copurchase_degrees": t.copurchase_degrees,
    "sync_three_rounds": lambda spark, d: _sync(spark, d, max_rounds=3),
    "communities": _trade(lambda x: g.communities(_labels(x, 2))),
    "modularity": _trade(lambda x: quality.modularity(x.edges, _labels(x, 2)).select(F.round("modularity", 9).alias("modularity"))),
    "modularity_newman": _trade(lambda x: quality.modularity(x.edges, _labels(x, 2), "newman").select(F.round("modularity", 9).alias("modularity"))),
    "modularity_multigraph": lambda spark, d: (lambda x: quality.modularity(x.edges, _labels(x, 1)).select(F.round("modularity", 9).alias("modularity")))(t.handover(spark, d)),
    "contingency": _cells,
    "contingency_marginals": _marginals,
    "nmi": _nmi,
    "bfs_levels": _trade(lambda x: centrality.bfs(x, _hub(x))),
    "closest_unvisited": _trade(_closest),
    "betweenness": lambda spark, d: centrality.betweenness(t.handover(spark, d), halve=False).select("id", F.round("centrality", 4).alias("centrality")),
    "sync_until_stop": _sync,
    "trace": _trace,
    "metrics": _metrics,
    "primitives_three_rounds": lambda spark, d: _sync(spark, d, "primitives", max_rounds=3),
    "lengths_of_runs": _trade(lambda x: p.lengths_of_runs(p.run_ends(p.boundaries(p.gather(x.edges, _labels(x, 1)))))),
    "number_of_runs": _trade(lambda x: p.number_of_runs(p.boundaries(p.gather(x.edges, _labels(x, 1))))),
    "adjacency": _trade(lambda x: x.adjacency().select("id", F.array_join(F.transform("neighbours", lambda i: i.cast("string")), ",").alias("neighbours"))),
    "text_functions": _names,
    "read_tab_undirected": _written(_save_pairs, lambda spark, x, path: files.load_graph(spark, path).edges.select("src", "dst", "weight")),
    "read_tab_directed": _written(_save_pairs, lambda spark, x, path: files.load_graph(spark, path, 1).nodes),
    "read_written_edges": _written(lambda spark, d, x, path: files.save_edges(x, path), lambda spark, x, path: files.load_graph(spark, path, "directed").edges.select("src", "dst", "weight")),
    "read_net": _written(lambda spark, d, x, path: files.save_net(x, path), lambda spark, x, path: _edges_by_name(files.load_graph(spark, path, "net"))),
    "read_truth": _written(_save_truth, lambda spark, x, path: files.load_truth(x, path)),
    "truth_coverage": _written(_save_truth, lambda spark, x, path: files.coverage(x, files.load_truth(x, path))),
    "write_communities": _written(lambda spark, d, x, path: files.save_communities(x, _labels(x, 1), path), lambda spark, x, path: spark.read.text(path).select(F.col("value").alias("line"))),
    "async_batches": lambda spark, d: _sync(spark, d, "async", tie="hash", seed=7, batches=4),
    "semisync": lambda spark, d: _sync(spark, d, "semisync", coloring="proper"),
    "coloring_reference": _trade(lambda x: coloring.color(x)),
    "coloring_proper": _trade(lambda x: coloring.color(x, "proper")),
}

_TRADE = """
pairs AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS a, 's' || CAST(l_suppkey AS VARCHAR) AS b
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
raw AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)"""
_HANDOVER = """
raw AS (SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS a, CAST(lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE)
  ORDER BY ts, event_id) AS VARCHAR) AS b FROM events) WHERE b IS NOT NULL)"""
_GRAPH = """,
nodes AS (SELECT row_number() OVER (ORDER BY name) - 1 AS id, name, degree FROM (
  SELECT name, CAST(sum(one) AS BIGINT) AS degree FROM (SELECT a AS name, 1 AS one FROM raw UNION ALL SELECT b, 0 FROM raw) GROUP BY name)),
edges AS (SELECT x.id AS src, y.id AS dst FROM raw JOIN nodes x ON x.name = a JOIN nodes y ON y.name = b),
l0 AS (SELECT id, id AS label FROM nodes)"""


def _round(k: int) -> str:
    return f""",
n{k} AS (SELECT src, label, count(*) AS n FROM edges JOIN l{k - 1} ON id = dst GROUP BY src, label),
l{k} AS (SELECT id, coalesce(w.label, l{k - 1}.label) AS label FROM l{k - 1} LEFT JOIN (
  SELECT src, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM n{k}) WHERE r = 1) w ON src = id)"""


def _sql(select: str, rounds: int = 0, base: str = _TRADE, more: str = "") -> str:
    return f"WITH RECURSIVE {base}{_GRAPH}{''.join(_round(k) for k in range(1, rounds + 1))}{more}\n{select}"


def _q(rounds: int, newman: bool = False) -> str:
    spare = "0" if newman else "(SELECT sum(degree * degree) FROM nodes)"
    return f""",
q AS (SELECT round((w - ((SELECT sum(k * k) FROM (SELECT sum(degree) AS k FROM nodes JOIN l{rounds} USING (id) GROUP BY label)) - {spare})
    / CAST(m AS DOUBLE)) / m, 9) AS modularity FROM
  (SELECT 2 * (count(*) // 2) AS m FROM edges), (SELECT count(*) AS w FROM (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)
    JOIN l{rounds} x ON x.id = src JOIN l{rounds} y ON y.id = dst WHERE x.label = y.label))"""


_TRUTH = """,
truth AS (SELECT id, n AS label FROM nodes JOIN (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS nm, c_nationkey AS n FROM customer
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_nationkey FROM supplier) ON nm = name)"""


def _cells_sql(rounds: int) -> str:
    return _TRUTH + f",\ncells AS (SELECT t.label AS t, l.label AS l, count(*) AS n FROM truth t JOIN l{rounds} l USING (id) GROUP BY ALL)"


_VALUES = ",\nvalues_ AS (SELECT src AS segment, dst AS at, (dst * 7919) % 101 AS value FROM edges)"
_MARKED = """,
votes AS (SELECT src, dst, label FROM edges JOIN l1 ON id = dst),
marked AS (SELECT src, label, row_number() OVER w - 1 AS at, CAST(lead(label) OVER w IS DISTINCT FROM label AS INTEGER) AS last_of_run,
  CAST(lead(label) OVER w IS NULL AS INTEGER) AS last_of_segment FROM votes WINDOW w AS (PARTITION BY src ORDER BY label, dst))"""
_OFFSETS = ",\noffsets AS (SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM nodes)"


def _bfs_sql(sources: str, depth: int = DEPTH) -> str:
    """f0, f1, ...: (source, node, dist, sigma) of each level."""
    out = f",\nf0 AS MATERIALIZED ({sources})"
    for k in range(1, depth + 1):
        near = _all("f", "source, node", k - 1)
        out += f""",
f{k} AS MATERIALIZED (SELECT source, dst AS node, {k} AS dist, sigma FROM (SELECT source, dst, sum(sigma) AS sigma FROM f{k - 1} JOIN edges ON src = node GROUP BY source, dst) x
  WHERE NOT EXISTS (SELECT 1 FROM ({near}) s WHERE s.source = x.source AND s.node = x.dst))"""
    return out


def _all(prefix: str, columns: str, depth: int = DEPTH) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM {prefix}{k}" for k in range(depth + 1))


_HUB = "SELECT id AS source, id AS node, 0 AS dist, CAST(1 AS DOUBLE) AS sigma FROM (SELECT id FROM nodes ORDER BY degree DESC, id LIMIT 1)"
_EVERY = "SELECT id AS source, id AS node, 0 AS dist, CAST(1 AS DOUBLE) AS sigma FROM nodes"


def _brandes_sql(depth: int = DEPTH) -> str:
    out = _bfs_sql(_EVERY, depth) + f",\nd{depth} AS MATERIALIZED (SELECT source, node, sigma, CAST(0 AS DOUBLE) AS delta FROM f{depth})"
    for k in range(depth - 1, -1, -1):
        out += f""",
d{k} AS MATERIALIZED (SELECT u.source, u.node, u.sigma, coalesce(add, 0) AS delta FROM f{k} u LEFT JOIN (
  SELECT v.source, e.src AS node, sum(w.sigma / v.sigma * (1 + v.delta)) AS add FROM d{k + 1} v JOIN edges e ON e.dst = v.node
    JOIN f{k} w ON w.source = v.source AND w.node = e.src GROUP BY v.source, e.src) a ON a.source = u.source AND a.node = u.node)"""
    return out


def _colors_sql(near: str) -> str:
    """colors: (id, color), one node after another; near: the colours of the lower neighbours in the order of the fold."""
    return f""",
lower AS (SELECT n.id, coalesce(list(e.dst ORDER BY e.dst) FILTER (e.dst < n.id), []) AS to_ FROM nodes n LEFT JOIN edges e ON e.src = n.id GROUP BY n.id),
fold AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS c UNION ALL
  SELECT i + 1, list_append(c, list_reduce(list_concat([CAST(0 AS BIGINT)], {near}), lambda m, x: CASE WHEN x = m THEN m + 1 ELSE m END)) FROM fold JOIN lower ON id = i),
colors AS (SELECT unnest(range(len(c))) AS id, CAST(unnest(c) AS INTEGER) AS color FROM (SELECT c FROM fold ORDER BY i DESC LIMIT 1))"""


_IN_ORDER = "list_transform(to_, lambda n: c[n + 1])"
_STOP = "changes = 0 OR (c1 = c2 AND c2 = c3) OR t > least((SELECT count(*) FROM nodes), 500)"
#: All nodes at once, round after round until the stop rule: (t, id, label, c1, c2, c3, changes), c1 the last count.
_RUN = f""",
run AS (SELECT CAST(0 AS BIGINT) AS t, id, id AS label, CAST(-1 AS BIGINT) AS c1, CAST(-2 AS BIGINT) AS c2, CAST(-3 AS BIGINT) AS c3, CAST(1 AS BIGINT) AS changes FROM nodes UNION ALL
  SELECT t + 1, id, label, max(place) OVER (), c1, c2, CAST(sum(changed) OVER () AS BIGINT) FROM (
    SELECT t, id, new AS label, c1, c2, dense_rank() OVER (ORDER BY new) AS place, CAST(new <> label AS BIGINT) AS changed FROM (
      SELECT r.t, r.id, r.label, coalesce(w.label, r.label) AS new, c1, c2 FROM run r LEFT JOIN (
        SELECT src, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS k FROM (
          SELECT src, label, count(*) AS n FROM edges JOIN run ON run.id = dst GROUP BY src, label)) WHERE k = 1) w ON w.src = r.id
      WHERE NOT ({_STOP}))))"""
#: Colour classes one after another; old is a node's label when its round began, k the class that votes next.
_TURNS = f""",
turns AS (SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS k, id, id AS label, id AS old, CAST(-1 AS BIGINT) AS c1, CAST(-2 AS BIGINT) AS c2, CAST(-3 AS BIGINT) AS c3, CAST(1 AS BIGINT) AS changes FROM nodes UNION ALL
  SELECT t + ends, CASE WHEN ends = 1 THEN 0 ELSE k + 1 END, id, label, CASE WHEN ends = 1 THEN label ELSE old END,
    CASE WHEN ends = 1 THEN max(place) OVER () ELSE c1 END, CASE WHEN ends = 1 THEN c1 ELSE c2 END, CASE WHEN ends = 1 THEN c2 ELSE c3 END,
    CASE WHEN ends = 1 THEN CAST(sum(changed) OVER () AS BIGINT) ELSE changes END FROM (
    SELECT t, k, id, new AS label, old, c1, c2, c3, changes, dense_rank() OVER (ORDER BY new) AS place, CAST(new <> old AS BIGINT) AS changed,
      CASE WHEN k = (SELECT max(color) FROM colors) THEN 1 ELSE 0 END AS ends FROM (
      SELECT r.t, r.k, r.id, r.old, coalesce(w.label, r.label) AS new, c1, c2, c3, changes FROM turns r LEFT JOIN (
        SELECT src, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS j FROM (
          SELECT src, label, count(*) AS n FROM edges JOIN turns ON turns.id = dst JOIN colors o ON o.id = src AND o.color = turns.k GROUP BY src, label)) WHERE j = 1) w ON w.src = r.id
      WHERE NOT (k = 0 AND ({_STOP})))))"""


_NMI = """SELECT round(-2 * u / (x + y), 9) AS nmi FROM
  (SELECT sum(n * log10(n * CAST(total AS DOUBLE) / (a * b))) AS u FROM cells JOIN (SELECT t, sum(n) AS a FROM cells GROUP BY t) USING (t)
    JOIN (SELECT l, sum(n) AS b FROM cells GROUP BY l) USING (l), (SELECT sum(n) AS total FROM cells)),
  (SELECT sum(a * log10(a / CAST(total AS DOUBLE))) AS x FROM (SELECT sum(n) AS a FROM cells GROUP BY t), (SELECT sum(n) AS total FROM cells)),
  (SELECT sum(a * log10(a / CAST(total AS DOUBLE))) AS y FROM (SELECT sum(n) AS a FROM cells GROUP BY l), (SELECT sum(n) AS total FROM cells))"""

ORACLES: dict[str, str] = {
    "flagship": _sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT label) FROM l3) AS communities, modularity FROM q", 3, more=_q(3)),
    "nodes_by_name": _sql("SELECT id, name, degree FROM nodes"),
    "nodes_by_degree": _sql("SELECT row_number() OVER (ORDER BY degree, name) - 1 AS id, name, degree FROM nodes"),
    "edges": _sql("SELECT src, dst, CAST(1 AS FLOAT) AS weight FROM edges"),
    "offsets": _sql('SELECT id, degree, "offset" FROM offsets', more=_OFFSETS),
    "next_offset": _sql('SELECT id, "offset", CAST(coalesce(lead("offset") OVER (ORDER BY id), (SELECT count(*) FROM edges)) AS BIGINT) AS next_offset FROM offsets', more=_OFFSETS),
    "edge_sources": _sql("SELECT src, dst FROM edges"),
    "graph_counts": _sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"),
    "degrees": _sql("SELECT id, degree FROM nodes"),
    "adjacent": _sql("SELECT DISTINCT src, dst FROM edges"),
    "neighbours": _sql("SELECT dst, CAST(1 AS FLOAT) AS weight FROM edges WHERE src = 1"),
    "lookup_ids": _sql("SELECT CASE WHEN id % 2 = 0 THEN name ELSE name || '?' END AS name, CASE WHEN id % 2 = 0 THEN id ELSE -1 END AS id FROM nodes"),
    "lookup_names": _sql("SELECT x.id * 2 AS id, coalesce(y.name, 'null') AS name FROM nodes x LEFT JOIN nodes y ON y.id = x.id * 2"),
    "gather": _sql("SELECT src, dst, label FROM edges JOIN l1 ON id = dst", 1),
    "boundaries": _sql("SELECT * FROM marked", 1, more=_MARKED),
    "run_ends": _sql("SELECT src, label, \"at\" FROM marked WHERE last_of_run = 1", 1, more=_MARKED),
    "run_lengths": _sql("SELECT src, label, count(*) AS n FROM edges JOIN l1 ON id = dst GROUP BY src, label", 1),
    "prefix_sum": _sql("SELECT segment, \"at\", value, CAST(coalesce(sum(value) OVER (ORDER BY segment, \"at\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM values_", more=_VALUES),
    "segmented_argmax": _sql("SELECT segment, value, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY value DESC, \"at\") AS r FROM values_) WHERE r = 1", more=_VALUES),
    "global_argmax": _sql("SELECT id AS at, degree AS value FROM nodes ORDER BY degree DESC, id LIMIT 1"),
    "histogram": _sql("SELECT label, count(*) AS n FROM l1 GROUP BY label", 1),
    "owners": _sql('SELECT row_number() OVER (ORDER BY src, dst) - 1 AS at, src AS segment FROM edges'),
    "count_changes": _sql("SELECT CAST(sum(CASE WHEN label <> id THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM l1", 1),
    "majority": _sql("SELECT id AS src, label FROM l1", 1),
    "majority_mode": _sql("SELECT id AS src, label FROM l2", 2),
    "majority_multigraph": _sql("SELECT id, label FROM l1", 1, _HANDOVER),
    "degrees_multigraph": _sql("SELECT id, name, degree FROM nodes", 0, _HANDOVER),
    "copurchase_degrees": "SELECT part, count(*) AS degree FROM (SELECT DISTINCT a.l_partkey AS part, b.l_partkey AS other FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey) GROUP BY part",
    "sync_three_rounds": _sql("SELECT id, label FROM l3", 3),
    "communities": _sql("SELECT DISTINCT label FROM l2", 2),
    "modularity": _sql("SELECT * FROM q", 2, more=_q(2)),
    "modularity_newman": _sql("SELECT * FROM q", 2, more=_q(2, True)),
    "modularity_multigraph": _sql("SELECT * FROM q", 1, _HANDOVER, _q(1)),
    "contingency": _sql("SELECT t, l, n FROM cells", 1, more=_cells_sql(1)),
    "contingency_marginals": _sql("SELECT t, l, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY GROUPING SETS ((t), (l), ())", 1, more=_cells_sql(1)),
    "nmi": _sql(_NMI, 2, more=_cells_sql(2)),
    "bfs_levels": _sql(_all("f", "source, node, dist, sigma"), more=_bfs_sql(_HUB)),
    "closest_unvisited": _sql(f"SELECT node AS id, dist AS distance FROM ({_all('f', 'node, dist')}) WHERE dist > 1 ORDER BY dist, node LIMIT 1", more=_bfs_sql(_HUB)),
    "betweenness": _sql(f"SELECT id, round(coalesce(c, 0), 4) AS centrality FROM nodes LEFT JOIN (SELECT node, sum(delta) AS c FROM ({_all('d', 'source, node, delta')}) WHERE source <> node GROUP BY node) ON node = id", 0, _HANDOVER, _brandes_sql()),
    "sync_until_stop": _sql("SELECT id, label FROM run WHERE t = (SELECT max(t) FROM run)", more=_RUN),
    "trace": _sql("SELECT DISTINCT CAST(t AS INTEGER) AS round, changes, c1 AS communities FROM run WHERE t > 0", more=_RUN),
    "metrics": _sql("""SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT label) FROM l2) AS communities, modularity, nmi FROM q, nmi""", 2, more=_q(2) + _cells_sql(2) + f",\nnmi AS ({_NMI})"),
    "primitives_three_rounds": _sql("SELECT id, label FROM l3", 3),
    "lengths_of_runs": _sql("SELECT src, label, count(*) AS n FROM edges JOIN l1 ON id = dst GROUP BY src, label", 1),
    "number_of_runs": _sql("SELECT count(*) AS runs FROM (SELECT DISTINCT src, label FROM edges JOIN l1 ON id = dst)", 1),
    "adjacency": _sql("SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM edges GROUP BY src"),
    "text_functions": "SELECT c_custkey, replace(c_name, ' ', '') AS name, CAST(c_nationkey AS BIGINT) AS number, CAST(3 AS BIGINT) AS fields FROM customer",
    "read_tab_undirected": _sql("SELECT src, dst, CAST(1 AS FLOAT) AS weight FROM edges"),
    "read_tab_directed": _sql("SELECT id, name, CASE WHEN name LIKE 'c%' THEN degree ELSE 0 END AS degree FROM nodes"),
    "read_written_edges": _sql("SELECT src, dst, CAST(1 AS FLOAT) AS weight FROM edges"),
    "read_net": _sql("SELECT a, b, CAST(1 AS FLOAT) AS weight FROM raw"),
    "read_truth": _sql("SELECT id, CAST(label AS BIGINT) AS label FROM truth", more=_TRUTH),
    "truth_coverage": _sql("SELECT count(*) AS nodes, count(label) AS labelled FROM nodes LEFT JOIN truth USING (id)", more=_TRUTH),
    "write_communities": _sql("SELECT name || chr(9) || CAST(label AS VARCHAR) AS line FROM l1 JOIN nodes USING (id)", 1),
    "coloring_reference": _sql("SELECT id, color FROM colors", more=_colors_sql(_IN_ORDER)),
    "coloring_proper": _sql("SELECT id, color FROM colors", more=_colors_sql(f"list_sort(list_distinct({_IN_ORDER}))")),
    "semisync": _sql("SELECT id, label FROM turns WHERE (t, k) = (SELECT (max(t), 0) FROM turns)", more=_colors_sql(f"list_sort(list_distinct({_IN_ORDER}))") + _TURNS),
}
