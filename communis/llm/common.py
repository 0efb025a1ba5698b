"""Helpers shared by the operators: tables in the shared folder, Arrow passes, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from communis.plans.storage import Tables

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def free_memory() -> None:
    """Gives what a task has freed back to the system, as Python workers live on beside those of the next stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


#: Most bytes of an Arrow batch, as a task holds several copies of one; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's size of Arrow batches to BATCH_BYTES, if it is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdecimal() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def per_batch(df: DataFrame, columns: list[str], schema: str, make, *args) -> DataFrame:
    """mapInArrow over `columns`; make(*args) runs once a task and gives a function from a record batch to a dict of
    columns, an Arrow table or None; if it has a method `rest`, that gives the last of them."""
    made = T._parse_datatype_string(schema)
    small_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        arrow = arrow_schema(made)
        step = make(*args)

        def rows(out):
            if out is None:
                return ()
            whole = out.cast(arrow) if isinstance(out, pa.Table) else pa.Table.from_pydict(out, schema=arrow)
            return whole.to_batches(max_chunksize=20_000)

        batch = None
        for batch in batches:
            yield from rows(step(batch))
        if hasattr(step, "rest"):
            yield from rows(step.rest())
        del step, batch
        free_memory()

    return df.select(*map(quoted, columns)).mapInArrow(run, made)


def quoted(column: str):
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(columns: list[str], name: str) -> str:
    """`name`, or a longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows beyond which a key is hot, if they are also more than this share of all: so there are at most 1000 hot keys.
HOT_ROWS, HOT_SHARE = 10_000, 1000


def join_split(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left join right on a key that is unique in right, which has in column n how many of the `total` rows of left have
    the key. Hot keys are at most HOT_SHARE and are broadcast, so that their rows stay where they are."""
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(n) > most).drop(n))
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) <= most).drop(n), key)
    return cold.unionByName(left.join(hot, key))


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, modulo: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: Distinct edges up to which one task finds the components: 2 MB a column, and less than a second.
FEW_EDGES = 1 << 18


def _rooted():
    """Edges (a, b) to (node, root), by union-find whose roots are the least of their component."""
    up: dict[int, int] = {}

    def root(x):
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while x != top:
            up[x], x = top, up[x]
        return top

    def step(batch):
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)

    def rest():
        return {"node": list(up), "root": [root(x) for x in list(up)]}

    step.rest = rest
    return step


def components(tables: Tables, edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of the graph of `edges` (a, b long): rows (node, root) for every node that isn't a root.

    At most `few` distinct edges go to one task, as rounds of many small stages cost the driver memory. More take alternating large-star and small-star rounds; each is a partial aggregate and a join on the
    node, where a hub's edges stay where they are. Every round is written to the shared folder. The number of rounds grows with the logarithm of
    the graph; reaching `rounds` is an error, not a silent stop.
    """
    big = F.greatest("a", "b").alias("a")
    small = F.least("a", "b").alias("b")
    now = tables.put(edges.where("a <> b").select(big, small).distinct())
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    seen = now.agg(mark).first()[0]
    if seen[0] <= few:
        return tables.put(per_batch(now.coalesce(1), ["a", "b"], "node long, root long", _rooted))
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_split(both, least, "u", "n", 2 * seen[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))  # a node has few larger stars: those of its neighbours' roots
        linked = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = tables.put(linked.union(lower.select("a", F.col("m").alias("b"))).distinct())
        tables.drop(now)
        now, was = nxt, seen
        seen = now.agg(mark).first()[0]
        if seen == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
