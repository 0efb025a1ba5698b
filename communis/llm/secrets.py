"""Operator 3: secret scans with multipart credential linking, in DataFrame functions only.

Strong spans (assignments, access identifiers, hex strings) are reported as they are. Weak candidates are reported only
where complementary parts co-occur: a weak secret beside an identifier or an endpoint, a weak identifier beside a secret,
an endpoint beside an identifier and a secret. Parts count as beside each other if they are of one text, don't overlap,
and start within SCOPE code points of each other. A part that lies in another is no part of its own: what an endpoint or
a strong span covers, such as the path of a URL, proves nothing about it.

Parts are intervals of their texts. Each kind's parts are joined by interval to those of the complementary kinds through
buckets of SCOPE code points: a part meets the nearest parts before and after it, so there are never more rows than
parts. The part that a weak candidate is linked to is reported with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, table

SCOPE = 400
#: Kinds in the order in which they are listed: (kind, pattern, what it is evidence of). The first three are strong.
KINDS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "secret"),
    ("access", r"AKIA[A-Z0-9]{16,}", "identifier"),
    ("hex", r"[0-9a-f]{24,}", "secret"),
    ("weak_access", r"(?i)\b(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|username|user|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}", "identifier"),
    ("weak_secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", "secret"),
    ("endpoint", r"(?i)\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", "endpoint"),
)
STRONG, WEAK_SECRET, ENDPOINT = 3, 4, 5
ROLES = ("identifier", "secret", "endpoint")
#: Rows that have none of these have no part of any kind: a cheap test before the others.
HINT = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|akia|(?:access[_-]?key|client[_-]?id|username|user|login|account)[a-z_-]*[\"']?\x20*[:=]|://|[a-z0-9+/_-]{20}"


def _part_of(kind: int):
    return lambda x, n: F.struct(F.lit(kind).alias("kind"), n.alias("nth"), x["gap"].alias("gap"), x["length"].alias("length"), x["value"].alias("value"))


def _parts(text: Column) -> Column:
    """Array of (kind, nth, gap, length, value): each match, the code points between it and the one before, its own, and
    those of its value."""
    found = []
    for i, (_, pattern, _) in enumerate(KINDS):
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        match = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
        value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x)) if i == 0 else match
        zipped = F.arrays_zip(between.alias("gap"), match.alias("length"), value.alias("value"))
        rows = F.transform(zipped, _part_of(i))
        found.append(F.when(text.rlike(pattern), F.filter(rows, lambda x: x["length"].isNotNull())).otherwise(F.array()))
    empty = F.array().cast("array<struct<kind:int,nth:int,gap:int,length:int,value:int>>")
    return F.when(text.rlike(HINT), F.concat(*found)).otherwise(empty)


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k[2]) for k in KINDS]), kind + 1)


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), kind + 1)


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """spans (row, kind, start, end; no overlaps) with, for each role, the nearest part of that role that starts within
    `scope` of the span's start, itself left out: a struct (distance, kind, start, end) or null.

    Each part goes to the bucket of its start and the two beside it; within a bucket, the last part of each role before
    a span and the first after it are the nearest. Buckets are small whatever the text's length, so a very long text is
    many of them."""
    part = F.struct(F.col("start"), "kind", "end")
    near = spans.withColumn("own", F.floor(F.col("start") / scope).cast("long"))
    dealt = near.select("row", "kind", "start", "end", "own", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("bucket"))
    order = Window.partitionBy("row", "bucket").orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    columns = []
    for role in ROLES:
        own = F.when(_role(F.col("kind")) == role, part)
        last, first = F.last(own, ignorenulls=True).over(before), F.first(own, ignorenulls=True).over(after)
        columns += [last.alias(f"{role}_before"), first.alias(f"{role}_after")]
    met = dealt.select("row", "kind", "start", "end", "own", "bucket", *columns).where("bucket = own")

    def nearest(role):
        both = F.array(*[F.struct(F.abs(F.col(f"{role}_{x}.start") - F.col("start")).alias("distance"), *[F.col(f"{role}_{x}.{c}").alias(c) for c in ("kind", "start", "end")]) for x in ("before", "after")])
        return F.array_min(F.filter(both, lambda x: x["distance"] <= scope)).alias(role)

    return met.select("row", "kind", "start", "end", *[nearest(role) for role in ROLES])


def scan(spark: SparkSession, docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, links.

    spans has base spans and linked weak ones as kind:start:end; links has, for each weak one, kind:start:end and what it
    is linked to, joined by > and, where there are two, by &. Null and empty texts have no spans (base_sha256 is that of
    an empty string). Texts and secrets may be of any length. Repeated rows are scanned each. A weak candidate that
    overlaps a strong span or an endpoint is part of it and isn't reported again; of overlapping weak candidates the
    first counts. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    tables = Tables(spark, "secrets")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _parts(F.coalesce("text", F.lit(""))).alias("parts"))
    rows = tables.put(rows)
    parts = rows.where(F.size("parts") > 0).select("row", F.inline("parts")).repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("length")).over(before)
    spans = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    spans = spans.where((F.col("kind") != 0) | (F.col("value") >= 6)).select("row", "kind", "start", "end")
    strong = F.col("kind") < STRONG
    order = Window.partitionBy("row").orderBy("start", "kind")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def overlaps(which):
        covered = F.max(F.when(which, F.col("end"))).over(earlier) > F.col("start")
        reached = F.min(F.when(which, F.col("start"))).over(later) < F.col("end")
        return F.coalesce(covered, F.lit(False)) | F.coalesce(reached, F.lit(False))

    outer = strong | (F.col("kind") == ENDPOINT)
    spans = spans.withColumns({"in_strong": overlaps(strong), "in_outer": overlaps(outer)})
    spans = spans.where(strong | ~F.when(F.col("kind") == ENDPOINT, F.col("in_strong")).otherwise(F.col("in_outer")))
    spans = spans.withColumn("in_weak", F.coalesce(F.max(F.when(~outer, F.col("end"))).over(earlier) > F.col("start"), F.lit(False)))
    spans = tables.put(spans.where(outer | ~F.col("in_weak")).select("row", "kind", "start", "end"))
    weak_rows = spans.groupBy("row").agg(F.max(~strong).alias("weak")).where("weak").select("row")
    met = _linked(spans.join(weak_rows, "row", "left_semi"), scope).where(~strong)
    identifier, secret, endpoint = map(F.col, ROLES)
    text = lambda x: F.when(x.isNotNull(), F.concat_ws(":", _name(x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    to = (
        F.when(F.col("kind") == WEAK_SECRET, F.coalesce(text(identifier), text(endpoint)))
        .when(F.col("kind") == ENDPOINT, F.concat(text(identifier), F.lit("&"), text(secret)))
        .otherwise(text(secret))
    )
    linked = met.select("row", "kind", "start", "end", to.alias("to")).where("to IS NOT NULL")
    kept = spans.where(strong).withColumn("to", F.lit(None).cast("string")).unionByName(linked)
    one = F.struct("start", "kind", F.concat_ws(":", _name(F.col("kind")), F.col("start").cast("string"), F.col("end").cast("string")).alias("text"), "to")
    by_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("all"))
    out = rows.select("row", "doc_id").join(by_row, "row", "left")
    every = F.coalesce("all", F.array().cast(by_row.schema["all"].dataType))

    def count(i):
        return F.size(F.filter(every, lambda x: x["kind"] == i)).cast("long")

    def joined(array, of=lambda x: x["text"]):
        return F.concat_ws(",", F.transform(array, of))

    base = joined(F.filter(every, lambda x: x["kind"] < STRONG))
    weak = F.filter(every, lambda x: x["kind"] >= STRONG)
    links = joined(weak, lambda x: F.concat_ws(">", x["text"], x["to"]))
    return out.select("doc_id", *[count(i).alias(f"n_{KINDS[i][0]}") for i in range(STRONG)], F.sha2(base, 256).alias("base_sha256"), joined(every).alias("spans"), F.size(weak).alias("n_linked"), links.alias("links"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
