"""Ranks and running sums over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from communis.plans.storage import Tables


def _ordered(tables: Tables, df: DataFrame, keys: list) -> DataFrame:
    """df in ranges of its keys, with (__range, __at): the number of a row's range, and its place there."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id())
    place = F.col("__place")
    return tables.put(rows).withColumns({"__range": F.shiftright(place, 33).cast("int"), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))}).drop("__place")


def _offsets(rows: DataFrame, value) -> DataFrame:
    """What the ranges before each range sum up to: a row for each range, as many as partitions."""
    sums = sorted((r[0], r[1]) for r in rows.groupBy("__range").agg(value.alias("v")).collect())
    out, total = [], 0
    for i, v in sums:
        out.append((i, total))
        total += v
    return F.broadcast(rows.sparkSession.createDataFrame(out, "__range int, __before long"))


def ranked(tables: Tables, df: DataFrame, keys: list, name: str = "rank") -> DataFrame:
    """df with a column of ranks from 0 by keys, which must tell rows apart. Rows are ranked within ranges of the keys,
    and the ranges' sizes are added up on the driver, one number each."""
    rows = _ordered(tables, df, keys)
    return rows.join(_offsets(rows, F.count(F.lit(1))), "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def exclusive_sum(tables: Tables, df: DataFrame, keys: list, value: str, name: str = "before") -> DataFrame:
    """df with the sum of a long column over all rows before each, by keys, which must tell rows apart."""
    rows = _ordered(tables, df, keys)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(_offsets(rows, F.sum(value)), "__range").withColumn(name, F.col("__before") + own).drop("__range", "__at", "__before")
