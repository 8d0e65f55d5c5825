"""Consecutive numbers and running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.skew import lookup_join
from sievework.session import stored

#: Low bits of the id that Spark gives a row: its place within its partition.
PLACE = (1 << 33) - 1


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df in ranges of the order, sorted within, stored, with _range and _at, the place in it. Ties are told apart by where rows
    come from, so that many ties fill several ranges. df is read twice (once to find the ranges): store it first where that
    is costly."""
    keys = [*order, F.col("_tie").asc()]
    told = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(told.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return rows.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit(PLACE))})


def numbered(df: DataFrame, order: Sequence[Column], column: str, first: int = 1) -> DataFrame:
    """df with column: first, first + 1, ... in the order. The totals of the ranges before give each range its offset; only
    these totals, a row a range, are gathered."""
    rows = _placed(df, order)
    before, begins = first, []
    for r in sorted(rows.groupBy("_range").count().collect()):
        begins.append((r["_range"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(begins, "_range long, _before long")
    return rows.join(F.broadcast(offsets), "_range").withColumn(column, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def numbered_within(df: DataFrame, within: Sequence[str], order: Sequence[Column], column: str, first: int = 1) -> DataFrame:
    """As numbered, but each part of `within` counts by itself. Parts are consecutive in the global order, so a row's number is
    its global one less that of its part's first row; a part of any size is dealt out over ranges."""
    rows = stored(numbered(df, [*[F.col(c).asc_nulls_first() for c in within], *order], column, 0), "numbered").withColumn("_part", F.to_json(F.struct(*within)))
    starts = stored(rows.groupBy("_part").agg(F.min(column).alias("_first"), F.count(F.lit(1)).alias("_n")), "part-starts")
    total = starts.agg(F.sum("_n")).first()[0] or 0
    return lookup_join(rows, starts, ["_part"], "_n", total).withColumn(column, F.col(column) - F.col("_first") + first).drop("_part", "_first", "_n")


def running_total(df: DataFrame, within: Sequence[str], order: Sequence[Column], value: str, column: str) -> DataFrame:
    """df with column: the sum of value from the first row of the part to this one. Sums run within ranges, and totals of the
    part's ranges before (a row a part and range) are added, so a part of any size is dealt out over tasks."""
    rows = _placed(df, [*[F.col(c).asc_nulls_first() for c in within], *order]).withColumn("_part", F.to_json(F.struct(*within)))
    per = rows.groupBy("_part", "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_part", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")).where("_before <> 0")
    here = Window.partitionBy("_range", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn(column, F.sum(value).over(here)).join(before, ["_part", "_range"], "left")
    return summed.withColumn(column, F.col(column) + F.coalesce("_before", F.lit(0))).drop("_part", "_range", "_at", "_before")
