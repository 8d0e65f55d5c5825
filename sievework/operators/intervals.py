"""Joins of points and ranges with many overlapping windows, by dyadic bins.

A window of length l belongs to the level whose bins are the least power of two above l, so it touches two bins of its level
at most. A value looks in one bin for each level that any window has. So the join is an equi-join with an exact check after
it, neither side is broadcast, and long windows are not cut into many pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.order import running_total
from sievework.session import stored


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def within(rows: DataFrame, windows: DataFrame, keys: Sequence[str], first: str, last: str | None = None) -> DataFrame:
    """rows, each with every window of its keys (window_start to window_end, both inclusive) that holds it, from first to last
    (a point, without last). Rows and windows with nulls, NaN or infinities, and windows that end before they start, match
    nothing; rows and windows that are repeated match each time."""
    # all numbers go by doubles, as they are compared
    number = lambda c: F.col(c).cast("double")
    finite = lambda *cs: " and ".join(f"abs(cast({c} as double)) < double('infinity')" for c in cs)
    good = windows.where(f"{finite('window_start', 'window_end')} and window_start <= window_end")
    length = number("window_end") - number("window_start")
    level = F.when(length <= 0, 0).otherwise(F.floor(F.log2(length)) + 1).cast("int")
    leveled = stored(good.withColumn("_level", level), "windows")
    levels = [r["_level"] for r in leveled.select("_level").distinct().orderBy("_level").collect()]  # some 2,000 at most: exponents of doubles
    ends = F.array_distinct(F.array(_bin(number("window_start"), F.col("_level")), _bin(number("window_end"), F.col("_level"))))
    binned = leveled.withColumn("_bin", F.explode(ends))
    spread = rows.where(finite(first, last or first)).withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)")))
    spread = spread.withColumn("_bin", _bin(number(first), F.col("_level")))
    met = spread.join(binned, [*keys, "_level", "_bin"])
    return met.where((number(first) >= number("window_start")) & (number(last or first) <= number("window_end"))).drop("_level", "_bin")


def holding(rows: DataFrame, windows: DataFrame, row_id: str, key: str, first: str, last: str | None = None) -> DataFrame:
    """row_id, n_windows, first_window: how many windows of a row's key hold it from first to last, and the least window_id of
    these, for the rows that any holds. As within() followed by counting, without a row for each pair.

    In the order of starts, the windows that start early enough for a row are the first c of its key. They are split into blocks
    of powers of two, one for each bit of c; in a block, in falling order of ends, those that end late enough are the windows
    before the row. So n rows and windows make n * log(n) rows, however many windows hold a row."""
    number = lambda c: F.col(c).cast("double")
    finite = lambda *cs: " and ".join(f"abs(cast({c} as double)) < double('infinity')" for c in cs)
    good = windows.where(f"{finite('window_start', 'window_end')} and window_start <= window_end and {key} is not null")
    mine = rows.where(f"{finite(first, last or first)} and {key} is not null")
    starts = good.select(key, number("window_start").alias("_from"), number("window_end").alias("_to"), F.lit(1).cast("long").alias("_window"), "window_id")
    points = mine.select(key, number(first).alias("_from"), number(last or first).alias("_to"), F.lit(0).cast("long").alias("_window"), row_id)
    both = stored(starts.unionByName(points, allowMissingColumns=True), "windows-and-rows")
    placed = stored(running_total(both, [key], [F.col("_from"), F.col("_window").desc()], "_window", "_place"), "windows-placed")
    bits = max(1, int(placed.agg(F.max("_place")).first()[0] or 0).bit_length())
    levels = F.sequence(F.lit(0), F.lit(bits - 1))
    # the block of a window on each level, where that is the first of two; the blocks of a row by the bits of its number
    count = F.col("_place")
    of_window = F.filter(F.transform(levels, lambda j: F.struct(j.alias("_level"), F.call_function("shiftright", count - 1, j).alias("_block"))), lambda x: x["_block"] % 2 == 0)
    of_row = F.filter(F.transform(levels, lambda j: F.struct(j.alias("_level"), (F.call_function("shiftright", count, j) - 1).alias("_block"))), lambda x: x["_block"] % 2 == 0)
    spread = placed.select(key, "_to", "_window", "window_id", row_id, F.inline(F.when(F.col("_window") == 1, of_window).otherwise(of_row)))
    so_far = Window.partitionBy(key, "_level", "_block").orderBy(F.col("_to").desc(), F.col("_window").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = spread.withColumns({"_n": F.sum("_window").over(so_far), "_first": F.min("window_id").over(so_far)}).where("_window = 0 and _n > 0")
    return met.groupBy(row_id).agg(F.sum("_n").alias("n_windows"), F.min("_first").alias("first_window"))
