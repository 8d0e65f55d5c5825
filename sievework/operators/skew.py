"""Joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup up to which it is broadcast whole, and the bound on hot keys beyond.
MOST_ROWS, HOT_PARTS = 200_000, 5_000


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int, size: int | None = None, how: str = "inner") -> DataFrame:
    """Inner (or left) join of rows with a lookup that has one row a key, and in column n how many of the total rows have the key.

    A lookup of at most MOST_ROWS rows is broadcast. Of a larger one only the keys of more than 1 / HOT_PARTS of all rows
    are, of which there are fewer than HOT_PARTS; the other keys are joined by a shuffle, in which none is hot.
    """
    size = lookup.count() if size is None else size
    if size <= MOST_ROWS:
        return rows.join(F.broadcast(lookup), keys, how)
    is_hot = F.col(n) * HOT_PARTS > total
    hot = F.broadcast(lookup.where(is_hot))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(lookup.where(~is_hot), keys, how)
    return rows.join(hot, keys).unionByName(cold)


def checked(lookup: DataFrame) -> DataFrame:
    """The lookup with a broadcast hint if it has at most MOST_ROWS rows, else as it is, for a shuffled join."""
    return F.broadcast(lookup) if lookup.limit(MOST_ROWS + 1).count() <= MOST_ROWS else lookup
