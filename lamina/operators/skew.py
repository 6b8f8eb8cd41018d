"""Joins that keep hot keys out of a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is hot above this fraction of the rows, so there are at most as many hot groups as its inverse.
HOT_FRACTION = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row a group, safe for groups of any size.

    ``groups`` holds each value of ``keys`` once, with the number of its rows in ``size``; ``total`` is
    the number of all rows. Groups above a thousandth of ``total`` are at most a thousand rows, so they
    are broadcast and their rows stay where they are; the others are shuffled.
    Null keys join nothing. Empty tables give an empty result.
    """
    limit = max(1, total // HOT_FRACTION)
    added = [c for c in groups.columns if c not in keys]
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    tagged = rows.join(F.broadcast(hot), keys, "left")
    near = tagged.filter(F.col(size).isNotNull())
    far = tagged.filter(F.col(size).isNull()).drop(*added).join(cold.hint("shuffle_hash"), keys)
    return near.unionByName(far)


def salted(column: Column, parts: int) -> Column:
    """A key of ``parts`` values that spreads rows of equal keys; the same for equal ``column``."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
