"""Greedy packing: the one kind of operator a window cannot express, a running sum that starts anew.

Each packer maps an array of sizes to ranges ``(start, len, tokens)``, in Arrow batches and linear time;
texts never leave the JVM for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("tokens", T.LongType())]))


def pack(sizes: list[int], budget: int, most: int | None = None, forced: list[bool] | None = None) -> list[tuple[int, int, int]]:
    """Ranges of consecutive items within ``budget``; an item above it has a range of its own.

    A range ends where it holds an item and the next would pass the budget (a range may equal it), where
    it has ``most`` items, or where ``forced`` marks the next item.
    """
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > budget or (most is not None and i - start >= most) or (forced is not None and forced[i])):
            out.append((start, i - start, total))
            start, total = i, 0
        total += size
    if len(sizes) > start:
        out.append((start, len(sizes) - start, total))
    return out


def pack_overlapping(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int, int]]:
    """Like ``pack``; each range begins with the last ``overlap`` items of the one before, or all it had if fewer."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > budget:
            out.append((start, i - start, total))
            if i - start >= overlap:
                start = i - overlap
                total = sum(sizes[start:i])
        total += size
    if len(sizes) > start:
        out.append((start, len(sizes) - start, total))
    return out


def pack_paragraphs(sizes: list[int], budget: int) -> list[tuple[int, int, int]]:
    """Like ``pack``, where an item above the budget ends the range before it and stands alone."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if size > budget or (i > start and total + size > budget):
            if i > start:
                out.append((start, i - start, total))
            start, total = i, 0
            if size > budget:
                out.append((i, 1, size))
                start = i + 1
                continue
        total += size
    if len(sizes) > start:
        out.append((start, len(sizes) - start, total))
    return out


def _over_arrays(fn):
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn([int(v) for v in x]) for x in batch], dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, RANGES)


def packed(sizes: Column, budget: int, most: int | None = None) -> Column:
    return _over_arrays(lambda x: pack(x, budget, most))(sizes)


def packed_overlapping(sizes: Column, budget: int, overlap: int) -> Column:
    return _over_arrays(lambda x: pack_overlapping(x, budget, overlap))(sizes)


def packed_paragraphs(sizes: Column, budget: int) -> Column:
    return _over_arrays(lambda x: pack_paragraphs(x, budget))(sizes)


def packed_with_marks(sizes: Column, marks: Column, budget: int) -> Column:
    """Packing with places where a range must begin."""

    @F.pandas_udf(RANGES)
    def run(sizes: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pack([int(v) for v in x], budget, None, [bool(v) for v in m]) for x, m in zip(sizes, marks)], dtype=object)

    return run(sizes, marks)


def joined(items: Column, piece: Column, between: str) -> Column:
    """Text of the items of a range."""
    return F.array_join(F.slice(items, piece["start"] + 1, piece["len"]), between)


def pack_rows(rows: DataFrame, within: list[str], order: list[str], size: str, budget: int, most: int | None = None, mark: str | None = None, out: str = "pack_id") -> DataFrame:
    """``rows`` with the number of their pack in each group, greedily in ``order``: what ``pack`` does to an array.

    For groups of any length: a group is read by one task, since each pack depends on the one before,
    but as a stream that holds two sums. ``mark`` (boolean) forces a new pack; nulls do not.
    """
    ranked = rows.repartition(*within).sortWithinPartitions(*within, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields) + f", `{out}` int"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, number, total, count = None, 0, 0, 0
        for batch in batches:
            ids = []
            forced = batch[mark].eq(True) if mark else [False] * len(batch)
            for *key, n, new in zip(*[batch[c] for c in within], batch[size], forced):
                if key != group:
                    group, number, total, count = key, 0, 0, 0
                if count and (new or total + n > budget or (most is not None and count >= most)):
                    number, total, count = number + 1, 0, 0
                total, count = total + n, count + 1
                ids.append(number)
            yield batch.assign(**{out: pd.Series(ids, index=batch.index, dtype="int32")})

    return ranked.mapInPandas(number, schema)
