"""Cutting items above a size limit at natural boundaries (problem 5)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.frames import ids
from lamina.session import ship_package

#: Boundaries from the strongest to the weakest; a piece may end where a match ends.
BOUNDARIES = [
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"(?:[.!?…][”»’\"')\]]*(?=\s)|[。！？][”」』）]*|[؟।][”»\"]*)\s*"),
    re.compile(r"(?: \| )|[;:；：]\s*"),
    re.compile(r"[,，、،]\s*| [–—] "),
    re.compile(r"\s+"),
]
#: Half the width of the window around a target, as a part of the step between targets.
REACH = 0.3


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where ``text`` is cut; piece k begins ``overlap`` before cut k and none is above ``limit``.

    The smallest number of pieces is tried first, with targets at equal lengths; each cut moves to the
    strongest boundary in reach of its target, the nearest among equals (the earlier of two as near), or
    to the strongest one its piece allows if none is in reach. Where a limit fails, that of this piece
    or of those after it, all is done again with more pieces, as often as need be. A word is cut only
    where its piece has no boundary at all. An overlap below 0 or not below the limit is refused.
    """
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} does not fit pieces of {limit}")
    length, step = len(text), limit - overlap
    if length <= limit:
        return []
    ends: list[list[int]] = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    pieces, tries = 1 + -(-(length - limit) // step), 0
    while (cuts := _balanced(text, ends, pieces, limit, overlap)) is None:
        tries += 1
        pieces += 1 + tries // 8
    return cuts


def _best(ends: list[list[int]], target: float, low: int, high: int) -> int | None:
    from bisect import bisect_left, bisect_right

    for level in ends:
        i, j = bisect_left(level, low), bisect_right(level, high)
        if i < j:
            k = bisect_left(level, target, i, j)
            near = [level[x] for x in (k - 1, k) if i <= x < j]
            return min(near, key=lambda x: (abs(x - target), x))
    return None


def _whole(text: str, at: int, low: int) -> int:
    """``at`` or, where it would part a character from its marks, the place before them."""
    while at > low and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def _balanced(text: str, ends: list[list[int]], pieces: int, limit: int, overlap: int) -> list[int] | None:
    """The cuts for so many pieces or fewer, None where they do not keep the limit."""
    length, step = len(text), limit - overlap
    share = (length + (pieces - 1) * overlap) / pieces
    cuts: list[int] = []
    start = 0
    for k in range(1, pieces):
        if length - start <= limit:
            break
        target = k * (share - overlap) + overlap
        reach = (share - overlap) * REACH
        least, most = start + overlap + 1, start + limit
        low, high = max(least, length - step * (pieces - k)), most
        if low > high:
            return None
        near_low, near_high = max(low, int(target - reach)), min(high, int(target + reach))
        cut = _best(ends, target, near_low, near_high) if near_low <= near_high else None
        if cut is None:
            cut = _best(ends, target, low, high)
        if cut is None:
            if _best(ends, target, least, most) is not None:
                return None
            cut = _whole(text, min(most, max(low, int(target))), low)
        cuts.append(cut)
        start = cut - overlap
    return cuts if length - start <= limit else None


def table_text(cells: str) -> Column:
    """A grid as text: cells joined by `` | `` (null = empty), rows by a line feed."""
    row = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    return F.array_join(F.transform(F.col(cells), lambda r: F.coalesce(row(r), F.lit(""))), "\n")


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of ``items`` (item_field, item_id, body): ``piece_no, n_pieces, start_pos, end_pos, piece, n_chars``.

    ``limits`` has ``item_field, max_chars, overlap_chars``. An item within its limit is one piece as it
    stands, an empty one included; null bodies and fields without a limit give nothing. Each later
    piece begins with the last ``overlap_chars`` characters of the one before it. An overlap below 0 or
    not below its limit is refused with ValueError. Only items above the limit leave the JVM.
    Repeated rows give repeated pieces; other columns are ignored.
    """
    ship_package(items.sparkSession)
    bound = limits.select("item_field", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).filter("max_chars > 0").dropDuplicates(["item_field"])
    if not bound.filter("overlap_chars < 0 OR overlap_chars >= max_chars").isEmpty():
        raise ValueError("size limits hold an overlap below 0 or not below its limit")
    sized = items.select("item_field", "item_id", "body").filter(F.col("body").isNotNull()).join(bound, "item_field")
    whole = sized.filter(F.length("body") <= F.col("max_chars")).select(
        "item_field", "item_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"),
        F.length("body").alias("end_pos"), F.col("body").alias("piece"), F.length("body").alias("n_chars"),
    )

    columns = whole.columns

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for field, item, body, limit, overlap in zip(batch["item_field"], ids(batch["item_id"]), batch["body"], batch["max_chars"], batch["overlap_chars"]):
                limit, overlap = int(limit), int(overlap)
                cuts = cut_points(body, limit, overlap)
                starts, stops = [0, *(c - overlap for c in cuts)], [*cuts, len(body)]
                rows += [(field, item, k, len(starts), a, b, body[a:b], b - a) for k, (a, b) in enumerate(zip(starts, stops))]
            yield pd.DataFrame(rows, columns=columns).astype({"item_id": object})

    above = sized.filter(F.length("body") > F.col("max_chars")).mapInPandas(cut, whole.schema)
    return whole.unionByName(above)


def corpus_items(guidelines: DataFrame, drugs: DataFrame, tables: DataFrame) -> DataFrame:
    """The three kinds of items that have a limit."""
    return (
        guidelines.select(F.lit("guidelines.clean_text").alias("item_field"), F.col("guideline_id").alias("item_id"), F.col("clean_text").alias("body"))
        .unionByName(drugs.select(F.lit("drugs.adverse_reactions").alias("item_field"), F.col("drug_id").alias("item_id"), F.col("adverse_reactions").alias("body")))
        .unionByName(tables.select(F.lit("who_tables.table_data").alias("item_field"), F.col("table_id").alias("item_id"), table_text("table_data").alias("body")))
    )
