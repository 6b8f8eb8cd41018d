"""Chunkers over one text column. Each gives one row a chunk, with its index in the text from 0."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions.text import STAND_IN, Tokens, paragraphs, sentences, sentences_plain, strip
from lamina.operators.packing import joined, packed, packed_overlapping, packed_paragraphs, packed_with_marks

Splitter = Callable[[Column], Column]


def sized(parts: Column, tokens: Tokens = STAND_IN) -> Column:
    """Sizes of an array of texts; a tokenizer outside the JVM counts them in one go, as one text each."""
    return F.transform(parts, tokens.count) if tokens is STAND_IN else _counted(tokens)(parts)


def _counted(tokens: Tokens) -> Callable[[Column], Column]:
    @F.pandas_udf("array<int>")
    def run(batch: pd.Series) -> pd.Series:
        flat = pd.Series([x for parts in batch if parts is not None for x in parts], dtype=object)
        counts = iter(tokens.count.func(flat).tolist())
        return pd.Series([None if parts is None else [next(counts) for _ in parts] for parts in batch], dtype=object)

    return run


def by_sentences(df: DataFrame, text: str, budget: int = 300, splitter: Splitter = sentences, overlap: int = 0, tokens: Tokens = STAND_IN) -> DataFrame:
    """Sentences packed greedily and joined by a space: ``chunk_index, chunk, n_tokens`` beside the other columns.

    A sentence above the budget stays whole; spaces between sentences are not counted. With ``overlap``
    each chunk begins with the last sentences of the one before. Texts without a sentence give no row.
    """
    parted = df.withColumn("_s", splitter(F.col(text)))
    sizes = sized(F.col("_s"), tokens)
    ranges = packed_overlapping(sizes, budget, overlap) if overlap else packed(sizes, budget)
    out = parted.withColumn("_r", ranges).select("*", F.posexplode("_r").alias("chunk_index", "_p"))
    return out.withColumns({"chunk": joined(F.col("_s"), F.col("_p"), " "), "n_tokens": F.col("_p.tokens")}).drop("_s", "_r", "_p")


def by_windows(df: DataFrame, text: str, window: int = 300, tokens: Tokens = STAND_IN) -> DataFrame:
    """Consecutive windows of tokens, with the white space between them: ``chunk_index, chunk``."""
    parted = df.withColumn("_t", tokens.split(F.col(text))).filter(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / window).cast("int"))
    out = parted.select("*", F.posexplode(starts).alias("chunk_index", "_k"))
    return out.withColumn("chunk", F.array_join(F.slice("_t", F.col("_k") * window + 1, window), "")).drop("_t", "_k")


def by_paragraphs(df: DataFrame, key: str, text: str, budget: int = 300, tokens: Tokens = STAND_IN) -> DataFrame:
    """Paragraphs packed greedily; one above the budget is packed by plain sentences: ``key, chunk_index, chunk``."""
    parted = df.select(key, paragraphs(F.col(text)).alias("_p"))
    ranges = parted.withColumn("_r", packed_paragraphs(sized(F.col("_p"), tokens), budget)).select(key, "_p", F.posexplode("_r").alias("_k", "_x"))
    pieces = ranges.select(key, "_k", F.col("_x.tokens").alias("_n"), joined(F.col("_p"), F.col("_x"), "\n\n").alias("_c"))
    small = pieces.filter(F.col("_n") <= budget).select(key, "_k", F.lit(0).alias("_j"), F.col("_c").alias("chunk"))
    large = by_sentences(pieces.filter(F.col("_n") > budget), "_c", budget, sentences_plain, tokens=tokens).select(key, "_k", F.col("chunk_index").alias("_j"), "chunk")
    return _numbered(small.unionByName(large), key, ["_k", "_j"]).select(key, "chunk_index", "chunk")


def _numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def by_similarity(df: DataFrame, items: str, sizes: str, similarities: str, threshold: float = 0.5, budget: int = 400) -> DataFrame:
    """Items (an array) packed anew where the likeness to the item before is under the threshold or the budget is passed.

    ``similarities`` has one value an item, null for the first.
    """
    marks = F.transform(F.col(similarities), lambda s: F.coalesce(s < threshold, F.lit(False)))
    out = df.withColumn("_r", packed_with_marks(F.col(sizes), marks, budget)).select("*", F.posexplode("_r").alias("chunk_index", "_p"))
    return out.withColumns({"n_items": F.col("_p.len"), "n_tokens": F.col("_p.tokens"), "first_item": F.col("_p.start")}).drop("_r", "_p")


def by_sections(df: DataFrame, key: str, text: str, most: int = K.SECTION_TOKENS, budget: int = 300, tokens: Tokens = STAND_IN) -> DataFrame:
    """Numbered sections: ``key, chunk_index, chunk``.

    The body begins at the first header that repeats an earlier one (page numbers apart), which skips
    the contents list; what stands before is dropped. A section within ``most`` tokens is one chunk, a
    longer one is packed by sentences; a text without such a body is packed as a whole. A header takes
    the line feeds around it, so that of two adjoining headers the second is none.
    """
    head = "(?d)" + K.SECTION_HEADER
    # the texts between headers, and the headers, side by side; positions follow from their lengths
    heads = F.regexp_extract_all(F.col(text), F.lit(head), F.lit(1))
    between = F.split(F.col(text), head)
    plain = F.transform(heads, lambda h: strip(F.regexp_replace(h, K.TRAILING_NUMBER, "")))
    first = F.array_position(F.transform(plain, lambda h, i: F.array_contains(F.slice(plain, 1, i), h)), True)
    parted = df.select(key, F.col(text).alias("_t"), heads.alias("_h"), between.alias("_b"), first.cast("int").alias("_f"))
    body = parted.filter("_f > 0").select(key, F.posexplode(F.slice("_h", F.col("_f"), F.size("_h"))).alias("_k", "_head"), "_b", "_f")
    sections = body.select(key, "_k", strip(F.concat(F.lit("\n"), "_head", F.lit("\n"), F.get("_b", F.col("_f") + F.col("_k")))).alias("_c"))
    sections = sections.withColumn("_n", tokens.count(F.col("_c"))).filter("_c <> ''")
    small = sections.filter(F.col("_n") <= most).select(key, "_k", F.lit(0).alias("_j"), F.col("_c").alias("chunk"))
    large = by_sentences(sections.filter(F.col("_n") > most), "_c", budget, tokens=tokens).select(key, "_k", F.col("chunk_index").alias("_j"), "chunk")
    whole = by_sentences(parted.filter("coalesce(_f, 0) = 0").select(key, "_t"), "_t", budget, tokens=tokens).select(key, F.lit(0).alias("_k"), F.col("chunk_index").alias("_j"), "chunk")
    return _numbered(small.unionByName(large).unionByName(whole), key, ["_k", "_j"]).select(key, "chunk_index", "chunk")


def windows_with_prefix(df: DataFrame, content: str, prefix: str, limit: int = K.WINDOW_TOKENS, floor: int = K.WINDOW_FLOOR, tokens: Tokens = STAND_IN) -> DataFrame:
    """Content that passes the limit with its prefix, in windows; the prefix stands before every piece.

    Adds ``sub_index, n_subs, piece``. A window has what the prefix leaves of the limit, ``floor`` at least.
    """
    parted = df.withColumn("_t", tokens.split(F.col(content))).withColumn("_p", tokens.count(F.col(prefix)))
    width = F.greatest(F.lit(limit) - F.col("_p"), F.lit(floor))
    fits = F.size("_t") + F.col("_p") <= limit
    count = F.when(fits, F.lit(1)).otherwise(F.greatest(F.ceil(F.size("_t") / width), F.lit(1)).cast("int"))
    out = parted.withColumns({"_w": width, "n_subs": count, "_fits": fits}).select("*", F.explode(F.sequence(F.lit(0), F.col("n_subs") - 1)).alias("sub_index"))
    window = F.array_join(F.slice("_t", F.col("sub_index") * F.col("_w") + 1, F.col("_w")), "")
    return out.withColumn("piece", F.concat(F.col(prefix), F.when(F.col("_fits"), F.col(content)).otherwise(window))).drop("_t", "_p", "_w", "_fits")
