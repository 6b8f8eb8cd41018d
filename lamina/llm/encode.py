"""Encoding of texts with a public tokenizer (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.tokenizers import counter, default_vocabulary, encoder
from lamina.session import ship_package, spread


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """``df`` with the token identifiers of ``text`` in ``out`` (array<int>), no special tokens.

    A null text and an empty text both give the empty list; every other text, blank or very long, is
    encoded whole and exactly as it stands. Repeated rows are encoded alike. An existing column named
    ``out`` is replaced. No shuffle: the vocabulary is read once by each worker.
    """
    ship_package(df.sparkSession)
    path = vocabulary_path or default_vocabulary()

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(path)
        for texts in batches:
            yield pd.Series(tool.encode(texts.tolist()), dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary_path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in ``out`` (long); null and empty have 0."""
    ship_package(df.sparkSession)
    path = vocabulary_path or default_vocabulary()

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts.tolist()], dtype="int64")

    return df.withColumn(out, tokens(F.col(text)))


def document_ids(documents: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of each document."""
    return encode_texts(spread(documents.select("doc_id", "text")), vocabulary_path=vocabulary_path).select("doc_id", "ids")
