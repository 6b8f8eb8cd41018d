"""Counts and statistics of runs and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions.text import token_count


def run_totals(runs: DataFrame, **sums: str) -> DataFrame:
    """One row: the sum of each named column, 0 for no rows."""
    return runs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])


def topic_counts(chunks: DataFrame, key: str, topics: str = "topics") -> DataFrame:
    """``topic, n_keys, n_chunks``: distinct keys that list a topic, and their chunks with repeats."""
    out = chunks.select(key, F.explode(topics).alias("topic"))
    return out.groupBy("topic").agg(F.countDistinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_chunks"))


def overlap(merged: DataFrame, topics: str = "topics") -> DataFrame:
    """``n_topics, n_keys``: how many keys stand under so many topics."""
    return merged.groupBy(F.size(topics).alias("n_topics")).agg(F.count(F.lit(1)).alias("n_keys"))


def token_cost(chunks: DataFrame, source: str, text: str, price: float = K.DOLLARS_PER_MILLION) -> DataFrame:
    """``source, n_chunks, n_tokens, dollars`` of chunks that are already unique."""
    n = chunks.select(source, token_count(F.col(text)).alias("n"))
    sums = n.groupBy(source).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_tokens"))
    return sums.withColumn("dollars", F.round(F.col("n_tokens") * price / 1e6, 8))


def chunk_lengths(chunks: DataFrame, group: str, text: str) -> DataFrame:
    """``group, n_chunks, avg_chars``."""
    return chunks.groupBy(group).agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length(text)), 6).alias("avg_chars"))


def longest(chunks: DataFrame, text: str, key: list[str], n: int = 5) -> DataFrame:
    """The ``n`` longest chunks, ties by key."""
    return chunks.select(*key, F.length(text).alias("n_chars")).orderBy(F.desc("n_chars"), *key).limit(n)


def missing_from(all_values: DataFrame, served: DataFrame, column: Column | str) -> DataFrame:
    """Values of ``all_values`` that ``served`` lacks."""
    return all_values.select(column).join(served.select(column).distinct(), column, "left_anti")


def batch_stats(batches: DataFrame, within: list[str], batch: str = "batch_id", tokens: str = "n_tokens") -> DataFrame:
    """Chunks and tokens of each request batch."""
    return batches.groupBy(*within, batch).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(tokens).alias("n_tokens"))


def chunks_by_topic(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """``topic, n_chunks`` of every topic, 0 for one without chunks; a chunk counts once for each of its topics."""
    counts = chunks.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n_chunks"))
    return topics.select("topic").join(counts, "topic", "left").na.fill(0, ["n_chunks"])


def abbreviation_probe(sentences: DataFrame, sentence: str, key: list[str], shorter: int = 300, n: int = 1) -> DataFrame:
    """The first ``n`` sentences in key order that hold an abbreviation and are shorter than ``shorter``."""
    marks = "|".join(a.replace(".", r"\.") for a in K.ABBREVIATIONS)
    return sentences.filter(F.col(sentence).rlike(rf"(?<![A-Za-z0-9_])(?:{marks})\.") & (F.length(sentence) < shorter)).orderBy(*key).limit(n)
