"""First record of a key, ordered topics of a key, and fan-out.

Order is data here: every operator takes the columns that say which record came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.skew import join_groups


def first_by_key(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order`` (ascending, nulls first); rows with a null key are one key.

    An aggregate and no window: each task passes on one row a key, so that a hot key is no hot task.
    """
    first = F.min_by(F.struct("*"), F.struct(*order))
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(first.alias("_first")).select("_first.*")


def capped(df: DataFrame, keys: list[str | Column], order: list[str | Column], most: int, place: str | None = None) -> DataFrame:
    """The first ``most`` rows of each key, a task's own first before the shuffle; with ``place`` their number from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    return kept.withColumnRenamed("_rn", place) if place else kept.drop("_rn")


def with_first(df: DataFrame, key: str, record: str, out: str = "first_id") -> DataFrame:
    """``df`` with the least ``record`` of its ``key``, what stands for all of them; a null key has none."""
    first = df.groupBy(key).agg(F.min(record).alias(out), F.count(F.lit(1)).alias("_n"))
    return join_groups(df, first, [key], "_n", df.count()).drop("_n")


def merge_by_key(df: DataFrame, key: str, order: list[str], topic: str, keep: list[str]) -> DataFrame:
    """One row per key with the ``keep`` columns of its first row and ``topics``, one entry a row, in ``order``.

    A key listed twice under a topic has the topic twice. One shuffle; partial results are merged
    before it, so a hot key costs its list of topics and no more.
    """
    place = F.struct(*order)
    first = F.min_by(F.struct(*keep), place).alias("_first")
    topics = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(topic).alias("_topic")))), lambda x: x["_topic"]).alias("topics")
    return df.groupBy(key).agg(first, topics).select(key, *[F.col(f"_first.{c}").alias(c) for c in keep], "topics")


def fan_out(df: DataFrame, topics: str = "topics", out: str = "topic") -> DataFrame:
    """One row for each topic of a row."""
    return df.withColumn(out, F.explode(topics))


def new_keys(candidates: DataFrame, existing: DataFrame, topic: str, key: str, rank: str, target: int) -> DataFrame:
    """Candidates not there yet, in rank order, as many as each topic lacks of ``target``.

    A topic that has its target gives none.
    """
    have = existing.groupBy(topic).agg(F.countDistinct(key).alias("_have"))
    fresh = candidates.join(existing.select(topic, key).distinct(), [topic, key], "left_anti")
    # no topic needs more than the target, which Spark can cut to before it shuffles
    ranked = capped(fresh, [topic], [rank, key], target, place="_place")
    wanted = ranked.join(have, topic, "left")
    return wanted.filter(F.col("_place") <= F.lit(target) - F.coalesce("_have", F.lit(0))).drop("_have", "_place")


def with_search_term(topics: DataFrame, overrides: DataFrame, topic: str = "topic") -> DataFrame:
    """``topics`` with ``term``: the override (topic, term) if there is one, else the topic."""
    own = overrides.select(F.col(topic), F.col("term").alias("_term"))
    return topics.join(own, topic, "left").withColumn("term", F.coalesce(F.nullif("_term", F.lit("")), F.col(topic))).drop("_term")
