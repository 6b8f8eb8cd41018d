"""Records equal but for formatting (problem 3).

Two Bloom filters, of canonical hashes seen once and of those seen again, are built in each partition
and merged by segment. Only rows that may repeat are shuffled for exact grouping; all others are
singletons where they stand. The filters grow with the rows and are used a shard at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.bloom import each_shard, flag_held, merged_filter
from lamina.operators.skew import join_groups
from lamina.session import ship_package


def canonical_name(name: str) -> Column:
    """``name`` in lower case without all characters other than letters and digits; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(name), F.lit(""))), r"[^\p{L}\p{N}]", "")


def flag_repeats(df: DataFrame, key: str, keys: int) -> DataFrame:
    """``df`` with ``may_repeat``: false only for rows whose ``key`` (long) occurs once; ``keys`` is about their number."""
    return each_shard(df, key, keys, lambda rows, bits: flag_held(rows, key, merged_filter(rows.select(key), bits, repeated=True), "may_repeat"))


def _keyed(records: DataFrame, record_id: str, names: tuple[str, str]) -> tuple[DataFrame, int]:
    ship_package(records.sparkSession)
    a, b = canonical_name(names[0]), canonical_name(names[1])
    keyed = records.select(F.col(record_id).alias("record_id"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    keyed = keyed.withColumn("hash", F.xxhash64("low", "high"))
    return keyed, records.count()


def collapse_records(records: DataFrame, record_id: str = "drug_id", names: tuple[str, str] = ("brand_name", "generic_name")) -> DataFrame:
    """One row per set of copies: ``first_id`` (smallest id), ``low``, ``high`` (canonical names), ``n_copies``.

    Null names are empty; records with two empty names are copies of each other. Repeated rows count
    as copies. An empty table gives no row.
    """
    keyed, total = _keyed(records, record_id, names)
    flagged = flag_repeats(keyed, "hash", total)
    single = flagged.filter(~F.col("may_repeat")).select(F.col("record_id").alias("first_id"), "low", "high", F.lit(1).cast("long").alias("n_copies"))
    grouped = flagged.filter("may_repeat").groupBy("low", "high").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return single.unionByName(grouped.select(single.columns))


def copies_of_first(records: DataFrame, record_id: str = "drug_id", names: tuple[str, str] = ("brand_name", "generic_name")) -> DataFrame:
    """``first_id, copy_id`` of every record that is not the first of its set; a hot set stays spread."""
    keyed, total = _keyed(records, record_id, names)
    repeats = flag_repeats(keyed, "hash", total).filter("may_repeat").select("record_id", "low", "high")
    groups = repeats.groupBy("low", "high").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    found = join_groups(repeats, groups, ["low", "high"], "n_copies", total)
    return found.filter("record_id <> first_id").select("first_id", F.col("record_id").alias("copy_id")).distinct()
