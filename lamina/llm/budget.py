"""Token totals by source, language and topic (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.encode import count_tokens
from lamina.session import cut_lineage

#: fixed values: two-letter codes of the three-letter language codes in use
LANGUAGES = {
    "ara": "ar", "zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr",
    "hin": "hi", "jpn": "ja", "por": "pt", "rus": "ru", "tha": "th", "ita": "it", "kor": "ko", "nld": "nl", "dut": "nl",
    "pol": "pl", "tur": "tr", "ukr": "uk", "vie": "vi",
}

ALL = "(all)"


def unique_chunk_tokens(chunks: DataFrame, articles: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """One row per chunk id: ``source, language, topics, n_tokens``.

    Texts are counted where they are read, so that only counts are shuffled. Deliveries of a chunk are
    one chunk (null ids are one chunk each row); of differing deliveries the latest non-null values
    count. A null language is that of the article for pubmed, else ``und``; a null source is
    ``unknown``; a chunk without topics is of the topic ``(none)``.
    """
    counted = count_tokens(chunks.select("chunk_id", "text", "source", "topics", "source_id", "lang", "written_at"), vocabulary_path=vocabulary_path).drop("text")
    at = F.coalesce(F.col("written_at"), F.lit(0).cast("timestamp"))
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(at, F.col("n_tokens")))).alias(c)
    alone = F.when(F.col("chunk_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    once = counted.groupBy("chunk_id", alone).agg(*[last(c) for c in ("source", "topics", "source_id", "lang", "n_tokens")])
    once = cut_lineage(once)  # read twice below, while the texts are counted once
    codes = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    spoken = (
        articles.select(F.col("pmid").alias("source_id"), F.lower("language").alias("code"))
        .filter(F.col("source_id").isNotNull() & F.col("code").isNotNull() & (F.col("code") != "und"))
        .groupBy("source_id").agg(F.min("code").alias("code"))
        .select("source_id", F.coalesce(codes[F.col("code")], F.col("code")).alias("article_lang"))
    )
    asked = (F.col("source") == "pubmed") & F.col("lang").isNull()
    silent = once.filter(F.coalesce(asked, F.lit(False))).join(spoken, "source_id", "left").withColumn("lang", F.col("article_lang")).drop("article_lang")
    rest = once.filter(~F.coalesce(asked, F.lit(False)))
    return rest.unionByName(silent).select(
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("lang", F.lit("und")).alias("language"),
        F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit("(none)"))).alias("topics"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
    )


def token_cube(counts: DataFrame) -> DataFrame:
    """Cube of ``source, language, topic`` with ``n_chunks`` and ``n_tokens``; ``(all)`` marks a total.

    Totals over topics count a chunk of several topics once; a row of one topic counts each of its
    chunks (once, also where the topic is listed twice).
    """
    # written once: both cubes read it, and the texts behind it are counted once
    slim = cut_lineage(counts.groupBy("source", "language", "topics").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")))
    sums = [F.sum("n").alias("n_chunks"), F.sum("t").alias("n_tokens")]
    name = lambda c: F.when(F.grouping(c) == 1, F.lit(ALL)).otherwise(F.col(c)).alias(f"{c}_")
    whole = slim.cube("source", "language").agg(name("source"), name("language"), *sums).withColumn("topic_", F.lit(ALL))
    by_topic = slim.select("source", "language", "n", "t", F.explode(F.array_distinct("topics")).alias("topic"))
    part = by_topic.groupBy("source", "language", "topic").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    part = part.withColumn("topic", F.coalesce("topic", F.lit("(none)")))
    part = part.groupingSets(
        [["topic"], ["source", "topic"], ["language", "topic"], ["source", "language", "topic"]], "source", "language", "topic"
    ).agg(name("source"), name("language"), F.col("topic").alias("topic_"), *sums)
    columns = [F.col("source_").alias("source"), F.col("language_").alias("language"), F.col("topic_").alias("topic"), "n_chunks", "n_tokens"]
    return whole.select(*columns).unionByName(part.select(*columns))


def token_budget(chunks: DataFrame, articles: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Tokens and chunks of every slice of ``chunks``; an empty table gives a cube of no or null totals."""
    return token_cube(unique_chunk_tokens(chunks, articles, vocabulary_path))
