"""Chunks of articles, drug labels and guidelines: merged across topics, chunked once, with ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions.text import STAND_IN, Tokens, brand_key, canonical_id, point_id, table_text
from lamina.functions.text import sentences
from lamina.operators.chunking import Splitter, by_sentences, sized, windows_with_prefix
from lamina.operators.dedup import merge_by_key
from lamina.operators.packing import packed
from lamina.schemas import METADATA_DDL

CHUNK_COLUMNS = ["chunk_id", "point_id", "text", "raw_text", "source", "topics", "source_id", "chunk_index", "chunk_type", "metadata"]


def metadata(**values: Column) -> Column:
    """The metadata of a chunk; what a producer does not know is null."""
    fields = [f.split(":")[0] for f in METADATA_DDL.removeprefix("struct<").removesuffix(">").split(",")]
    kinds = dict(f.split(":") for f in METADATA_DDL.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(*[values.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in fields])


def build_chunks(df: DataFrame, chunk_id: Column, text: Column, raw: Column, source: str, source_id: Column, kind: Column, meta: Column) -> DataFrame:
    return df.select(
        chunk_id.alias("chunk_id"), point_id(chunk_id).alias("point_id"), text.alias("text"), raw.alias("raw_text"), F.lit(source).alias("source"),
        "topics", source_id.alias("source_id"), F.col("chunk_index").cast("int").alias("chunk_index"), kind.alias("chunk_type"), meta.alias("metadata"),
    )


def with_topic_order(df: DataFrame, topics: DataFrame) -> DataFrame:
    """``df`` with ``topic_ord``; a topic that is not listed comes last."""
    return df.join(topics.select("topic", "topic_ord"), "topic", "left").withColumn("topic_ord", F.coalesce("topic_ord", F.lit(1 << 30)))


def article_chunks(articles: DataFrame, topics: DataFrame, budget: int = K.ARTICLE_TOKENS, tokens: Tokens = STAND_IN, splitter: Splitter = sentences) -> DataFrame:
    """Chunks of abstracts, one article a pmid; the title stands before each and is not counted.

    An empty or null abstract gives no chunk.
    """
    rows = with_topic_order(articles.select("pmid", "title", "abstract", "topic", "fetched_at"), topics)
    merged = merge_by_key(rows, "pmid", ["topic_ord", "fetched_at", "title"], "topic", ["title", "abstract"])
    cut = by_sentences(merged, "abstract", budget, splitter, tokens=tokens)
    return build_chunks(
        cut, F.concat("pmid", F.lit("_pubmed_"), "chunk_index"), F.concat("title", F.lit(": "), "chunk"), F.col("chunk"),
        "pubmed", F.col("pmid"), F.lit("text"), metadata(title=F.col("title")),
    )


def label_chunks(drugs: DataFrame, topics: DataFrame, budget: int = K.LABEL_TOKENS, tokens: Tokens = STAND_IN, splitter: Splitter = sentences) -> DataFrame:
    """Chunks of the seven sections of a label in their order, one label a brand (in any case).

    A section within the budget stays as it is; empty ones are passed over; one index runs through all.
    """
    rows = with_topic_order(drugs.withColumn("brand_key", brand_key(F.col("brand_name"))), topics)
    merged = merge_by_key(rows, "brand_key", ["topic_ord", "drug_id"], "topic", ["brand_name", *K.DRUG_SECTIONS])
    sections = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.lit(label).alias("label"), F.col(f).alias("body")) for i, (f, label) in enumerate(K.DRUG_SECTIONS.items())])
    long = merged.select("brand_key", "brand_name", "topics", F.explode(sections).alias("s")).select("brand_key", "brand_name", "topics", "s.*").filter(F.coalesce("body", F.lit("")) != "")
    counted = long.withColumn("n", tokens.count(F.col("body")))
    small = counted.filter(F.col("n") <= budget).withColumns({"piece_no": F.lit(0), "chunk": F.col("body")})
    large = by_sentences(counted.filter(F.col("n") > budget), "body", budget, splitter, tokens=tokens).withColumnRenamed("chunk_index", "piece_no")
    columns = ["brand_key", "brand_name", "topics", "ord", "field", "label", "piece_no", "chunk"]
    pieces = small.select(columns).unionByName(large.select(columns))
    pieces = pieces.withColumn("chunk_index", F.row_number().over(Window.partitionBy("brand_key").orderBy("ord", "piece_no")) - 1)
    return build_chunks(
        pieces, F.concat("brand_name", F.lit("_openfda_"), "chunk_index"), F.concat("brand_name", F.lit(" — "), "label", F.lit(": "), "chunk"), F.col("chunk"),
        "openfda", F.col("brand_name"), F.lit("text"), metadata(field=F.col("field")),
    )


def table_pieces(tables: DataFrame, limit: int = K.TABLE_TOKENS, window: int = K.WINDOW_TOKENS, floor: int = K.WINDOW_FLOOR, tokens: Tokens = STAND_IN) -> DataFrame:
    """Texts of tables (doc_key, title, table_ord, page_number, table_data) as they go into chunks.

    A table within the limit is one piece; a larger one is cut into groups of rows, and a group that
    passes the window with its prefix into windows of tokens. Empty tables are a piece as well.
    """
    body = table_text(F.col("table_data"))
    counted = tables.withColumn("body", F.coalesce(body, F.lit(""))).withColumn("n", tokens.count(F.col("body")))
    heading = F.concat("title", F.lit(" (table, page "), "page_number")
    nothing = F.lit(None).cast("int")
    atomic = counted.filter(F.col("n") <= limit).withColumns(
        {"group_no": F.lit(0), "sub_index": F.lit(0), "text": F.concat(heading, F.lit("): "), "body"), "raw": F.col("body"), "part": nothing, "parts": nothing, "sub": nothing, "subs": nothing}
    )
    rows = F.transform("table_data", lambda r: F.array_join(r, " | ", ""))
    large = counted.filter(F.col("n") > limit).withColumn("_rows", rows).withColumn("_r", packed(sized(F.col("_rows"), tokens), limit))
    grouped = large.withColumn("parts", F.size("_r")).select("*", F.posexplode("_r").alias("group_no", "_g"))
    grouped = grouped.withColumns(
        {"part": F.col("group_no") + 1, "content": F.array_join(F.slice("_rows", F.col("_g.start") + 1, F.col("_g.len")), "\n"), "prefix": F.concat(heading, F.lit(", part "), F.col("group_no") + 1, F.lit("/"), "parts", F.lit("): "))}
    )
    cut = windows_with_prefix(grouped, "content", "prefix", window, floor, tokens)
    several = F.col("n_subs") > 1
    cut = cut.withColumns({"text": F.col("piece"), "raw": F.col("piece"), "sub": F.when(several, F.col("sub_index") + 1), "subs": F.when(several, F.col("n_subs"))})
    columns = ["doc_key", "title", "topics", "table_ord", "page_number", "group_no", "sub_index", "text", "raw", "part", "parts", "sub", "subs"]
    return atomic.select(columns).unionByName(cut.select(columns))


def guideline_chunks(guidelines: DataFrame, tables: DataFrame, topics: DataFrame, budget: int = K.GUIDELINE_TOKENS, limit: int = K.TABLE_TOKENS, window: int = K.WINDOW_TOKENS, floor: int = K.WINDOW_FLOOR, tokens: Tokens = STAND_IN, splitter: Splitter = sentences) -> DataFrame:
    """Chunks of guideline documents, one document a ``source_url``: its text first, then its tables.

    The tables are those of the document's first row. The id is made of the sorted topics, ``topics``
    keeps their order; one index runs through text and tables. Adds ``doc_key``, the id of the first row,
    since two documents on the same topics have chunk ids in common.
    """
    rows = with_topic_order(guidelines.select("guideline_id", "title", "topic", "clean_text", "source_url"), topics)
    merged = merge_by_key(rows, "source_url", ["topic_ord", "guideline_id"], "topic", ["title", "clean_text", "guideline_id"]).withColumnRenamed("guideline_id", "doc_key")
    text = by_sentences(merged.select("doc_key", "title", "topics", "clean_text"), "clean_text", budget, splitter, tokens=tokens).select(
        "doc_key", "title", "topics", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), F.col("chunk_index").alias("b"), F.lit(0).alias("c"),
        F.concat("title", F.lit(": "), "chunk").alias("text"), F.col("chunk").alias("raw"), metadata(title=F.col("title")).alias("metadata"),
    )
    attached = tables.select(F.col("guideline_id").alias("doc_key"), F.col("table_id").alias("table_ord"), "page_number", "table_data").join(merged.select("doc_key", "title", "topics"), "doc_key")
    pieces = table_pieces(attached, limit, window, floor, tokens).select(
        "doc_key", "title", "topics", F.lit(1).alias("kind"), F.col("table_ord").alias("a"), F.col("group_no").alias("b"), F.col("sub_index").alias("c"), "text", "raw",
        metadata(
            title=F.col("title"), page_number=F.col("page_number"), table_part=F.col("part"), table_parts_total=F.col("parts"),
            token_split_part=F.col("sub"), token_split_parts_total=F.col("subs"),
        ).alias("metadata"),
    )
    numbered = text.unionByName(pieces).withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_key").orderBy("kind", "a", "b", "c")) - 1)
    kind = F.when(F.col("kind") == 0, F.lit("text")).otherwise(F.lit("table"))
    numbered = numbered.withColumn("_kind", kind).withColumn("_id", canonical_id(F.col("topics")))
    out = build_chunks(
        numbered.withColumn("_meta", F.col("metadata")), F.concat("_id", F.lit("_who_"), "_kind", F.lit("_"), "chunk_index"), F.col("text"), F.col("raw"), "who", F.col("_id"), F.col("_kind"), F.struct("doc_key", "_meta")
    )
    return out.select(*CHUNK_COLUMNS[:-1], F.col("metadata._meta").alias("metadata"), F.col("metadata.doc_key").alias("doc_key"))


#: Chunkers by source.
CHUNKERS = {"pubmed": article_chunks, "openfda": label_chunks, "who": guideline_chunks}
