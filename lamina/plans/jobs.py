"""The runs of the corpus as jobs over whole tables; none loops over rows or topics on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions.text import brand_key
from lamina.operators import dedup, embedding, images, pages, parsing
from lamina.operators.sources_chunking import article_chunks, guideline_chunks, label_chunks, with_topic_order
from lamina.session import cut_lineage
from lamina.sources import documents, store


def topic_table(spark: SparkSession, topics: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(topics or K.TOPICS)], "topic string, topic_ord int")


def ingest_articles(spark: SparkSession, found: DataFrame, fetch, path: str, target: int = K.ARTICLES_PER_TOPIC) -> DataFrame:
    """Bring each topic up to ``target`` articles; gives ``topic, fetched, failed, skipped``.

    ``found`` has the search results (topic, pmid, rank), ``fetch`` maps chosen rows to raw payloads
    (topic, payload). A second run over the same results fetches nothing.
    """
    have = store.existing_keys(spark, path)
    chosen = dedup.new_keys(found, have, "topic", "pmid", "rank", target)
    ok, failed = parsing.parse_articles(cut_lineage(fetch(chosen)))  # fetched once, whatever reads it
    before = have.groupBy("topic").agg(F.count(F.lit(1)).alias("skipped"))
    counts = ok.groupBy("topic").agg(F.count(F.lit(1)).alias("fetched"))
    lost = failed.groupBy("topic").agg(F.count(F.lit(1)).alias("failed"))
    report = found.select("topic").distinct().join(counts, "topic", "left").join(lost, "topic", "left").join(before, "topic", "left").na.fill(0)
    rows = report.collect()  # one row a topic
    ok.write.mode("append").partitionBy("source").parquet(path)
    return spark.createDataFrame(rows, "topic string, fetched long, failed long, skipped long")


def label_tables(raw: DataFrame, most: int = K.LABELS_PER_TOPIC) -> tuple[DataFrame, DataFrame]:
    """Labels and failures of raw payloads (topic, seq, payload): parsed, one a brand and topic, capped."""
    ok, failed = parsing.parse_labels(raw, keep=("seq",))
    once = dedup.first_by_key(ok, ["topic", brand_key(F.col("brand_name"))], ["seq"])
    return dedup.capped(once, ["topic"], ["seq"], most), failed


def guideline_tables(files: DataFrame, topic_docs: DataFrame, extractor: documents.Extractor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Guidelines, tables and images of documents (doc, data), each read once whatever its topics.

    ``topic_docs`` has ``topic, topic_ord, title, doc``. Images are filtered, numbered by document and
    followed by the caption pages that no image stands on.
    """
    read = pages.clean_pages(documents.extract_pages(files, extractor))
    texts = pages.assemble(read).join(pages.assemble(read, text="raw").select("doc", F.col("full_text").alias("raw_text")), "doc")
    tables = read.select("doc", "page_number", F.posexplode("tables").alias("table_no", "table_data"))
    embedded = images.large_enough(documents.extract_images(files, extractor))
    embedded = images.without_blank(embedded, images.gray_deviation(F.col("data")))
    embedded = images.once_per_document(embedded, F.md5("data"), "doc", ["page_number", "image_index"])
    wanted = pages.figures_without_image(pages.figure_pages(read).select("doc", "page_number"), embedded)
    drawn = images.without_blank(documents.raster_pages(files, wanted, extractor), images.gray_deviation(F.col("data")))
    both = embedded.withColumn("kind", F.lit(0)).unionByName(drawn.withColumn("kind", F.lit(1)))
    per_topic = both.join(topic_docs.select("doc", "topic"), "doc")
    shown = images.renumbered(per_topic.withColumn("topic_doc", F.concat("doc", F.lit("\n"), "topic")), "topic_doc", "topic", "page_number", ["kind", "page_number", "image_index"]).drop("kind", "topic_doc")
    count = lambda df, name: df.groupBy("doc").agg(F.count(F.lit(1)).alias(name))
    out = topic_docs.join(texts, "doc").join(count(tables, "num_tables"), "doc", "left").join(count(both, "num_images"), "doc", "left").na.fill(0, ["num_tables", "num_images"])
    guidelines = out.select("title", "topic", F.col("full_text").alias("clean_text"), "raw_text", F.col("num_pages").cast("int"), F.col("num_tables").cast("int"), F.col("num_images").cast("int"), F.col("doc").alias("source_url"), F.lit("who").alias("source"))
    return guidelines, tables.join(topic_docs.select("doc", "topic"), "doc").select("topic", "page_number", "table_data"), shown


def guideline_run(files: DataFrame, lost: DataFrame, topic_docs: DataFrame, extractor: documents.Extractor) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
    """The tables of :func:`guideline_tables`, and ``topic, status, error`` of every topic.

    ``lost`` (doc, error) are the documents that could not be fetched; those that cannot be opened fail
    too. A topic whose document an earlier topic has brought is a success from it.
    """
    broken = lost.unionByName(documents.broken_documents(files, extractor))
    good = files.join(broken.select("doc"), "doc", "left_anti")
    told = dedup.with_first(topic_docs, "doc", "topic_ord", "first_ord").join(broken.groupBy("doc").agg(F.min("error").alias("error")), "doc", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("topic_ord") > F.col("first_ord"), "success (cached)").otherwise("success")
    return guideline_tables(good, topic_docs, extractor), told.select("topic", status.alias("status"), "error")


def image_corpus(shown: DataFrame, files: DataFrame, embed, topics: DataFrame, path: str, dimensions: int | None = None) -> DataFrame:
    """Vectors of unique images, written to ``path``; gives the images whose file is missing.

    ``shown`` has topic, page_number, filename, image_type; a missing file is passed over, equal images
    are embedded once with all their topics, and an image that cannot be embedded is dropped.
    """
    there, missing = images.with_file(with_topic_order(shown, topics), files)
    once = images.once_across_topics(there, F.md5("data"), ["topic_ord", "page_number", "filename"])
    data = there.groupBy(images.image_key(F.col("filename"), F.md5("data"), F.col("topic")).alias("key")).agg(F.min("data").alias("data"))
    store.save_image_embeddings(embedding.embed_images(once.join(data, "key"), embed, dimensions=dimensions), path)
    return missing


def chunk_corpus(articles: DataFrame, drugs: DataFrame, guidelines: DataFrame, tables: DataFrame, topics: DataFrame) -> DataFrame:
    """Chunks of all three sources."""
    return article_chunks(articles, topics).unionByName(label_chunks(drugs, topics)).unionByName(guideline_chunks(guidelines, tables, topics).drop("doc_key"))


def embed_corpus(chunks: DataFrame, provider: embedding.Provider, path: str) -> None:
    """Vectors of unique chunks, by source."""
    once = embedding.deduplicated(chunks, ["chunk_id"], within=["source"])
    store.save_embeddings(embedding.embed_texts(once, provider), path)
