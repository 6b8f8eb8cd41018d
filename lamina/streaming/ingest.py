"""Incremental ingestion of article files as a stream: each article is written once, whatever its deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from lamina.sources.store import exists, is_folder


def unique_articles(spark: SparkSession, source: str, ddl: str, at: str = "fetched_at", delay: str = "30 days", keys: tuple[str, ...] = ("topic", "pmid")) -> DataFrame:
    """A stream of the first delivery of each key; state older than ``delay`` is let go.

    A delivery later than that passes here and is stopped by the sink, which looks at the table itself.
    """
    reader = spark.readStream.schema(ddl)
    if is_folder(spark, source):
        stream = reader.parquet(source)
    else:  # a stream reads folders; one file is picked from its own by name
        folder, _, name = source.rpartition("/")
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("topic", "pmid")) -> StreamingQuery:
    """Append what the table ``target`` does not hold yet, batch by batch; a batch repeated after a failure adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        if exists(spark, f"{target}/*.parquet"):
            fresh = fresh.join(spark.read.parquet(target).select(*keys), list(keys), "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def topic_windows(stream: DataFrame, at: str = "fetched_at", delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Articles by topic and window of arrival; rows later than ``delay`` are left out."""
    from pyspark.sql import functions as F

    return stream.withWatermark(at, delay).groupBy(F.window(at, width), "topic").agg(F.count(F.lit(1)).alias("n_articles"))
