"""Reading and writing the corpus: JSON lines as exchanged, parquet tables as kept.

Topic and source are partitions, so that a read of one topic touches its files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import schemas as S
from lamina.functions.text import file_name

DDL = {"article": S.ARTICLE_DDL, "drug": S.DRUG_DDL, "guideline": S.GUIDELINE_DDL, "table": S.TABLE_DDL, "image": S.IMAGE_DDL, "chunk": S.CHUNK_DDL}
DEFAULTS = {"article": {"source": "pubmed"}, "drug": {"source": "openfda"}, "guideline": {"source": "who"}, "image": {"image_type": "embedded"}, "chunk": {"chunk_type": "text"}}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) is there, in whatever file system it names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_json(spark: SparkSession, path: str, kind: str, multiline: bool = False) -> DataFrame:
    """Records of a kind from JSON lines (or one document a file).

    A missing path is an empty table. Malformed lines and records without a required field fail the
    read; unknown keys are ignored, and missing defaults filled in.
    """
    ddl = DDL[kind]
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    df = spark.read.schema(ddl).option("mode", "FAILFAST").option("multiLine", multiline).json(path)
    df = df.na.fill(DEFAULTS.get(kind, {}))
    lacking = [F.when(F.col(c).isNull(), F.lit(c)) for c in S.REQUIRED[kind]]
    guard = F.array_compact(F.array(*lacking))
    first = df.columns[0]
    checked = F.when(F.size(guard) > 0, F.raise_error(F.concat(F.lit(f"{kind} without "), F.array_join(guard, ", ")))).otherwise(F.col(first))
    return df.withColumn(first, checked.cast(df.schema[first].dataType))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are left out. Articles are appended (``mode="append"``), all else replaced."""
    df.write.mode(mode).json(path)


def read_table(spark: SparkSession, path: str, ddl: str, **partition: str) -> DataFrame:
    """A parquet table, or an empty one of that type; partition values prune what is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    df = spark.read.parquet(path)
    for column, value in partition.items():
        df = df.filter(F.col(column) == value)
    return df


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks under each of their topics (``topic=...``, blanks as underscores), replacing the topics written.

    Files are written by topic, so a topic's files are as many as its size asks for.
    """
    fanned = chunks.withColumn("topic", F.explode("topics")).withColumn("topic", file_name(F.col("topic")))
    writer = fanned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "topic")
    writer.parquet(path)


def load_chunks(spark: SparkSession, path: str, source: str | None = None, topic: str | None = None) -> DataFrame:
    wanted = {k: v for k, v in (("source", source), ("topic", topic and topic.replace(" ", "_"))) if v}
    return read_table(spark, path, S.CHUNK_DDL + ", topic string", **wanted)


def save_tables(tables: DataFrame, path: str, topic: str | None = None) -> None:
    """Tables (page_number, table_data) of one topic, or of the topics in the column ``topic``."""
    named = F.lit(topic) if topic is not None else F.col("topic")
    tables.select(named.alias("topic"), "page_number", "table_data").withColumn("part", file_name(F.col("topic"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def load_tables(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    wanted = {"part": topic.replace(" ", "_")} if topic else {}
    return read_table(spark, path, S.TABLE_DDL + ", part string", **wanted).select("topic", "page_number", "table_data")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """``filename, data`` of the files of a folder; none where there is no such folder."""
    if not exists(spark, path):
        return spark.createDataFrame([], "filename string, data binary")
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content").alias("data"))


def load_images_data(spark: SparkSession, path: str) -> DataFrame:
    """``filename, data`` of the images of a table, in the form of :func:`load_files`."""
    return read_table(spark, path, S.IMAGE_DDL + ", data binary").select("filename", "data")


def scan(spark: SparkSession, pattern: str, kind: str) -> DataFrame:
    """Records of a kind from all files that match a pattern, with the ``file`` each came from."""
    df = read_json(spark, pattern, kind)
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)) if exists(spark, pattern) else df.withColumn("file", F.lit(None).cast("string"))


def save_embeddings(chunks: DataFrame, path: str, vector: str = "embedding") -> None:
    """Index columns and vector in one row; texts and metadata stay with the chunks."""
    chunks.select("point_id", "chunk_id", "topics", "source_id", "chunk_type", F.col(vector).cast("array<float>").alias("embedding"), "source").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("source").parquet(path)


def save_image_embeddings(images: DataFrame, path: str, vector: str = "embedding") -> None:
    images.select("filename", "topics", "page_number", "image_type", F.col(vector).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str, source: str | None = None, dimensions: int | None = None) -> DataFrame:
    """Rows with their vectors. A missing path fails; with ``dimensions`` a vector of another length does."""
    df = spark.read.parquet(path)
    if source is not None:
        df = df.filter(F.col("source") == source)
    if dimensions is not None:
        wrong = F.raise_error(F.concat(F.lit("vector of length "), F.size("embedding").cast("string")))
        df = df.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(wrong.cast(T.ArrayType(T.FloatType()))))
    return df


def load_image_embeddings(spark: SparkSession, path: str, dimensions: int | None = None) -> DataFrame:
    return load_embeddings(spark, path, dimensions=dimensions)


def save_images(images: DataFrame, path: str) -> None:
    """Image bytes and their metadata by topic; the topics written are replaced."""
    kept = images.select("topic", "page_number", "image_index", "filename", "width", "height", "image_type", "data")
    kept.withColumn("part", file_name(F.col("topic"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def load_image_table(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Metadata of images, without their bytes; none where nothing is stored."""
    wanted = {"part": topic.replace(" ", "_")} if topic else {}
    return read_table(spark, path, S.IMAGE_DDL + ", part string", **wanted).select(*[f.name for f in T._parse_datatype_string(S.IMAGE_DDL).fields])


def index_columns(df: DataFrame, kind: str = "text") -> DataFrame:
    """The columns of a text or image index."""
    names = [f.name for f in T._parse_datatype_string(S.TEXT_INDEX_DDL if kind == "text" else S.IMAGE_INDEX_DDL).fields]
    return df.select(*names)


def existing_keys(spark: SparkSession, path: str, kind: str = "article", key: str = "pmid") -> DataFrame:
    """Distinct ``topic, key`` of what is stored; none where nothing is."""
    return read_table(spark, path, DDL[kind]).select("topic", key).distinct()
