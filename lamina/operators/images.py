"""Images of documents: filters, duplicates within a document and across topics."""

from __future__ import annotations

import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import constants as K
from lamina.operators.dedup import first_by_key


def large_enough(images: DataFrame, side: int = K.IMAGE_MIN_SIDE) -> DataFrame:
    """Images of at least ``side`` in width and height."""
    return images.filter((F.col("width") >= side) & (F.col("height") >= side))


def _gray_map(data: bytes):
    """Values of a binary gray map of one byte a value, or None."""
    import numpy as np

    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[3]) > 255:
        return None
    return np.frombuffer(data, np.uint8, int(m[1]) * int(m[2]), m.end()).astype(float)


@F.pandas_udf(T.DoubleType())
def gray_deviation(data: pd.Series) -> pd.Series:
    """Population deviation of the gray values of an encoded image; null where it cannot be decoded here.

    Binary gray maps (PGM) need no library, other formats an optional one.
    """
    try:
        from PIL import Image
    except ImportError:
        Image = None
    import numpy as np

    def one(b: bytes | None) -> float | None:
        try:
            gray = _gray_map(bytes(b))
            if gray is None:
                gray = np.asarray(Image.open(io.BytesIO(b)).convert("L"), dtype=float) if Image else None
            return None if gray is None else float(gray.std())
        except Exception:
            return None

    return pd.Series([one(b) for b in data], dtype="float64")


def without_blank(images: DataFrame, deviation: Column, least: float = K.IMAGE_MIN_STD) -> DataFrame:
    """Images that are not blank or nearly of one colour; those whose deviation is unknown stay."""
    return images.filter(deviation.isNull() | (deviation >= least))


def once_per_document(images: DataFrame, digest: Column, doc: str, order: list[str], most: int = K.IMAGE_MAX_REPEATS) -> DataFrame:
    """The first of equal images of a document; images more frequent than ``most`` are dropped in all copies."""
    hashed = images.withColumn("_hash", digest)
    copies = F.count(F.lit(1)).over(Window.partitionBy(doc, "_hash"))
    kept = hashed.withColumn("_copies", copies).filter(F.col("_copies") <= most)
    return first_by_key(kept, [doc, "_hash"], order).drop("_hash", "_copies")


def renumbered(images: DataFrame, doc: str, topic: str, page: str, order: list[str]) -> DataFrame:
    """``image_index`` anew by place in the document, and the file name made of topic, page and place."""
    placed = images.withColumn("image_index", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)
    return placed.withColumn("filename", F.concat(F.replace(F.col(topic), F.lit(" "), F.lit("_")), F.lit("_page"), F.col(page), F.lit("_img"), F.col("image_index"), F.lit(".png")))


def image_key(filename: Column, digest: Column, topic: Column) -> Column:
    """What makes images one: their bytes, but for cover pages the file name and topic."""
    return F.when(filename.rlike(K.COVER_PAGE), F.concat(filename, F.lit("_"), topic)).otherwise(digest)


def once_across_topics(images: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """One row per image with the topics it stands under, in order: ``key, filename, page_number, image_type, topics``."""
    from lamina.operators.dedup import merge_by_key

    keyed = images.withColumn("key", image_key(F.col("filename"), digest, F.col("topic")))
    return merge_by_key(keyed, "key", order, "topic", ["filename", "page_number", "image_type"])


def with_file(images: DataFrame, files: DataFrame, name: str = "filename") -> tuple[DataFrame, DataFrame]:
    """Images whose file is there, with its ``data``, and those whose file is missing.

    ``files`` has ``filename, data``, each name once or more; of several files of a name the first by content counts.
    """
    once = files.groupBy(F.col("filename").alias("_name")).agg(F.min("data").alias("data"))
    bare = images.drop("data")
    return bare.join(once, F.col(name) == F.col("_name")).drop("_name"), bare.join(once, F.col(name) == F.col("_name"), "left_anti")
