"""Similarity of vectors: a stated query set against all rows, and neighbours in an order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.vectors import cosine

#: Query vectors multiplied at once, and bytes of queries that one pass over the rows carries.
BLOCK, CARRIED = 1024, 1 << 25


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, digits: int = 6) -> DataFrame:
    """``query, neighbour, similarity, rank``: the ``k`` rows most alike each query, itself left out.

    Queries are broadcast as one matrix of at most ``CARRIED`` bytes and multiplied block by block with
    every batch of rows; more queries take more passes. Each task keeps the best ``k`` of its rows for a
    query, so only those are shuffled. Similarities are rounded, ties go to the smaller key. Vectors
    without length and null vectors are like nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).filter(F.col("vector").isNotNull())
    asked = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull())
    size = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    passes = max(1, -(-size[0] * (size[1] or 1) * 8 // CARRIED))
    few = None
    for p in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == p).toPandas()  # about CARRIED bytes
        own = part["key"].to_numpy(np.int64)
        matrix = np.array(part["vector"].tolist(), float) if len(part) else np.zeros((0, 1))
        found = rows.mapInPandas(_best(spark.sparkContext.broadcast((own, matrix)), k, digits), "query long, neighbour long, similarity double")
        few = found if few is None else few.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return few.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(shared, k: int, digits: int):
    """The best ``k`` rows of a task for each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, matrix = shared.value
        length = np.linalg.norm(matrix, axis=1)
        best: list[pd.DataFrame | None] = [None] * -(-len(own) // BLOCK)
        for batch in batches:
            keys = batch["key"].to_numpy()
            v = np.array(batch["vector"].tolist(), float)
            for b in range(len(best)):
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                both = length[at, None] * np.linalg.norm(v, axis=1)[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    like = np.round(np.where(both > 0, matrix[at] @ v.T / both, -np.inf), digits)
                like[own[at, None] == keys[None, :]] = -np.inf
                n = min(k, like.shape[1])
                order = np.lexsort((np.broadcast_to(keys, like.shape), -like), axis=1)[:, :n]
                frame = pd.DataFrame({"query": np.repeat(own[at], n), "neighbour": keys[order].ravel(), "similarity": np.take_along_axis(like, order, 1).ravel()})
                frame = frame[np.isfinite(frame["similarity"])]
                frame = frame if best[b] is None else pd.concat([best[b], frame])
                best[b] = frame.sort_values(["query", "similarity", "neighbour"], ascending=[True, False, True]).groupby("query", sort=False).head(k)
        for frame in best:
            if frame is not None:
                yield frame

    return run


def of_pairs(vectors: DataFrame, pairs: DataFrame, key: str, vector: str, digits: int = 6) -> DataFrame:
    """``pairs`` (a, b, other columns) with the similarity of the vectors of each chosen pair.

    A pair with a key that has no vector gives no row.
    """
    side = lambda x: vectors.select(F.col(key).alias(x), F.col(vector).alias(f"_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", F.round(cosine(F.col("_a"), F.col("_b")), digits)).drop("_a", "_b")


def likeness_to_previous(df: DataFrame, vector: str, order: list[str], within: list[str], digits: int = 6) -> DataFrame:
    """``similarity`` of each row to the one before it in its group; null for the first.

    Rows are laid out by range, so that a hot group is shared by many tasks; the first row a task has
    of a group takes the vector before it from the last rows of the tasks before, one a task and group.
    """
    placed = df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part", *within).orderBy(*order)
    inside = placed.withColumn("_before", F.lag(vector).over(w)).withColumn("_at", F.row_number().over(w))
    last = placed.groupBy("_part", *within).agg(F.max_by(vector, F.struct(*order)).alias("_last"))
    over = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*within).orderBy("_part"))).drop("_last")
    joined = inside.join(over, ["_part", *within], "left").withColumn("_before", F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_before")))
    return joined.withColumn("similarity", F.round(cosine(F.col("_before"), F.col(vector)), digits)).select(*df.columns, "similarity")


def cosine_of(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(cosine(a, b), digits)


def zipped(index: DataFrame, vectors: DataFrame, place: str = "place", vector: str = "embedding") -> DataFrame:
    """Index rows with the vectors stored at the same place; a place that only one side has gives no row.

    For importing an index and a matrix kept apart; here both live in one row.
    """
    return index.join(vectors.select(place, vector), place)
