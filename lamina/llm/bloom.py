"""Bloom filters over 64-bit hashes, built by partition and merged by segment.

A filter is made of segments of one size; a key sets its bits in one of them, so a filter of any number
of keys keeps its rate of false positives and is built, merged and kept by segment. Partitions pass on
a segment as the few positions they set or, where that is shorter, as its bits; merging reads them as a
stream. Up to ``SHARD`` segments are broadcast at once; a larger filter is used shard by shard, over rows
written by shard (``each_shard``), so that what is broadcast never grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.session import scratch

#: Bits of a filter per key.
BITS_PER_KEY = 12
HASHES = 3
#: Bytes of a segment, the unit in which filters are merged.
SEGMENT = 1 << 16
#: Segments of a shard, what is broadcast at once: 32 MB, for about 22 million keys.
SHARD = 512


def filter_segments(keys: int) -> int:
    """Segments for so many keys."""
    return max(1, -(-keys * BITS_PER_KEY // (SEGMENT * 8)))


def filter_bits(keys: int) -> int:
    """Bits of a filter that is broadcast whole: for so many keys, or those of one shard.

    Beyond a shard's worth of keys more pass than need; for uses that only spare work by it.
    """
    return min(filter_segments(keys), SHARD) * SEGMENT * 8


def _mixed(hashes: np.ndarray) -> np.ndarray:
    h = np.ascontiguousarray(hashes, np.int64).view(np.uint64)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (_mixed(hashes) >> np.uint64(32)).astype(np.int64) * segments >> 32


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key (long), in the JVM."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, one row a hash, all in its segment."""
    h = np.ascontiguousarray(hashes, np.int64).view(np.uint64)
    base = segment_of(hashes, bits // (SEGMENT * 8)) * (SEGMENT * 8)
    second = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17) | np.uint64(1)
    return (((h + np.arange(HASHES, dtype=np.uint64)[:, None] * second) % np.uint64(SEGMENT * 8)).astype(np.int64) + base).T


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether the filter holds it or seems to."""
    return _all_set(bitmap, _positions(hashes, len(bitmap) * 8))


def hashes_of(texts: list[str]) -> np.ndarray:
    """The hashes Spark's ``xxhash64`` gives one string column."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 42) for t in texts), np.uint64, len(texts)).view(np.int64)


def _all_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def _add(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, at.ravel() >> 3, (1 << (at.ravel() & 7)).astype(np.uint8))


def _packed(part: np.ndarray) -> bytes:
    """A segment as its set positions (four bytes each) or its bits, whichever is shorter."""
    set_ = np.flatnonzero(np.unpackbits(part, bitorder="little")).astype("<u4") if np.count_nonzero(part) * 4 < SEGMENT else None
    return set_.tobytes() if set_ is not None and len(set_) * 4 < SEGMENT else part.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(SEGMENT, np.uint8)
    at = np.frombuffer(data, "<u4")
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def merged_filter(hashes: DataFrame, bits: int, repeated: bool) -> np.ndarray:
    """Filter of the hashes (one long column) that occur, or with ``repeated`` more than once.

    ``bits`` are those of at most one shard. Every partition builds two filters, of hashes seen once
    and of those seen again, in one reading; a segment meets in one task and is merged as a stream.
    """
    if bits > SHARD * SEGMENT * 8:
        raise ValueError("a filter of more than one shard is built shard by shard")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values, counts = np.unique(batch.iloc[:, 0].to_numpy(), return_counts=True)
            at = _positions(values, bits)
            if repeated:
                _add(again, at[(counts > 1) | _all_set(once, at)])
            _add(once, at)
        for s in range(bits // 8 // SEGMENT):
            a, b = once[s * SEGMENT : (s + 1) * SEGMENT], again[s * SEGMENT : (s + 1) * SEGMENT]
            if a.any():
                yield pd.DataFrame({"segment": [s], "once": [_packed(a)], "again": [_packed(b) if repeated else b""]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, once, again = -1, None, None
        out = lambda: pd.DataFrame({"segment": [at], "merged": [(again if repeated else once).tobytes()]})
        for batch in batches:
            for s, a, b in zip(batch["segment"], batch["once"], batch["again"]):
                a, b = _unpacked(a), _unpacked(b) if repeated else None
                if s != at:
                    if at >= 0:
                        yield out()
                    at, once, again = s, a, b
                    continue
                if repeated:
                    again = again | b | (once & a)
                once = once | a
        if at >= 0:
            yield out()

    spark = hashes.sparkSession
    parts = min(bits // 8 // SEGMENT, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    built = hashes.mapInPandas(build, "segment long, once binary, again binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in built.repartition(parts, "segment").sortWithinPartitions("segment").mapInPandas(merge, "segment long, merged binary").collect():  # at most a shard
        bitmap[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["merged"], np.uint8)
    return bitmap


def flag_held(df: DataFrame, key: str, bitmap: np.ndarray, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: whether the filter may hold ``key`` (long)."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf(T.BooleanType())
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, values.to_numpy()))

    return df.withColumn(out, test(F.col(key)))


def each_shard(df: DataFrame, key: str, keys: int, work: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``work`` done on the rows of each shard of ``key`` (long), with the bits of its filter, all together.

    Rows of equal keys are in one shard. Up to one shard's worth of keys the rows are worked on where
    they are. Beyond, they are written once by shard to the checkpoint folder, without a shuffle, and the
    results of a shard are written before the next one's filter is made: each row is read once again,
    and one filter is broadcast at a time.
    """
    shards = -(-filter_segments(keys) // SHARD)
    if shards == 1:
        return work(df, filter_segments(keys) * SEGMENT * 8)
    spark = df.sparkSession
    folder = scratch(spark, "shards")
    df.withColumn("_shard", shard_of(F.col(key), shards)).write.partitionBy("_shard").parquet(f"{folder}/rows")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_shard", T.IntegerType())])).parquet(f"{folder}/rows")
    for s in range(shards):
        done = work(rows.filter(F.col("_shard") == s).drop("_shard"), filter_bits(-(-keys // shards)))
        done.write.mode("append").parquet(f"{folder}/done")
    return spark.read.schema(done.schema).parquet(f"{folder}/done")
