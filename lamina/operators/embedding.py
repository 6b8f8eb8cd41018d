"""Embedding of texts and images through providers, in batches with two budgets."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions.text import token_count
from lamina.operators.dedup import first_by_key
from lamina.operators.packing import pack_rows


class Provider(Protocol):
    """Gives one vector a text, in the order of the texts."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashedProvider:
    """A local stand-in for a model: signed counts of hashed words, of length one. Equal texts have equal vectors.

    A word is a run without white space; its place and sign are the first eight digits of its MD5.
    """

    dimensions: int = 256

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import math

        out = []
        for text in texts:
            vector = [0.0] * self.dimensions
            for word in text.split():
                h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                vector[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
            length = math.sqrt(sum(x * x for x in vector)) or 1.0
            out.append([x / length for x in vector])
        return out


def http_post(address: str, headers: dict, body: str) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(address, body.encode(), headers), timeout=60) as answer:
            return answer.status, answer.read().decode("utf-8")
    except HTTPError as e:
        return e.code, ""


@dataclass(frozen=True)
class RemoteProvider:
    """A model behind an address that takes ``{"model", "input"}`` and answers ``{"data": [{"index", "embedding"}]}``.

    The transport, (address, headers, body) to (status, body), is a parameter; another status than 200 raises.
    """

    address: str
    model: str
    key: str
    dimensions: int = 1536
    transport: Callable[[str, dict, str], tuple[int, str]] = http_post

    def embed(self, texts: list[str]) -> list[list[float]]:
        import json

        status, body = self.transport(self.address, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}, json.dumps({"model": self.model, "input": texts}))
        if status != 200:
            raise OSError(f"embedding: status {status}")
        return [x["embedding"] for x in sorted(json.loads(body)["data"], key=lambda x: x["index"])]


class Once:
    """An object that ``make`` builds where it is first used, once in each worker; it travels unbuilt."""

    _held: dict[str, object] = {}

    def __init__(self, name: str, make: Callable[[], object]) -> None:
        self.name, self.make = name, make

    def get(self) -> object:
        if self.name not in Once._held:
            Once._held[self.name] = self.make()
        return Once._held[self.name]


def with_retry(call: Callable[[], list[list[float]]], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The result of ``call``; failures are tried again after 2 and 4 seconds, the last one is raised."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            wait(2.0 * attempt)
    raise AssertionError


def embed_texts(df: DataFrame, provider: Provider, text: str = "text", out: str = "embedding", tokens: int = K.BATCH_TOKENS, most: int = K.BATCH_CHUNKS, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """``df`` with a vector of single precision for each text.

    Requests hold consecutive texts of one partition within both budgets, across the batches in which
    they arrive. A request that fails for good fails the job; null texts have no vector.
    """
    sized = df.drop(out).withColumn("_n", count(F.col(text)))
    columns = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + f", `{out}` array<float>"

    def vectors(texts: list[str]) -> list[list[float]]:
        got = with_retry(lambda: provider.embed(texts))
        if len(got) != len(texts) or any(len(v) != provider.dimensions for v in got):
            raise ValueError("provider gave vectors of another number or length")
        return got

    def done(frame: pd.DataFrame) -> pd.DataFrame:
        said = frame[text].notna().to_numpy()
        known = iter(vectors(frame[text][said].tolist()) if said.any() else [])
        return frame.drop(columns="_n").assign(**{out: pd.Series([next(known) if s else None for s in said], index=frame.index, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        total = held = 0
        for batch in batches:
            start = 0
            sizes = [int(n) if s else 0 for n, s in zip(batch["_n"], batch[text].notna())]
            for i, size in enumerate(sizes):
                if held and (total + size > tokens or held >= most):
                    yield done(pd.concat([*waiting, batch.iloc[start:i]]))
                    waiting, start, total, held = [], i, 0, 0
                total, held = total + size, held + 1
            waiting.append(batch.iloc[start:])
        if held:
            yield done(pd.concat(waiting))

    return sized.mapInPandas(run, schema)


def embed_images(df: DataFrame, embed: Callable[[bytes], list[float]] | Once, data: str = "data", out: str = "embedding", dimensions: int | None = None) -> DataFrame:
    """``df`` with a vector for each image; images that cannot be embedded are dropped.

    ``embed`` may be a model made once in each worker (:class:`Once`). With ``dimensions`` a vector of
    another length counts as a failure.
    """

    @F.pandas_udf("array<float>")
    def vectors(batch: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> list[float] | None:
            try:
                vector = [float(x) for x in (embed.get() if isinstance(embed, Once) else embed)(b)]
                return vector if dimensions in (None, len(vector)) else None
            except Exception:
                return None

        return pd.Series([one(b) for b in batch], dtype=object)

    return df.withColumn(out, vectors(F.col(data))).filter(F.col(out).isNotNull())


def request_batches(chunks: DataFrame, key: str, text: str, within: list[str], order: list[str], tokens: int = K.BATCH_TOKENS, most: int = K.BATCH_CHUNKS, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """``key`` and ``batch_id`` by exact greedy numbering in ``order`` within each group.

    The numbering is sequential by definition: a group is read by one task, as a stream. Texts stay
    behind; sizes and keys alone are shuffled. For embedding itself ``embed_texts`` numbers within partitions.
    """
    rows = chunks.select(*within, *[c for c in order if c not in within], *([key] if key not in [*within, *order] else []), count(F.col(text)).alias("n_tokens"))
    return pack_rows(rows, within, order, "n_tokens", tokens, most, out="batch_id")


def deduplicated(chunks: DataFrame, order: list[str], key: str = "point_id", within: list[str] | None = None) -> DataFrame:
    """The first chunk of each id, within each source if ``within`` names it."""
    return first_by_key(chunks, [*(within or []), key], order)
