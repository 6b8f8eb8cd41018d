"""Skip-gram vectors with negative sampling, learned from the counted pairs of a whole corpus.

The words of the model are the most frequent ones, ``VOCABULARY`` at most, which bounds what is
broadcast; pairs of them within ``WINDOW`` are counted over all texts. The objective of skip-gram with
negative sampling over counts is a logistic one and, with the vectors of the contexts held, falls apart
into one problem a word. So words and contexts are fitted in turn by gradient steps, each turn one pass
over the pairs, every word by itself: a partition needs no other one's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Words of a model at most: two matrices of 8 MB.
VOCABULARY = 1 << 16
DIMENSIONS = 32
#: Occurrences from which a word is in the model.
LEAST = 5
WINDOW = 2
#: Negative samples a pair, and contexts they are drawn from in a turn.
NEGATIVES, DRAWN = 5, 512
#: What the product of two vectors lacks of the logarithm of how much more often than by chance they meet.
CHANCE = float(np.log(NEGATIVES))
TURNS, STEPS, RATE, DECAY = 3, 15, 0.5, 1e-3
#: Pairs fitted at once.
AT_ONCE = 1 << 18


class Pairs:
    """Counts of pairs of word ids that stand near each other."""

    def __init__(self, size: int) -> None:
        self.size, self.codes, self.held = size, [], 0

    def add(self, ids: np.ndarray) -> None:
        """``ids`` of the words of one text in their order, -1 for those out of the model."""
        for by in range(1, WINDOW + 1):
            a, b = ids[:-by], ids[by:]
            near = (a >= 0) & (b >= 0)
            a, b = a[near], b[near]
            self.codes += [a * self.size + b, b * self.size + a]
            self.held += 2 * len(a)

    def flush(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, contexts and counts so far."""
        codes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.codes]), return_counts=True)
        self.codes, self.held = [], 0
        return codes // self.size, codes % self.size, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_words(starts: np.ndarray, contexts: np.ndarray, counts: np.ndarray, held: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Vectors of the words whose pairs begin at ``starts``, with the vectors of contexts held fixed.

    ``drawn`` are the vectors of contexts that stand for all others.
    """
    many = np.diff(np.append(starts, len(contexts)))
    word = np.repeat(np.arange(len(starts)), many)
    share = (counts / np.add.reduceat(counts, starts)[word]).astype(np.float32)
    seen = held[contexts]
    out = np.zeros((len(starts), held.shape[1]), np.float32)
    past = np.full_like(out, 1e-6)
    for _ in range(STEPS):
        near = share * (1 - _sigmoid(np.einsum("ij,ij->i", out[word], seen)))
        gradient = np.add.reduceat(near[:, None] * seen, starts, axis=0)
        gradient -= NEGATIVES / len(drawn) * _sigmoid(out @ drawn.T) @ drawn + DECAY * out
        past += gradient**2
        out += RATE * gradient / np.sqrt(past)
    return out


def _turn(pairs: DataFrame, held: np.ndarray, often: np.ndarray, seed: int) -> np.ndarray:
    spark = pairs.sparkSession
    chosen = np.random.default_rng(seed).choice(len(held), DRAWN, p=often)
    shared = spark.sparkContext.broadcast((held, held[chosen]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed, drawn = shared.value

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            w = frame["w"].to_numpy()
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            return pd.DataFrame({"w": w[starts], "vector": list(fit_words(starts, frame["c"].to_numpy(), frame["n"].to_numpy(np.float64), fixed, drawn))})

        rest: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            rest.append(batch)
            size += len(batch)
            if size > AT_ONCE:
                frame = pd.concat(rest)
                last = (frame["w"] == frame["w"].iat[-1]).to_numpy()
                if not last.all():
                    yield fit(frame[~last])
                rest, size = [frame[last]], int(last.sum())
        if size:
            yield fit(pd.concat(rest))

    out = np.zeros_like(held)
    fitted = pairs.mapInPandas(run, "w int, vector array<float>").toPandas()  # at most VOCABULARY rows
    if len(fitted):
        out[fitted["w"].to_numpy()] = np.stack(fitted["vector"].to_numpy())
    return out


def train(pairs: DataFrame, often: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of words and of contexts from ``pairs`` (w, c, n), each pair once and both ways round.

    ``pairs`` is sorted by ``w`` within partitions that hold all pairs of a word; ``often`` has the
    occurrences of each word of the model. A word without a pair has the zero vector.
    """
    words = contexts = np.random.default_rng(seed).normal(0, 1 / np.sqrt(DIMENSIONS), (len(often), DIMENSIONS)).astype(np.float32) * 2
    if not len(often):
        return words, contexts
    drawing = often**0.75 / (often**0.75).sum()
    for turn in range(TURNS):
        if turn % 2 == 0:
            words = _turn(pairs, contexts, drawing, seed + turn)
        else:
            contexts = _turn(pairs, words, drawing, seed + turn)
    return words, contexts


def model_words(vocabulary: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Ids of the words of a model, the most frequent of ``vocabulary`` (word, n), and their occurrences."""
    rows = vocabulary.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word", "n").collect()
    return {r["word"]: i for i, r in enumerate(rows)}, np.array([r["n"] for r in rows], float)


def by_word(pairs: DataFrame) -> DataFrame:
    """Counted pairs summed up and laid out as ``train`` reads them."""
    summed = pairs.groupBy("w", "c").agg(F.sum("n").alias("n"))
    spark = pairs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return summed.repartition(parts, "w").sortWithinPartitions("w")
