import numpy as np
from pyspark.sql import functions as F

from lamina.llm import skipgram as G


def test_pairs_are_counted_within_the_window():
    pairs = G.Pairs(10)
    pairs.add(np.array([1, 2, -1, 3]))
    pairs.add(np.array([2, 1]))
    w, c, n = (x.tolist() for x in pairs.flush())
    assert dict(zip(zip(w, c), n)) == {(1, 2): 2, (2, 1): 2, (2, 3): 1, (3, 2): 1} and len(pairs.flush()[0]) == 0


def test_words_that_share_neighbours_fit_them(spark):
    """Two groups of words, each with neighbours of its own: a word fits the neighbours of its group, seen with it or not."""
    r = np.random.default_rng(3)
    rows = [(w, c) for w in range(40) for c in range(40) if w != c and w // 20 == c // 20 and r.random() < 0.5]
    counted = spark.createDataFrame([(w, c, 20) for w, c in rows] + [(c, w, 20) for w, c in rows], "w int, c int, n long")
    words, contexts = G.train(G.by_word(counted), np.full(40, 500.0))
    fit = words @ contexts.T
    same = np.equal.outer(np.arange(40) // 20, np.arange(40) // 20)
    unseen = same.copy()
    for w, c in rows:
        unseen[w, c] = unseen[c, w] = False
    np.fill_diagonal(unseen, False)
    assert fit[same].mean() > fit[~same].mean() + 2 and fit[unseen].mean() > fit[~same].mean() + 1


def test_model_words_and_nothing(spark, empty):
    ids, often = G.model_words(spark.createDataFrame([("a", 9), ("b", 30), ("c", 4)], "word string, n long"))
    assert ids == {"b": 0, "a": 1} and often.tolist() == [30, 9]
    words, contexts = G.train(empty("w int, c int, n long"), np.zeros(0))
    assert words.shape == contexts.shape == (0, G.DIMENSIONS)
    words, _ = G.train(G.by_word(empty("w int, c int, n long").select("w", "c", F.col("n"))), np.ones(3))
    assert not words.any()
