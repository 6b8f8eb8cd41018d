import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import budget, encode
from lamina.llm.tokenizers import SPLIT_PATTERN, PerfectHash, counter, default_vocabulary, encoder, vocabulary

TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tabcdefghij'0123é中")), max_size=80)


@pytest.fixture(scope="module")
def known():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=vocabulary(default_vocabulary()).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_count_and_ids_are_exact(known, text):
    want = known.encode_ordinary(text)
    assert encoder(default_vocabulary()).encode([text])[0] == want
    assert counter(default_vocabulary()).count(text) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.text("abeinorst'1", min_size=1, max_size=300))
def test_long_pieces(known, text):
    want = known.encode_ordinary(text)
    assert encoder(default_vocabulary()).encode([text])[0] == want and counter(default_vocabulary()).count(text) == len(want)


def test_perfect_hash_finds_every_key():
    keys = [f"key{i}".encode() for i in range(5000)]
    table = PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(5000))
    assert sorted(table.slot_of.tolist()) == list(range(5000))


def test_documents(spark, empty, known):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "<|endoftext|> naïve 𠮷👩‍⚕️"), (5, "a b " * 50_000), (5, "a b " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = sorted((r["doc_id"], r["ids"]) for r in encode.document_ids(df).collect())
    assert got == sorted((i, known.encode_ordinary(t) if t else []) for i, t in rows)
    assert encode.document_ids(empty("doc_id long, text string")).count() == 0


CHUNKS = "chunk_id string, text string, source string, topics array<string>, source_id string, lang string, written_at timestamp, metadata struct<title:string>"


def test_budget_counts_a_chunk_once_and_a_topic_each(spark, empty, known):
    import datetime

    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [
        ("a", "one two", "pubmed", ["x", "y"], "1", None, at(1), None),
        ("a", "one two", "pubmed", ["x", "y"], "1", None, at(2), None),
        ("b", "three", "who", ["x", "x"], "d", None, at(1), None),
        ("c", None, None, None, None, "de", None, None),
        (None, "four", "who", [], "d", "en", at(1), None),
        (None, "four", "who", [], "d", "en", at(1), None),
    ]
    articles = spark.createDataFrame([("1", "und"), ("1", "fre"), ("2", "eng")], "pmid string, language string")
    got = {(r["source"], r["language"], r["topic"]): (r["n_chunks"], r["n_tokens"]) for r in budget.token_budget(spark.createDataFrame(rows, CHUNKS), articles).collect()}
    n = {t: len(known.encode_ordinary(t)) for t in ("one two", "three", "four")}
    assert got[("pubmed", "fr", "(all)")] == (1, n["one two"]) and got[("pubmed", "fr", "x")] == (1, n["one two"])
    assert got[("(all)", "(all)", "(all)")] == (5, n["one two"] + n["three"] + 2 * n["four"])
    assert got[("(all)", "(all)", "x")] == (2, n["one two"] + n["three"]) and got[("unknown", "de", "(none)")] == (1, 0)
    assert got[("who", "en", "(none)")] == (2, 2 * n["four"])
    budget.token_budget(empty(CHUNKS), articles).collect()
