import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import mix, split

PIECES = st.lists(st.sampled_from(["word ", "Ende. ", "\n", "\n\n", "a | b", "x", "。", "é", "́", "longer phrase, "]), max_size=200).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(5, 60), st.integers(0, 20))
def test_pieces_are_within_the_limit_and_cover_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    cuts = split.cut_points(text, limit, overlap)
    starts, stops = [0, *(c - overlap for c in cuts)], [*cuts, len(text)]
    assert all(b - a <= limit for a, b in zip(starts, stops)) and cuts == sorted(set(cuts))
    assert text[: stops[0]] + "".join(text[c:e] for c, e in zip(cuts, stops[1:])) == text
    assert (len(cuts) > 0) == (len(text) > limit)


def test_an_overlap_that_does_not_fit_is_refused(spark):
    for overlap in (-1, 20, 30):
        with pytest.raises(ValueError):
            split.cut_points("x" * 50, 20, overlap)
        with pytest.raises(ValueError):
            split.split_items(spark.createDataFrame([("f", 1, "x")], "item_field string, item_id long, body string"), spark.createDataFrame([("f", 20, overlap)], "item_field string, max_chars int, overlap_chars int"))


def test_pieces_are_balanced_and_cut_at_sentences():
    r = random.Random(8)
    text = "".join(" ".join("word" * r.randint(1, 2) for _ in range(r.randint(5, 12))) + ". " for _ in range(300))
    cuts = split.cut_points(text, 1300, 100)
    sizes = [b - a for a, b in zip([0, *(c - 100 for c in cuts)], [*cuts, len(text)])]
    assert len(sizes) <= 2 + -(-(len(text) - 100) // 1200) and min(sizes) > 0.6 * max(sizes) and sum(text[c - 2 : c] == ". " for c in cuts) >= 0.8 * len(cuts)


def test_strongest_boundary_near_the_target():
    text = "a" * 40 + ". " + "b" * 6 + "\n\n" + "c" * 50
    assert split.cut_points(text, 60, 0) == [50]


def test_items(spark, empty):
    limits = spark.createDataFrame([("f", 20, 5)], "item_field string, max_chars int, overlap_chars int")
    rows = [("f", 1, "short"), ("f", 2, ""), ("f", 3, None), ("f", 4, "One two three. Four five six. Seven."), ("g", 5, "no limit" * 9), ("f", 6, "x" * 200_000), ("f", None, "no id " * 9)]
    items = spark.createDataFrame(rows, "item_field string, item_id long, body string").withColumns({"piece": F.lit(1), "max_chars": F.lit(2)})
    got = split.split_items(items, limits).orderBy("item_id", "piece_no").collect()
    assert {r["item_id"] for r in got} == {1, 2, 4, 6, None} and all(r["n_chars"] <= 20 and len(r["piece"]) == r["n_chars"] for r in got)
    four = [r["piece"] for r in got if r["item_id"] == 4]
    assert all(b.startswith(a[-5:]) for a, b in zip(four, four[1:]))
    assert split.split_items(empty("item_field string, item_id long, body string"), limits).count() == 0
    grid = spark.createDataFrame([([["a", None], ["b"], None],), ([],), (None,)], "t array<array<string>>")
    assert [r[0] for r in grid.select(split.table_text("t")).collect()] == ["a | \nb\n", "", None]


def test_flight_keeps_documents_and_tokens():
    r = random.Random(2)
    units = [["s", i, r.choice([100, 100, 250, 300, 5000]), 0.37] for i in range(3000)]
    flight, done = mix.Flight("x"), []
    for u in units:
        done += flight.take(list(u))
    done += flight.land()
    taken = [u for u in done if u[3] > 0.5]
    assert len(done) == 3000 and all(u[3] < 1e-6 or u[3] > 1 - 1e-6 for u in done)
    assert abs(len(taken) - 1110) <= 2
    assert abs(sum(u[2] for u in taken) - 0.37 * sum(u[2] for u in units)) <= 5100


def documents(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["word"] * r.randint(1, 60)), r.choice(["a", "a", "a", "b", "c"])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "b"), (5002, "text", None), (5003, "text", "other"), (None, "no id here", "a"), (7, "again", "b"), (7, "again", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.45, 3), ("c", 0.2, 1), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mix.mix_sources(documents(spark), targets)
    rows = {r["source"]: r for r in report.collect()}
    most = {"a": 1, "b": 3, "c": 1}
    copies = mixture.collect()
    assert all(1 <= r["copies"] <= most[r["source"]] for r in copies) and len({r["doc_id"] for r in copies}) >= len(copies) - 2
    for s in "ab":
        assert rows[s]["feasible"] and abs(rows[s]["used_tokens"] - rows[s]["goal_tokens"]) <= 130
    assert not rows["none"]["feasible"] and rows["none"]["used_tokens"] == 0
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    short = {r["source"] for r in mix.short_sources(documents(spark), targets).collect()}
    assert short == {s for s, r in rows.items() if not r["feasible"]}


def test_shares_are_kept(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    rows = {r["source"]: r for r in mix.mix_sources(documents(spark), targets, keep="shares")[1].collect()}
    assert not rows["b"]["feasible"] and all(abs(r["actual_share"] - r["target_share"]) < 0.02 for r in rows.values())
    assert rows["b"]["used_tokens"] == rows["b"]["tokens"] and rows["b"]["share_of_goal_size"] < 0.4
    with pytest.raises(ValueError):
        mix.mix_sources(documents(spark), targets, keep="all")


def test_no_documents(spark, empty):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    none = empty("doc_id long, text string, source string")
    mixture, report = mix.mix_sources(none, targets)
    assert mixture.count() == 0 and report.first()["actual_share"] == 0.0
    assert mix.short_sources(none, targets).count() == 0


def test_words_are_cut_only_without_a_boundary():
    words = "mabufumutidine " * 300
    for length in range(1000, 3600, 3):
        text = words[:length]
        for limit, overlap in ((290, 20), (1207, 120)):
            assert all(text[c - 1] == " " for c in split.cut_points(text, limit, overlap))
    assert all(split.cut_points("x" * 1000, 300, 30))
