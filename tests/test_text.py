import uuid

from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.operators import chunking as C


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_abbreviations_end_no_sentence(spark):
    text = "Patients with HTN (e.g. those over 65 years) should be monitored closely. Treatment options vs. placebo were compared in Fig. 3 of the study."
    got = one(spark, text, T.sentences)
    assert len(got) == 2 and got[1].startswith("Treatment") and got[1].endswith("Fig. 3 of the study.")


def test_no_is_an_abbreviation_and_line_breaks_end_nothing(spark):
    assert one(spark, "The answer is no. Next\nline goes on.", T.sentences) == ["The answer is no. Next\nline goes on."]


def test_empty_and_null_texts(spark):
    assert one(spark, "", T.sentences) == [] and one(spark, None, T.sentences) is None
    assert one(spark, None, T.token_count) == 0 and one(spark, "", T.token_count) == 0


def test_lossless_tokens_give_the_text_back(spark):
    for text in ("a  b, c\n", " x 1234567 y", "ñandú—mañana… 你好", "   "):
        assert "".join(one(spark, text, T.lossless_tokens)) == text


def test_point_id(spark):
    for name in ("asthma+copd_who_text_0", "é—1", ""):
        assert one(spark, name, T.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, "asthma+copd_who_text_0", T.point_id) == "c7cc4fb0-da32-56df-96ee-2b079025335b"


def test_canonical_id_sorts_and_topics_do_not(spark):
    assert one(spark, ["copd", "asthma"], T.canonical_id, "array<string>") == "asthma+copd"


def test_furniture_goes_also_in_prose(spark):
    assert one(spark, "x World Health Organization (WHO) y\n12 of 40 patients", T.without_furniture) == "patients"


def test_captions(spark):
    assert [one(spark, x, T.has_caption) for x in ("see figure 3", "config. 3", "ALGORITHM 2")] == [True, False, True]


def test_table_text(spark):
    assert one(spark, [["x", None], ["", "y"]], T.table_text, "array<array<string>>") == "x | \n | y"


def test_phrase_and_any_word(spark):
    phrase = lambda x: T.says_phrase(x, "peptic ulcer")
    assert one(spark, "for Peptic  ulcer.", phrase) and not one(spark, "ulcer, not peptic", phrase) and not one(spark, "peptic ulcers", phrase)
    assert one(spark, "an ulcer", lambda x: T.says_any(x, "peptic ulcer"))


def test_sections_begin_at_the_first_repeated_header(spark):
    text = "Title\n1 Scope here 3\n\n2 Methods used 5\n\n1 Scope here\nBody one.\n2 Methods used\nBody two. More.\n"
    df = spark.createDataFrame([(1, text), (2, "No header. At all."), (3, None), (4, "")], "k int, t string")
    rows = sorted(map(tuple, C.by_sections(df, "k", "t").collect()))
    assert rows == [(1, 0, "1 Scope here\nBody one."), (1, 1, "2 Methods used\nBody two. More."), (2, 0, "No header. At all.")]


def test_paragraphs_above_the_budget_are_cut_by_sentences(spark):
    df = spark.createDataFrame([(1, "One two.\n\nA b c. D e f. G h i.\n \nLast one.")], "k int, t string")
    assert [r["chunk"] for r in C.by_paragraphs(df, "k", "t", 8).orderBy("chunk_index").collect()] == ["One two.", "A b c. D e f.", "G h i.", "Last one."]


def test_prefix_takes_its_part_of_the_window(spark):
    df = spark.createDataFrame([("a b c d e f g", "p q: "), ("a b", "p: ")], "c string, p string")
    rows = C.windows_with_prefix(df, "c", "p", 8, 2).orderBy("c", "sub_index").collect()
    assert [(r["piece"], r["n_subs"]) for r in rows] == [("p: a b", 1), ("p q: a b c d e", 2), ("p q:  f g", 2)]
    floor = C.windows_with_prefix(spark.createDataFrame([(" ".join("x" * 100), "p q r: ")], "c string, p string"), "c", "p", 50, 500)
    assert floor.count() == 1


def test_semantic_chunks_break_at_low_likeness(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 3], [1, 1, 1, 1], [None, 0.9, 0.1, 0.8])], "k int, i array<int>, n array<int>, s array<double>")
    assert [r["n_items"] for r in C.by_similarity(df, "i", "n", "s").orderBy("chunk_index").collect()] == [2, 2]
