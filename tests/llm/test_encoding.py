import random

import pytest

from lamina.llm import encoding as E

CLEAN = [
    (1, "La señora comió después del café."), (2, "La señora comió después del café, ¿no?"), (3, "Он хорошо переносил лечение."), (4, "Он хорошо переносил лечение. 4"),
    (5, "Он хорошо переносил лечение. 5"), (6, "“Quoted” text … far more."), (7, "ATENÇÃO: NÃO interromper. À LA FIN, ÂGE > 65."), (8, "α-blocker ± β-blocker, Δ = 0.3. 𠮷田医院 ﬁve 👩‍⚕️"),
    (9, None), (10, ""), (11, "  "), (12, "plain ascii"), (13, "有效 治疗 有效"), (14, "有效 治疗 2"), (15, "有效 治疗 3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    broken = [
        (101, E.garble("La señora comió después del café.", (("utf-8", "cp1252"),))),
        (102, E.garble("Он хорошо переносил лечение.", (("koi8-r", "cp1252"),))),
        (103, "Nothing but caf� left"),
        (104, E.garble("“Quoted” text … far more.", (("utf-8", "cp1252"), ("utf-8", "cp1252")))),
        (105, "La señora " + E.garble("jamás", (("utf-8", "cp1252"),))),
        (106, E.garble("有效 治疗", (("gbk", "latin-1"),))),
        (108, "So l\u2019\u00e9quipe was l\u2019\u00e9quipe"),
        (109, "The sign \ufffd marks what was lost"),
        (110, "Kvor\ufffd\ufffdx xq\ufffdv"),
        (111, "O \ufffd\ufffd\ufffd\ufffd\ufffd\ufffd\ufffd\ufffd"),
        (107, E.garble("“Quoted” text", (("utf-8", "cp1251"),))),
    ]
    return spark.createDataFrame(CLEAN + broken + broken[:1] + [(None, broken[0][1])], "doc_id long, text string").selectExpr("*", "'x' AS word", "'y' AS original")


def test_garbled_documents_are_found_and_clean_ones_not(docs):
    assert sorted(r["doc_id"] or 0 for r in E.garbled_documents(docs).collect()) == [0, 101, 102, 103, 104, 105, 106, 107, 109, 110, 111]


def test_originals_come_back(docs):
    got = {r["doc_id"]: (r["restored"], r["complete"]) for r in E.restored_documents(docs).collect()}
    assert got[101] == ("La señora comió después del café.", True)
    assert got[102] == ("Он хорошо переносил лечение.", True)
    assert got[103] == ("Nothing but café left", True)
    assert got[104] == ("“Quoted” text … far more.", True)
    assert got[105] == ("La señora jamás", True)
    assert got[110] == ("Kvor\ufffd\ufffdx xq\ufffdv", False) and not got[111][1] and got[None][0] == got[101][0]
    assert got[106] == ("有效 治疗", True) and got[107] == ("“Quoted” text", True)


def test_every_chain_is_undone_or_says_nothing():
    for chain in E.CHAINS:
        form = E.garble("señora", chain)
        if form and chain in E._UNDONE:
            assert E.ungarble(form)[0] == "señora", chain


def test_forms_equal_decoding_byte_by_byte():
    r = random.Random(5)
    words = ["señora", "Лечение", "有效治疗", "ﬁve‑é", "𠮷x", "λόγος", *("".join(chr(r.choice([r.randint(0xA0, 0x24F), r.randint(0x400, 0x45F), r.randint(0x4E00, 0x9FFF)])) for _ in range(4)) for _ in range(60))]
    for chain in E.CHAINS:
        for word in words:
            want = word
            for source, target in chain:
                try:
                    data = want.encode(source)
                except UnicodeEncodeError:
                    want = None
                    break
                want = data.decode(target, "replace") if target in E.WIDE else "".join(bytes([b]).decode(target, "ignore") or chr(b) for b in data)
            assert E.garble(word, chain) == (None if want == word else want), (word, chain)


def test_round_trip_of_damaged_texts(spark):
    """Texts garbled under every chain come back, where the words are held clean elsewhere."""
    texts = ["La señora comió después del café", "“Quoted” text … far more", "Die Übelkeit wurde stärker"]
    rows = [(i, f"{texts[i % 3]} {i}") for i in range(12)]
    want = {}
    for chain in E.CHAINS:
        for t in texts:
            form = E.garble(t, chain)
            if form and chain[0][0] == "utf-8" and not any(c in form for c in "\ufffd\u0085\u00a0\u00ad") and form.split() == form.split(" "):
                want[1000 + len(want)] = t
                rows.append((999 + len(want), form))
    got = {r["doc_id"]: r["restored"] for r in E.restored_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 1000").collect()}
    right = sum(got.get(k) == t for k, t in want.items())
    assert len(want) > 60 and set(want) <= set(got) and right >= 0.9 * len(want), (right, len(want))


def test_a_source_garbled_as_a_whole(spark):
    """A third of the texts was read in another encoding: its words are half as frequent as the clean ones, and copies do not count."""
    r = random.Random(2)
    words = "лечение больной препарат давление сердце клиника анализ доза утром приём кашель отёк".split()
    texts = [" ".join(r.sample(words, 8)) for _ in range(60)]
    rows = [(i, t if i % 3 else E.garble(t, (("cp1251", "koi8-r"),))) for i, t in enumerate(texts)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one of them delivered again and again
    got = {r["doc_id"]: r["restored"] for r in E.restored_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {i for i in range(60) if i % 3 == 0} | set(range(1000, 1200))
    assert all(got[i] == texts[i] for i in range(0, 60, 3)) and got[1000] == texts[0]


def test_very_long_words(spark):
    word = "é" * 5000
    df = spark.createDataFrame([(1, word), (2, word), (3, E.garble(word, (("utf-8", "cp1252"),)))], "doc_id long, text string")
    assert [(r["doc_id"], r["restored"] == word) for r in E.restored_documents(df).collect()] == [(3, True)]


def test_empty(empty):
    none = empty("doc_id long, text string")
    assert E.garbled_documents(none).count() == 0 and E.restored_documents(none).count() == 0
