import random

import pytest

from lamina.llm import layout, noise
from lamina.llm import sentences as S

VOCAB = "the nurse should record dosage before treatment while patients with hypertension rest community hospital district medicine guideline".split()


def kinds(text, title=None, running=(), tables=False):
    return [x.kind for x in layout.read_lines(text, title, frozenset(running), tables)]


def test_line_kinds():
    text = "Care of asthma\n1.1 Scope and purpose\nText goes on and\n- 11 -\nCARE 0F ASTHMA   12\nfurther.\n\nPage 3\n|4|\n3/14\n[l9]\nxii\n3 of 14"
    assert kinds(text, "Care of asthma") == ["header", "heading", "text", "page", "header", "text", "blank", "page", "page", "page", "page", "page", "page"]


def test_numbers_in_tables_are_no_pages():
    assert kinds("Site Dose\n10\n– 9\nn/a\n- 1 -\nx y\n- 2 -", tables=True) == ["text", "text", "text", "text", "page", "text", "page"]
    assert kinds("a b.\n7\nc d.\n8\nStock\n429\n9", tables=True) == ["text", "page", "text", "page", "text", "text", "page"]


def guidelines(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        lines = []
        for page in range(4):
            for _ in range(5):
                words = [r.choice(VOCAB) for _ in range(9)]
                lines.append(" ".join(words).capitalize() + ".")
            lines += ["Regional assembly", f"- {page + 1} -"]
        text = "\n".join(lines)
        rows.append([i, "Title of it", text, text])
    first = rows[0][2].split("\n")
    first[0], first[1], first[2] = "The nurse should record the dosage before treat-", "ment of hypertens¬", "ion in the comrnunity ho5pital."
    rows[0][2] = "\n".join(first)
    rows[0][3] = "\n".join(["A table | row", *first])
    rows += [[100, None, None, None], [101, "T", "", ""], [102, "T", " ", None], [None, "T", rows[0][2], rows[0][3]], rows[0]]
    return spark.createDataFrame(rows, "guideline_id long, title string, clean_text string, raw_text string").selectExpr("*", "1 AS line_no", "'x' AS word")


def test_noisy_lines(spark):
    got = {tuple(r) for r in noise.noisy_lines(guidelines(spark)).filter("guideline_id = 0 AND line_no < 8").collect()}
    clean = {(0, "clean_text", 0, "break"), (0, "clean_text", 1, "break"), (0, "clean_text", 2, "chars"), (0, "clean_text", 5, "header"), (0, "clean_text", 6, "page")}
    raw = {(g, "raw_text", n + 1, k) for g, _, n, k in clean}
    assert got == clean | raw


def test_noisy_lines_of_raw_text_alone(spark):
    rows = [tuple(r) for r in guidelines(spark).filter("guideline_id BETWEEN 1 AND 59").select("guideline_id", "title", "clean_text", "raw_text").collect()]
    lines = ["Dose Site Outcome", "insomnia 1 g ho5pital", "The nurse should record the dosage before treat-", "ment of hypertens¬", "ion in the comrnunity ho5pital.", "Regional assembly", "- 1 -"]
    rows += [(200, "T", "", "\n".join(lines)), (201, "T", None, "\n".join(lines)), (202, "T", "The nurse should record.\nOther text.", "\n".join(["The nurse should record.", *lines]))]
    made = spark.createDataFrame(rows, "guideline_id long, title string, clean_text string, raw_text string")
    got = {tuple(r) for r in noise.noisy_lines(made).filter("guideline_id >= 200").collect()}
    want = [(2, "break"), (3, "break"), (4, "chars"), (5, "header"), (6, "page")]
    assert got == {(g, "raw_text", n + (g == 202), k) for g in (200, 201, 202) for n, k in want}


def test_running_line_of_few_documents_among_many(spark):
    held = "Text goes on and\nRural assembly\n- 1 -\nfurther to it.\nMore of it and\nRural assembly\n- 2 -\nso on."
    made = spark.createDataFrame([(held if i < 3 else "One.",) for i in range(3500)], "clean_text string")
    known = frozenset(r["line"] for r in layout.running_table(made).collect())
    assert known == {layout.folded("Rural assembly")}
    assert layout.nearly_running(layout.folded("Rurxx assembly"), known) and not layout.nearly_running("other assembly", known)


def test_running_lines_joined_by_document_decide_the_same(spark, monkeypatch):
    made = guidelines(spark)
    extra = spark.createDataFrame([(300, "T", "One.\nRegionel assembly\n- 2 -\nTwo goes\nRegional assernbly\non.", None)], "guideline_id long, title string, clean_text string, raw_text string")
    made = made.select("guideline_id", "title", "clean_text", "raw_text").unionByName(extra)
    sent = sorted(map(tuple, noise.noisy_lines(made).collect()))
    ends = sorted(map(tuple, S.guideline_sentences(made).collect()))
    monkeypatch.setattr(layout, "RUNNING_SENT", 0)
    assert sorted(map(tuple, noise.noisy_lines(made).collect())) == sent and (300, "clean_text", 4, "header") in sent
    assert sorted(map(tuple, S.guideline_sentences(made).collect())) == ends


def test_repair(spark):
    got = {r["guideline_id"]: r["repaired"] for r in noise.repaired_texts(guidelines(spark)).collect()}
    assert got[0].startswith("The nurse should record the dosage before treatment of hypertension in the community hospital. ")
    assert "assembly" not in got[0] and "- 1 -" not in got[0] and got[100] == got[101] == ""


def test_repair_of_both_fields(spark):
    made = guidelines(spark).selectExpr("guideline_id", "title", "CASE WHEN guideline_id <> 0 THEN clean_text END AS clean_text", "raw_text")
    got = {(r["guideline_id"], r["item_field"]): r["repaired"] for r in noise.repaired_texts(made).collect()}
    assert got[0, "raw_text"].startswith("A table | row\n\nThe nurse should record the dosage before treatment of hypertension in the community hospital. ")
    assert "assembly" not in got[0, "raw_text"] and "- 1 -" not in got[0, "raw_text"] and got[0, "clean_text"] == ""
    assert got[1, "raw_text"] == got[1, "clean_text"] != ""


def test_vectors_tell_a_word_from_a_misreading(spark):
    """Words near in spelling: one misread of a frequent word, one a word of its own with other neighbours."""
    r = random.Random(6)
    at_home, abroad = "nurse records dose daily before meals while resting".split(), "boats crossed rivers under grey skies towards towns".split()
    rows = []
    for i in range(120):
        lines = []
        for k in range(12):
            w = "form" if r.random() < 0.95 or i % 3 else "forrn"
            lines.append(" ".join([*r.sample(at_home, 3), "clinic", *r.sample(at_home, 3)]).replace("daily", w) + ".")
            lines.append(" ".join([*r.sample(abroad, 3), "clinie" if k % 2 else "ferry", *r.sample(abroad, 3)]) + ".")
        text = "\n".join(x.capitalize() for x in lines)
        rows.append((i, None, text, None))
    got = noise.Scans(spark.createDataFrame(rows, "guideline_id long, title string, clean_text string, raw_text string"))
    found = {(r["word"], r["printed"]) for r in got.misread.select("word", "printed").distinct().collect()}
    assert ("clinie", "clinic") in {(r["word"], r["printed"]) for r in got.links.collect()} and found == {("forrn", "form")}


def test_repair_against_the_clean_text(spark):
    """Texts made noisy on purpose come back: repaired words, joined line ends, no furniture."""
    r = random.Random(9)
    clean = {i: [" ".join(r.choice(VOCAB) for _ in range(10)).capitalize() + "." for _ in range(12)] for i in range(80)}
    rows = []
    for i, said in clean.items():
        lines: list[str] = []
        for k, x in enumerate(said):
            if r.random() < 0.05:
                x = x.replace("m", "rn", 1)
            if r.random() < 0.3 and "guideline" in x:
                a, b = x.split("guideline", 1)
                lines += [a + "guide-", "line" + b]
            else:
                lines.append(x)
            if k % 4 == 3:
                lines += ["Regional assembly", f"- {k // 4 + 1} -"]
        rows.append((i, "Title", "\n".join(lines), None))
    got = {r["guideline_id"]: r["repaired"] for r in noise.repaired_texts(spark.createDataFrame(rows, "guideline_id long, title string, clean_text string, raw_text string")).filter("item_field = 'clean_text'").collect()}
    words = lambda x: " ".join(x.split())
    right = sum(words(got[i]) == " ".join(said) for i, said in clean.items())
    assert right >= 0.9 * len(clean), right


def test_reflow_keeps_tables_whole():
    lines = [layout.Line(*x) for x in (("One goes", "text"), ("Dose Site", "table"), ("5 mL", "table"), ("on.", "text"), ("Week", "table"), ("Two.", "text"))]
    assert noise.reflow(lines, {}) == "One goes on.\n\nDose Site\n5 mL\n\nWeek\n\nTwo."


def test_no_guidelines(empty):
    ddl = "guideline_id long, title string, clean_text string, raw_text string"
    assert noise.noisy_lines(empty(ddl)).count() == 0 and noise.repaired_texts(empty(ddl)).count() == 0


def sentences(text, code=None):
    out, at = [], 0
    for e in S.abstract_ends(text, code):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("eng", ["METHODS: Doses of 1.5 mg vs. 3 mg were compared in Fig. 9 of it.", "It was not!", "The panel noted: “Stop it. Restart later.”", "pH was 7.1.", "“Is it worse?” was first."]),
        ("eng", ["Approx. 3 kg was sent to the St. Orla area … far more.", "Given q.i.d.", "See Sect. 2.1), cf. the data (e.g. asthma)."]),
        ("ger", ["Sie wurde z. B. am 9. Tag verdoppelt (vgl. Abb. 14).", "Fieber usw. klangen ab.", "Man schrieb: „Bitte absetzen. Danach prüfen.“", "„Wird es stärker?“ lautete die Frage."]),
        ("fre", ["La dose (c.-à-d. deux prises par j.) a été p. ex. tolérée.", "« Faut-il arrêter ? » demandaient les patients.", "Le comité précise : « Réduire. Contrôler. »", "À la fin."]),
        ("spa", ["Según el Dr. García, véase la pág. 3, fue poco.", "¿Por qué?", "Anotó: «Suspender. Repetir.»", "¡No se debe!"]),
        ("rus", ["Вошли все, т. е. больные (см. рис. 27).", "«Усиливается ли?» — спрашивали их.", "Указала: «Отменить. Повторить».", "В 2019 г. уровень выше."]),
        ("chi", ["剂量为0.5 mg，见图9.4。", "“夜间是否加重？”是最先问的。", "专家写道：“先停用。再复查。”", "没有关联……仍需观察。"]),
        ("jpn", ["骨密度が9.5%低下した。", "患者は「痛みはない。」と答えた。", "なぜか？"]),
        ("ara", ["سأل الطبيب: «هل يزداد السعال؟» فأجاب الحوامل بالنفي.", "انظر ص. 14 من الملحق.", "لماذا؟"]),
        ("hin", ["रोगी ने कहा, “दर्द नहीं है।” और वह घर गया।", "डॉ. की सलाह से दी गई।", "क्यों?"]),
        ("tha", ["ลดลงร้อยละ 11.0 ในเวลา 10 สัปดาห์", "ยังไม่ทราบว่าเหตุใด", "ขนาดยาที่แนะนำคือ 150 mg วันละสองครั้ง"]),
    ],
)
def test_sentences_by_language(code, want):
    text = ("" if code in ("chi", "jpn") else " ").join(want)
    assert sentences(text, code) == want and sentences(text, "und") == want


def test_languages_by_paragraph():
    english = "The dose was 1.5 mg vs. 3 mg in Fig. 9 of the report. " * 100
    thai = "ลดลงร้อยละ 11.0 ในเวลา 10 สัปดาห์ ยังไม่ทราบว่าเหตุใด ขนาดยาที่แนะนำคือ 150 mg วันละสองครั้ง"
    got = S.abstract_ends(f"{english}\n\n{thai * 60}", "und")
    alone = S.abstract_ends(thai * 60, "tha")
    assert got == [54 * k - 1 for k in range(1, 101)] + [5402 + e for e in alone] and len(alone) > 60
    assert S.page_text_ends(f"{english}\n\n{thai}", None, frozenset())[100:] == [5402 + e for e in S.abstract_ends(thai, "tha")[:-1]]
    german = "Die Dosis wurde bei der Gruppe z. B. am 9. Tag nicht verdoppelt."
    assert sentences(f"{english}\n\n{german}")[-1] == german


def test_rules_see_the_text_itself():
    assert sentences("Given at ca." + " " * 30 + "was it so. Next.", "eng") == ["Given at ca." + " " * 30 + "was it so.", "Next."]
    assert sentences("It was low." + " " * 30 + "was it so. Next.", "eng") == ["It was low." + " " * 30 + "was it so.", "Next."]


def test_quotations_of_any_length():
    said = "Stop it. Restart it later. " * 60
    assert sentences(f"The panel noted: “{said}End.” It was so.", "eng") == [f"The panel noted: “{said}End.”", "It was so."]
    nested = f"The panel noted: “One. „Two. Three.“ {said}Four.” It was so."
    assert sentences(nested, "eng") == [nested[:-11], "It was so."]
    assert len(sentences(f"A mark “left open. {said}The end.", "eng")) == 122
    assert len(sentences(f"A mark “left open.\n\n{said}", "eng")) == 121
    assert sentences(f"Cut off: “{said}And then", "eng") == [f"Cut off: “{said}And then"]
    assert S.quotations("“a «b” c» “d”") == [(0, 6), (10, 13)]


def test_a_long_text_in_two_languages():
    english, german = "The dose was low in it. " * 1000, "Die Dosis wurde am 9. Tag bei der Gruppe nicht verdoppelt. " * 2500
    assert len(S.abstract_ends(f"{english}\n\n{german}", "und")) == 3500


def test_missing_spaces_and_cut_off_ends():
    assert sentences("It lasted?Patients left.We stayed. The panel noted: “Stop it. Rest", "eng") == ["It lasted?", "Patients left.", "We stayed.", "The panel noted: “Stop it. Rest"]
    assert S.abstract_ends("  ") == [] and S.abstract_ends("One. Two  ") == [4, 8]


def test_furniture_inside_a_sentence():
    text = "Title of it\nThe aim is lower\n- 3 -\nTitle of it\n2.1 Scope of work\nrates by 2030. Next one\n\nis here."
    ends = S.page_text_ends(text, "Title of it", frozenset())
    assert [text[:e][-12:] for e in ends] == ["tes by 2030.", "one\n\nis here."[-12:]]


def test_tables_of_sentences(spark, empty):
    a = spark.createDataFrame([("1", "One. Two.", "eng"), ("1", "One. Two.", "und"), ("2", None, "eng"), ("3", " ", None), (None, "x", "eng")], "pmid string, abstract string, language string")
    g = spark.createDataFrame([(7, "T", "T\nOne.\nTwo"), (8, None, None), (None, "T", "One."), (7, "T", "T\nOne.\nTwo")], "guideline_id long, title string, clean_text string")
    got = sorted(map(tuple, S.corpus_sentences(a, g).collect()))
    assert got == [("articles.abstract", "1", 4), ("articles.abstract", "1", 9), ("guidelines.clean_text", "7", 6)]
    assert S.corpus_sentences(empty("pmid string, abstract string, language string"), empty("guideline_id long, title string, clean_text string")).count() == 0
