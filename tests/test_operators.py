import json
import os

import pytest
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.operators import dedup, embedding, images, pages, parsing
from lamina.operators import sources_chunking as S
from lamina.operators.skew import join_groups
from lamina.plans import jobs
from lamina.settings import Settings, request_delay
from lamina.sources import documents, providers, store

TOPICS = [("asthma", 0), ("copd", 1), ("malaria", 2)]


def topics(spark):
    return spark.createDataFrame(TOPICS, "topic string, topic_ord int")


def test_article_chunks_once_with_all_topics(spark):
    rows = [("7", "T", "One. Two.", "copd", 2), ("7", "T", "One. Two.", "asthma", 1), ("8", "U", "", "asthma", 1), ("9", "V", None, "asthma", 1)]
    df = spark.createDataFrame(rows, "pmid string, title string, abstract string, topic string, fetched_at int")
    got = S.article_chunks(df, topics(spark)).collect()
    assert [(r["chunk_id"], r["topics"], r["text"], r["raw_text"]) for r in got] == [("7_pubmed_0", ["asthma", "copd"], "T: One. Two.", "One. Two.")]
    assert got[0]["metadata"]["title"] == "T" and got[0]["metadata"]["field"] is None


def test_a_key_listed_twice_repeats_its_topic(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 0, "b")], "key string, n int, topic string")
    assert dedup.merge_by_key(df, "key", ["n"], "topic", ["n"]).first()["topics"] == ["b", "a", "a"]


def label(i, brand, topic="asthma", **fields):
    return (i, brand, topic, *[fields.get(f) for f in K.DRUG_SECTIONS])


LABEL_DDL = "drug_id int, brand_name string, topic string, " + ", ".join(f"{f} string" for f in K.DRUG_SECTIONS)


def test_label_chunks_run_one_index_over_sections(spark):
    long = "Word one. " * 4
    rows = [label(1, "Aspirin", indications_and_usage=" kept as is ", adverse_reactions=long), label(2, " aspirin ", "copd", contraindications="not this one"), label(3, "Other", dosage_and_administration="")]
    got = S.label_chunks(spark.createDataFrame(rows, LABEL_DDL), topics(spark), budget=6).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == [f"Aspirin_openfda_{i}" for i in range(len(got))] and len(got) == 3
    assert got[0]["text"] == "Aspirin — Indications and Usage:  kept as is " and got[0]["topics"] == ["asthma", "copd"]
    assert {r["metadata"]["field"] for r in got} == {"indications_and_usage", "adverse_reactions"}


def test_guideline_tables_follow_the_text(spark):
    g = spark.createDataFrame([(1, "G", "copd", "One. Two.", "u"), (2, "G", "asthma", "One. Two.", "u")], "guideline_id int, title string, topic string, clean_text string, source_url string")
    t = spark.createDataFrame([(10, 2, 3, [["a", None]]), (11, 2, 4, [["x y z"], ["p q r"], ["s " * 12]]), (12, 2, 5, [])], "table_id int, guideline_id int, page_number int, table_data array<array<string>>")
    got = S.guideline_chunks(g, t, topics(spark), limit=6, window=9, floor=3).orderBy("chunk_index").collect()
    assert [r["chunk_id"].split("_who_")[1] for r in got][:2] == ["text_0", "table_1"]
    assert got[0]["chunk_id"].startswith("asthma+copd_who_") and got[0]["topics"] == ["asthma", "copd"]
    assert got[1]["text"] == "G (table, page 3): a | " and got[1]["raw_text"] == "a | "
    parts = [r for r in got if r["metadata"]["table_part"]]
    assert parts[0]["text"].startswith("G (table, page 4, part 1/") and parts[0]["raw_text"] == parts[0]["text"]
    assert any(r["metadata"]["token_split_parts_total"] for r in parts)
    assert got[-1]["text"] == "G (table, page 5): "


def test_dates_and_authors(spark):
    df = spark.createDataFrame([("2024", "", "01"), ("", "", ""), (None, "May", None)], "y string, m string, d string")
    assert [r[0] for r in df.select(parsing.partial_date(F.col("y"), F.col("m"), F.col("d"))).collect()] == ["2024-01", "unknown", "May"]
    a = spark.createDataFrame([([("A", "B", None), (None, None, "C"), ("D", None, None)],), (None,)], "a array<struct<LastName:string,ForeName:string,CollectiveName:string>>")
    assert [r[0] for r in a.select(parsing.author_names(F.col("a"))).collect()] == [["A B", "C"], []]


def test_label_parsing_sets_failures_aside(spark):
    raw = [
        {"openfda": {"brand_name": None, "generic_name": ["x"]}, "indications_and_usage": ["a", "b"]},
        {"openfda": {}},
        {"openfda": {"brand_name": []}},
    ]
    df = spark.createDataFrame([("t", json.dumps(r)) for r in raw] + [("t", "no json")], "topic string, payload string")
    ok, failed = parsing.parse_labels(df)
    row = ok.collect()
    assert [(r["brand_name"], r["generic_name"], r["indications_and_usage"], r["contraindications"]) for r in row] == [("x", "x", "a b", None)]
    assert sorted(r["error"] for r in failed.collect()) == ["No brand_name or generic_name", "No brand_name or generic_name", "empty list of names"]


def test_label_dedup_comes_before_the_cap(spark):
    payload = lambda b: json.dumps({"openfda": {"brand_name": [b]}, "indications_and_usage": ["i"]})
    rows = [("t", i, payload(b)) for i, b in enumerate(["Aspirin", " aspirin ", "ASPIRIN", *[f"d{i}" for i in range(30)]])]
    kept, _ = jobs.label_tables(spark.createDataFrame(rows, "topic string, seq int, payload string"), 25)
    assert [r["brand_name"] for r in kept.orderBy("seq").collect()] == ["Aspirin", *[f"d{i}" for i in range(24)]]


def test_new_keys(spark):
    found = spark.createDataFrame([("t", str(i), i) for i in range(130)] + [("full", "x", 0)], "topic string, pmid string, rank int")
    have = spark.createDataFrame([("t", str(i)) for i in range(100)] + [("full", str(i)) for i in range(130)], "topic string, pmid string")
    got = dedup.new_keys(found, have, "topic", "pmid", "rank", 130).collect()
    assert sorted(int(r["pmid"]) for r in got) == list(range(100, 130))


def test_images(spark):
    rows = [("d", i, h) for i, h in enumerate("aaaabbbc")]
    df = spark.createDataFrame(rows, "doc string, n int, h string")
    assert sorted(r["h"] for r in images.once_per_document(df, F.col("h"), "doc", ["n"]).collect()) == ["b", "c"]
    cover = [("p_page0_img0.png", "p", 0, "h"), ("m_page0_img0.png", "m", 1, "h"), ("p_page3_img1.png", "p", 0, "g"), ("m_page3_img1.png", "m", 1, "g")]
    df = spark.createDataFrame(cover, "filename string, topic string, topic_ord int, h string").withColumns({"page_number": F.lit(0), "image_type": F.lit("embedded")})
    got = {r["key"]: r["topics"] for r in images.once_across_topics(df, F.col("h"), ["topic_ord"]).collect()}
    assert got == {"p_page0_img0.png_p": ["p"], "m_page0_img0.png_m": ["m"], "g": ["p", "m"]}


def test_pages(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "", "b"])], "doc string, page_number int, clean string")
    row = pages.assemble(df).first()
    assert (row["full_text"], row["num_pages"]) == ("a\nb", 3)
    captions = spark.createDataFrame([("d", 2), ("d", 5)], "doc string, page_number int")
    assert [r["page_number"] for r in pages.figures_without_image(captions, spark.createDataFrame([("d", 5)], "doc string, page_number int")).collect()] == [2]


def test_guideline_documents_are_read_once(spark, tmp_path):
    (tmp_path / "g.txt").write_text("Intro. See Figure 2.\fWorld Health Organization (WHO)\nBody 1 of 2 here.\f")
    files = documents.binary_documents(spark, f"file://{tmp_path}")
    doc = files.first()["doc"]
    topic_docs = spark.createDataFrame([("asthma", 0, "T", doc), ("copd", 1, "T", doc)], "topic string, topic_ord int, title string, doc string")
    guidelines, tables, shown = jobs.guideline_tables(files, topic_docs, documents.PlainText())
    rows = guidelines.orderBy("topic").collect()
    assert [(r["topic"], r["clean_text"], r["num_pages"]) for r in rows] == [(t, "Intro. See Figure 2.\nBody  here.", 3) for t in ("asthma", "copd")]
    assert tables.count() == 0 and shown.count() == 0


def test_embedding_batches_and_retry(spark):
    waits, calls = [], []

    def failing():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [[1.0]]

    assert embedding.with_retry(failing, wait=waits.append) == [[1.0]] and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        embedding.with_retry(lambda: (_ for _ in ()).throw(OSError()), wait=lambda s: None)
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "k int, text string")
    rows = {r["k"]: r["embedding"] for r in embedding.embed_texts(df, embedding.HashedProvider(8)).collect()}
    assert rows[1] == rows[3] and len(rows[1]) == 8 and rows[2] is None
    assert embedding.embed_images(spark.createDataFrame([(b"x",), (b"",)], "data binary"), lambda b: [1.0 / len(b)]).count() == 1


def test_providers_without_a_network(spark):
    tried = []

    def down(address, asked):
        tried.append(asked["search"])
        raise OSError

    assert providers.fetch_labels("hiv aids", down, term="HIV-1", wait=lambda s: None) == [] and tried == ['indications_and_usage:"HIV-1"'] * 3
    assert providers.fetch_labels("t", lambda a, p: (500, "")) == []
    providers.register(spark, lambda a, p: (200, json.dumps({"results": [{"q": p["search"]}]})))
    got = providers.raw_labels(spark, ["malaria", "hiv aids"]).collect()
    assert {r["topic"]: json.loads(r["payload"])["q"] for r in got} == {"malaria": 'indications_and_usage:"malaria"', "hiv aids": 'indications_and_usage:"HIV-1"'}
    xml = "<S><PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle><Language>eng</Language><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>"
    ok, failed = parsing.parse_articles(spark.createDataFrame([("t", p) for p in providers.article_payloads(xml)], "topic string, payload string"))
    assert ok.first()["abstract"] == "a b" and ok.first()["pub_date"] == "unknown" and failed.count() == 0


def test_handles_are_resolved_by_three_requests(spark):
    """The answers have the shape of the service's: embedded lists, and links from one to the next."""
    asked = []

    def service(address, parameters):
        asked.append(address)
        if address == providers.ITEM_SEARCH:
            return (200, '{"uuid": "u-1", "type": "item"}') if parameters == {"id": "hdl:10665/1"} else (404, "")
        if address == providers.ITEM_BUNDLES.format("u-1"):
            bundles = [{"name": "TEXT", "_links": {"bitstreams": {"href": "t"}}}, {"name": "ORIGINAL", "_links": {"bitstreams": {"href": "files"}}}]
            return 200, json.dumps({"_embedded": {"bundles": bundles}, "page": {"totalElements": 2}})
        return 200, json.dumps({"_embedded": {"bitstreams": [{"name": "a.pdf", "_links": {"content": {"href": "content"}}}, {"_links": {"content": {"href": "other"}}}]}})

    df = spark.createDataFrame([("10665/1", 1), ("10665/2", 2), (None, 3)], "handle string, n int")
    assert {r["n"]: r["url"] for r in providers.resolved(df, service).collect()} == {1: "content", 2: None, 3: None}
    answers = spark.createDataFrame([("{}",), ('{"_embedded":{"bundles":[]}}',), ("no json",)], "j string")
    assert [r[0] for r in answers.select(parsing.bundle_files_url(F.col("j"))).collect()] == [None] * 3
    assert [r[0] for r in answers.select(parsing.first_file_url(F.col("j"))).collect()] == [None] * 3


def test_downloads_happen_once_and_failures_are_told(spark):
    def service(address):
        if address == "down":
            raise OSError("no route")
        return (200, address.encode()) if address != "gone" else (404, b"")

    got, lost = providers.downloaded(spark.createDataFrame([("a",), ("a",), ("gone",), ("down",), (None,)], "url string"), service)
    assert [(r["doc"], bytes(r["data"])) for r in got.collect()] == [("a", b"a")]
    assert {r["doc"]: r["error"] for r in lost.collect()} == {"gone": "status 404", "down": "OSError: no route"}


def test_the_rate_holds_for_all_partitions(monkeypatch):
    waits = []
    monkeypatch.setattr(providers.time, "sleep", waits.append)
    service = lambda a, p: (200, json.dumps({"esearchresult": {"idlist": [p["term"]]}}))
    reader = providers._SearchReader({"topics": json.dumps(list("abcdef")), "email": "e", "at_once": "2"}, service)
    parts = reader.partitions()
    assert [[t for _, t in p.topics] for p in parts] == [["a", "c", "e"], ["b", "d", "f"]]
    assert [r[0] for p in parts for r in reader.read(p)] == list("acebdf") and waits == [0.7] * 4
    one = providers._SearchReader({"topics": json.dumps(list("abc")), "email": "e", "api_key": "k"}, service)
    waits.clear()
    assert len(one.partitions()) == 1 and len(list(one.read(one.partitions()[0]))) == 3 and waits == [0.11, 0.11]


def test_remote_provider_and_one_model_a_worker(spark):
    def service(address, headers, body):
        asked = json.loads(body)
        assert headers["Authorization"] == "Bearer k" and asked["model"] == "m"
        data = [{"object": "embedding", "index": i, "embedding": [float(len(t))] * 4} for i, t in enumerate(asked["input"])]
        return 200, json.dumps({"object": "list", "data": data[::-1], "usage": {"total_tokens": 1}})

    provider = embedding.RemoteProvider("https://models.example/embeddings", "m", "k", 4, service)
    rows = embedding.embed_texts(spark.createDataFrame([("ab",), ("abc",)], "text string"), provider).collect()
    assert {r["text"]: r["embedding"] for r in rows} == {"ab": [2.0] * 4, "abc": [3.0] * 4}
    with pytest.raises(OSError):
        embedding.RemoteProvider("a", "m", "k", 4, lambda *x: (429, "")).embed(["x"])
    made = []
    model = embedding.Once("test model", lambda: made.append(1) or (lambda b: [1.0]))
    assert model.get() is model.get() and made == [1]
    assert embedding.embed_images(spark.createDataFrame([(b"x",)], "data binary"), embedding.Once("two", lambda: lambda b: [1.0, 2.0]), dimensions=3).count() == 0


def test_requests_are_packed_across_batches(spark, tmp_path):
    class Counting:
        dimensions = 1

        def embed(self, texts):
            with open(tmp_path / "sizes", "a") as f:
                f.write(f"{len(texts)}\n")
            return [[1.0]] * len(texts)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.range(10).coalesce(1).selectExpr("id", "IF(id = 4, NULL, 'one two') AS text")
        assert embedding.embed_texts(df, Counting(), tokens=10, most=100).filter("embedding IS NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (tmp_path / "sizes").read_text().split() == ["5", "4"]


def test_another_tokenizer(spark):
    from lamina.functions.text import tokens_by
    from lamina.operators import chunking

    tokens = tokens_by(lambda: lambda text: [c for c in text])  # one character a token
    df = spark.createDataFrame([(1, "Ab cd. Ef gh. Ij.", "P: "), (2, None, "P: ")], "k int, text string, prefix string")
    assert [r["chunk"] for r in chunking.by_sentences(df, "text", 13, tokens=tokens).collect()] == ["Ab cd. Ef gh.", "Ij."]
    assert [r["chunk"] for r in chunking.by_windows(df, "text", 6, tokens=tokens).collect()] == ["Ab cd.", " Ef gh", ". Ij."]
    cut = chunking.windows_with_prefix(df.filter("k = 1"), "text", "prefix", 12, 2, tokens).orderBy("sub_index").collect()
    assert [r["piece"] for r in cut] == ["P: Ab cd. Ef", "P:  gh. Ij."]


def test_pack_rows_equals_packing_an_array(spark):
    import random

    from lamina.operators.packing import pack, pack_rows

    r = random.Random(3)
    rows = [(g, i, r.randint(1, 9), r.choice([True, False, False, False, None])) for g in range(3) for i in range(200)]
    got = pack_rows(spark.createDataFrame(rows, "g int, i int, n int, m boolean"), ["g"], ["i"], "n", 20, 4, "m").collect()
    for g in range(3):
        mine = sorted((x["i"], x["pack_id"]) for x in got if x["g"] == g)
        want = [k for k, (_, n, _) in enumerate(pack([x[2] for x in rows if x[0] == g], 20, 4, [bool(x[3]) for x in rows if x[0] == g])) for _ in range(n)]
        assert [p for _, p in mine] == want


def test_nearest_in_several_passes(spark, monkeypatch):
    import numpy as np

    from lamina.operators import similarity

    v = np.random.default_rng(2).normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None), (98, [0.0] * 4)], "k long, v array<double>")
    want = similarity.nearest(df, df.filter("k % 3 = 0"), "k", "v", 4).collect()
    monkeypatch.setattr(similarity, "BLOCK", 2)
    monkeypatch.setattr(similarity, "CARRIED", 200)
    assert sorted(similarity.nearest(df, df.filter("k % 3 = 0"), "k", "v", 4).collect()) == sorted(want) and len(want) == 80
    assert similarity.nearest(df, df.filter("k < 0"), "k", "v", 4).count() == 0


def test_furniture_is_tried_once_a_line(spark):
    from lamina.functions.text import without_furniture

    lines = ["a World Health Organization (WHO) b", "kept 3 of 4 too", "x" * 200_000, "World Health Organization (WHO)"]
    df = spark.createDataFrame([("\n".join(lines),)], "t string")
    assert df.select(without_furniture(F.col("t"))).first()[0] == "kept  too\n" + "x" * 200_000
    assert df.select(without_furniture(F.col("t"), "kept ")).first()[0].split("\n")[1] == "3 of 4 too"


def test_gray_maps_need_no_library(spark):
    df = spark.createDataFrame([(b"P5 2 2 255\n\x00\xff\x00\xff",), (b"P5\n1 1\n255\n\x07",), (b"junk",), (None,)], "d binary")
    assert [r[0] for r in df.select(images.gray_deviation(F.col("d"))).collect()] == [127.5, 0.0, None, None]
    assert images.without_blank(df, images.gray_deviation(F.col("d"))).count() == 3


def test_a_page_without_tables_and_failed_documents(spark):
    class Picky(documents.PlainText):
        def pages(self, data):
            if data == b"bad":
                raise ValueError("no pages")
            return super().pages(data)

    docs = spark.createDataFrame([("asthma", 0, "T", "a"), ("copd", 1, "T", "a"), ("malaria", 2, "M", "b"), ("stroke", 3, "S", "c")], "topic string, topic_ord int, title string, doc string")
    files = spark.createDataFrame([("a", b"one"), ("b", b"bad")], "doc string, data binary")
    lost = spark.createDataFrame([("c", "status 404")], "doc string, error string")
    (guidelines, _, _), told = jobs.guideline_run(files, lost, docs, Picky())
    assert {r["topic"]: (r["status"], (r["error"] or "").split(":")[0]) for r in told.collect()} == {
        "asthma": ("success", ""), "copd": ("success (cached)", ""), "malaria": ("failed", "ValueError"), "stroke": ("failed", "status 404")
    }
    assert sorted(r["topic"] for r in guidelines.collect()) == ["asthma", "copd"]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    assert store.read_json(spark, path, "article").count() == 0
    row = ("1", "t", "a", ["x"], "j", "2020", "eng", "asthma", None, "u")
    df = spark.createDataFrame([row], store.DDL["article"])
    store.write_json(df, path, "append")
    store.write_json(df, path, "append")
    assert [r["source"] for r in store.read_json(spark, path, "article").collect()] == ["pubmed", "pubmed"]
    (tmp_path / "bad.json").write_text('{"pmid": "1"}\n')
    with pytest.raises(Exception, match="without"):
        store.read_json(spark, f"file://{tmp_path}/bad.json", "article").collect()
    (tmp_path / "worse.json").write_text("{no json\n")
    with pytest.raises(Exception):
        store.read_json(spark, f"file://{tmp_path}/worse.json", "article").collect()
    v = spark.createDataFrame([("p", "c", "pubmed", ["a"], "s", "text", [0.5, 1.0])], "point_id string, chunk_id string, source string, topics array<string>, source_id string, chunk_type string, embedding array<double>")
    store.save_embeddings(v, f"file://{tmp_path}/v")
    assert store.load_embeddings(spark, f"file://{tmp_path}/v", "pubmed", 2).first()["embedding"] == [0.5, 1.0]
    with pytest.raises(Exception, match="vector of length 2"):
        store.load_embeddings(spark, f"file://{tmp_path}/v", dimensions=3).collect()
    with pytest.raises(Exception):
        store.load_embeddings(spark, f"file://{tmp_path}/none").collect()


def test_settings():
    assert request_delay() < request_delay(False)
    with pytest.raises(ValueError):
        Settings.load(require=("contact_email",))


def test_hot_groups_join_like_others(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS x")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("m"))
    got = join_groups(rows, groups, ["k"], "n", 3000)
    assert got.count() == 3000 and got.filter("k = 0").agg(F.min("n"), F.max("m")).first()[:] == (1000, 0)


def test_broken_documents_are_told_apart(spark):
    class Picky(documents.PlainText):
        def pages(self, data):
            if data == b"bad":
                raise ValueError("no pages")
            return super().pages(data)

    df = spark.createDataFrame([("a", b"one"), ("b", b"bad"), ("c", None)], "doc string, data binary")
    assert [r["doc"] for r in documents.extract_pages(df, Picky()).collect()] == ["a"]
    assert sorted((r["doc"], r["error"].split(":")[0]) for r in documents.broken_documents(df, Picky()).collect()) == [("b", "ValueError"), ("c", "TypeError")]


def test_image_table(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    assert store.load_image_table(spark, path).count() == 0
    df = spark.createDataFrame([("hiv aids", 1, 0, "f.png", 2, 3, "embedded", b"x")], "topic string, page_number int, image_index int, filename string, width int, height int, image_type string, data binary")
    store.save_images(df, path)
    store.save_images(df, path)
    assert [r["filename"] for r in store.load_image_table(spark, path, "hiv aids").collect()] == ["f.png"] and store.load_image_table(spark, path, "asthma").count() == 0


def test_chunks_are_stored_under_each_topic(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    row = ("c1", "p1", "t", "t", "pubmed", ["hiv aids", "copd"], "1", 0, "text", None)
    df = spark.createDataFrame([row], store.DDL["chunk"])
    store.save_chunks(df, path)
    store.save_chunks(df, path)
    assert store.load_chunks(spark, path, "pubmed", "hiv aids").count() == 1 and store.load_chunks(spark, path).count() == 2
    assert store.load_chunks(spark, f"{path}-none", "pubmed").count() == 0


def test_neighbours_cross_partitions(spark):
    from lamina.operators.similarity import likeness_to_previous

    rows = [(i, i % 3 == 0, [1.0, float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, g boolean, v array<double>").repartition(7)
    got = {r["k"]: r["similarity"] for r in likeness_to_previous(df, "v", ["k"], ["g"]).collect()}
    last, want = {}, {}
    for k, g, v in rows:
        p = last.get(g)
        want[k] = None if p is None else round(sum(a * b for a, b in zip(p, v)) / (sum(a * a for a in p) * sum(a * a for a in v)) ** 0.5, 6)
        last[g] = v
    assert got == want


def test_late_rows_of_a_stream(spark, tmp_path):
    """A repeat within the delay is left out; a row behind the watermark is, too, and the sink holds each key once."""
    from lamina.streaming import ingest

    days = [["2024-01-01", "2024-01-02"], ["2024-03-01", "2024-03-02"], ["2024-03-02", "2024-03-03"], ["2024-01-03", "2024-03-04"]]  # a batch is judged by the watermark before the last
    ddl = "topic string, pmid string, fetched_at timestamp"
    for n, batch in enumerate(days):
        rows = [(f"t{n}", d, "k" if n == 1 else d) for d in batch]
        df = spark.createDataFrame(rows, "topic string, at string, pmid string").selectExpr("topic", "pmid", "CAST(at AS timestamp) AS fetched_at")
        df.coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        for written in (tmp_path / "in" / str(n)).glob("*.parquet"):  # read in this order
            os.utime(written, (1_700_000_000 + 60 * n,) * 2)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    counted = ingest.topic_windows(stream, delay="10 days").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    counted.awaitTermination()
    got = {r["topic"]: r["n"] for r in spark.sql("SELECT topic, sum(n_articles) AS n FROM late GROUP BY topic").collect()}
    assert got == {"t0": 2}  # the late one is dropped, the others are still open
    once = ingest.unique_articles(spark, f"file://{tmp_path}/in/1", ddl)
    for _ in range(2):
        ingest.ingest_stream(once, f"file://{tmp_path}/out", f"file://{tmp_path}/state{_}").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1
