"""Queries of the store, the providers and the runs: each goes through the library's reader or writer and back.

Providers answer from the test tables in place of the network: a transport gives for a request what the
service would send.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions import text as T
from lamina.operators import embedding, images, parsing, similarity
from lamina.operators import sources_chunking as C
from lamina.operators.packing import pack_rows
from lamina.plans import jobs
from lamina.plans import sql as S
from lamina.plans.registry import SQL, query
from lamina.session import scratch, table
from lamina.settings import Settings
from lamina.sources import documents, providers, store


# ---- store

_ARTICLE = ["pmid", "title", "abstract", "authors", "journal", "pub_date", "language", "topic", "source", "url"]


@query("""SELECT pmid, title, md5(coalesce(abstract, '')) AS digest, array_to_string(authors, '; ') AS authors, journal, pub_date, language, topic, 'pubmed' AS source, url FROM articles""")
def articles_stored(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "articles")
    rows = table(spark, d, "articles").select(*_ARTICLE).withColumn("abstract", F.coalesce("abstract", F.lit(""))).drop("source")
    halves = rows.withColumn("half", F.pmod(F.xxhash64("pmid"), F.lit(2)))
    for half in (0, 1):  # the second run is appended
        store.write_json(halves.filter(F.col("half") == half).drop("half"), path, "append")
    read = store.read_json(spark, path, "article")
    return read.select("pmid", "title", F.md5("abstract").alias("digest"), F.array_join("authors", "; ").alias("authors"), "journal", "pub_date", "language", "topic", "source", "url")


@query("""SELECT brand_name, generic_name, drug_class, md5(coalesce(indications_and_usage, '')) AS digest, adverse_reactions IS NULL AS no_reactions, topic, 'openfda' AS source FROM drugs""")
def drugs_stored(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "drugs")
    rows = table(spark, d, "drugs").select("brand_name", "generic_name", "drug_class", *K.DRUG_SECTIONS, "topic")
    store.write_json(rows.limit(1), path)
    store.write_json(rows.withColumn("indications_and_usage", F.coalesce("indications_and_usage", F.lit(""))), path)  # replaces
    read = store.read_json(spark, path, "drug")
    return read.select("brand_name", "generic_name", "drug_class", F.md5("indications_and_usage").alias("digest"), F.col("adverse_reactions").isNull().alias("no_reactions"), "topic", "source")


@query("""SELECT title, topic, md5(coalesce(clean_text, '')) AS clean, md5(coalesce(raw_text, '')) AS raw, num_pages, num_tables, num_images, source_url, 'who' AS source FROM guidelines""")
def guidelines_stored(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "guidelines")
    rows = table(spark, d, "guidelines").select("title", "topic", F.coalesce("clean_text", F.lit("")).alias("clean_text"), F.coalesce("raw_text", F.lit("")).alias("raw_text"), "num_pages", "num_tables", "num_images", "source_url")
    store.write_json(rows, path)
    read = store.read_json(spark, path, "guideline")
    return read.select("title", "topic", F.md5("clean_text").alias("clean"), F.md5("raw_text").alias("raw"), "num_pages", "num_tables", "num_images", "source_url", "source")


@query(f"SELECT topic, page_number, md5({S.table_text('table_data')}) AS digest FROM who_tables")
def tables_stored(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tables")
    rows = table(spark, d, "who_tables")
    for _ in range(2):  # a topic written again is replaced
        store.save_tables(rows, path)
    return store.load_tables(spark, path).select("topic", "page_number", F.md5(T.table_text(F.col("table_data"))).alias("digest"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    return v.select(name.alias("point_id"), name.alias("chunk_id"), F.array(F.col("label").cast("string")).alias("topics"), name.alias("source_id"), F.lit("text").alias("chunk_type"), F.when(F.col("label") % 2 == 0, "pubmed").otherwise("who").alias("source"), "embedding", "vec_id", "label")


_DIGEST = "md5(array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ' '))"


def _digest() -> F.Column:
    return F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), " "))


@query(f"SELECT 'v' || vec_id AS point_id, 'v' || vec_id AS source_id, CAST(label AS VARCHAR) AS topics, 'pubmed' AS source, {_DIGEST} AS digest FROM embeddings WHERE label % 2 = 0")
def embeddings_stored(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "vectors")
    store.save_embeddings(_vectors(spark, d), path)
    read = store.load_embeddings(spark, path, "pubmed", dimensions=64)
    return read.select("point_id", "source_id", F.array_join("topics", "|").alias("topics"), "source", _digest().alias("digest"))


@query(f"SELECT 'v' || vec_id || '.png' AS filename, CAST(label AS VARCHAR) AS topics, label AS page_number, 'embedded' AS image_type, {_DIGEST} AS digest FROM embeddings")
def image_embeddings_stored(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "image-vectors")
    rows = _vectors(spark, d).select(F.concat("point_id", F.lit(".png")).alias("filename"), "topics", F.col("label").alias("page_number"), F.lit("embedded").alias("image_type"), "embedding")
    store.save_image_embeddings(rows, path)
    return store.load_image_embeddings(spark, path, dimensions=64).select("filename", F.array_join("topics", "|").alias("topics"), "page_number", "image_type", _digest().alias("digest"))


@query("SELECT DISTINCT topic, pmid FROM articles WHERE language <> 'und'")
def stored_keys(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "keys")
    if store.existing_keys(spark, path).count():
        raise AssertionError("keys of a table that is not there")
    table(spark, d, "articles").filter("language <> 'und'").select(*_ARTICLE).write.partitionBy("source").parquet(path)
    return store.existing_keys(spark, path)


@query(f"SELECT source, count(*) AS n_chunks, CAST(sum({S.tokens('text')}) AS BIGINT) AS n_tokens FROM chunks WHERE text IS NOT NULL AND raw_text IS NOT NULL AND chunk_id IS NOT NULL AND source_id IS NOT NULL GROUP BY source")
def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "scan")
    rows = table(spark, d, "chunks").select("chunk_id", "point_id", "text", "raw_text", "source", "topics", "source_id", "chunk_index", "chunk_type")
    rows = rows.filter("text IS NOT NULL AND raw_text IS NOT NULL AND chunk_id IS NOT NULL AND source_id IS NOT NULL")
    for source in ("pubmed", "openfda", "who"):
        store.write_json(rows.filter(F.col("source") == source), f"{path}/{source}")
    read = store.scan(spark, f"{path}/*/*.json", "chunk")
    return read.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(T.token_count(F.col("text"))).alias("n_tokens"))


@query("SELECT * FROM (VALUES ('contact_email', 'someone@example.org'), ('data_root', 'data'), ('embedding_model', 'hashed-256'), ('delay', '0.35'), ('delay_with_key', '0.11')) AS v(name, value)")
def settings_loaded(spark: SparkSession, d: str) -> DataFrame:
    from lamina.settings import request_delay

    spark.conf.set("spark.lamina.contact_email", "someone@example.org")
    try:
        held = Settings.load(spark, require=("contact_email",))
    finally:
        spark.conf.unset("spark.lamina.contact_email")
    rows = [(n, getattr(held, n)) for n in ("contact_email", "data_root", "embedding_model")] + [("delay", str(request_delay(False))), ("delay_with_key", str(request_delay(True)))]
    return spark.createDataFrame(rows, "name string, value string")


# ---- providers


@functools.lru_cache(maxsize=4)
def _rows(path: str, topic: str | None) -> list[dict]:
    import pyarrow.parquet as pq

    return pq.read_table(path, filters=[("topic", "=", topic)] if topic is not None else None).to_pylist()


@dataclass(frozen=True)
class ArticleService:
    """Answers a search with the ids of a topic in ascending order, a fetch with the records as XML."""

    folder: str

    def __call__(self, address: str, asked: dict) -> tuple[int, str]:
        path = f"{self.folder}/articles.parquet"
        if address == providers.ARTICLE_SEARCH:
            ids = sorted({r["pmid"] for r in _rows(path, asked["term"]) if r["pmid"]})
            return 200, json.dumps({"esearchresult": {"idlist": ids[: asked["retmax"]]}})
        wanted = asked["id"].split(",")
        held: dict[str, dict] = {}
        for r in _rows(path, None):
            if r["pmid"] in set(wanted) and (r["pmid"] not in held or (r["title"], r["journal"]) < (held[r["pmid"]]["title"], held[r["pmid"]]["journal"])):
                held[r["pmid"]] = r
        return 200, f"<Set>{''.join(self.entry(held[i]) for i in wanted)}</Set>"

    @staticmethod
    def entry(r: dict) -> str:
        date = dict(zip(("Year", "Month", "Day"), r["pub_date"].split("-"))) if r["pub_date"] != "unknown" else {}
        tag = lambda name, x: f"<{name}>{escape(x)}</{name}>" if x else ""
        return (
            f"<PubmedArticle><MedlineCitation>{tag('PMID', r['pmid'])}<Article><Journal>{tag('Title', r['journal'])}<JournalIssue><PubDate>{''.join(tag(k, v) for k, v in date.items())}</PubDate></JournalIssue></Journal>"
            f"{tag('ArticleTitle', r['title'])}{tag('Language', r['language'])}</Article></MedlineCitation></PubmedArticle>"
        )


_SEARCH, _SEARCH_ALL = 20, [*K.TOPICS]
_FOUND = f"(SELECT topic, pmid, row_number() OVER (PARTITION BY topic ORDER BY pmid) - 1 AS rank FROM (SELECT DISTINCT topic, pmid FROM articles WHERE pmid <> '' AND topic IN (SELECT topic FROM topic_list)) QUALIFY rank < {_SEARCH})"


@query(f"SELECT topic, pmid, CAST(rank AS INTEGER) AS rank FROM {_FOUND}")
def article_search(spark: SparkSession, d: str) -> DataFrame:
    providers.register(spark, ArticleService(d))
    return providers.found_articles(spark, _SEARCH_ALL, "someone@example.org", _SEARCH, at_once=8, delay=0)


@query(f"""SELECT f.topic, f.pmid, a.title, a.journal, a.pub_date, a.language FROM {_FOUND} f JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY title, journal) AS rn FROM articles) WHERE rn = 1) a USING (pmid)""")
def article_fetch(spark: SparkSession, d: str) -> DataFrame:
    providers.register(spark, ArticleService(d))
    ok, _ = parsing.parse_articles(providers.raw_articles(spark, _SEARCH_ALL, "someone@example.org", _SEARCH, at_once=8, delay=0))
    return ok.select("topic", "pmid", "title", "journal", "pub_date", "language")


@dataclass(frozen=True)
class LabelService:
    """Answers a search with the labels whose indications hold the term, in the order of their ids."""

    folder: str

    def __call__(self, address: str, asked: dict) -> tuple[int, str]:
        term = asked["search"].split('"')[1].lower()
        found = sorted((r for r in _rows(f"{self.folder}/drugs.parquet", None) if term in (r["indications_and_usage"] or "").lower()), key=lambda r: r["drug_id"])
        if not found:
            return 404, ""
        names = lambda r: {"brand_name": [r["brand_name"]], "generic_name": [r["generic_name"]]}
        return 200, json.dumps({"results": [{"openfda": names(r), "indications_and_usage": [r["indications_and_usage"]]} for r in found[: asked["limit"]]]})


#: Words of the labels in place of topics.
_TERMS, _RAW, _KEPT = ["oedema", "adults", "hypertension", "infection", "nothing says this"], 60, 25
_LABELS_FOUND = f"""t AS (SELECT unnest([{", ".join(repr(t) for t in _TERMS)}]) AS topic, unnest(generate_series(0, {len(_TERMS) - 1})) AS topic_ord),
f AS (SELECT t.topic, drug_id, brand_name, generic_name, row_number() OVER (PARTITION BY t.topic ORDER BY drug_id) - 1 AS seq FROM t JOIN drugs ON contains(lower(indications_and_usage), t.topic) WHERE brand_name IS NOT NULL OR generic_name IS NOT NULL QUALIFY seq < {_RAW})"""


def _labels(spark: SparkSession, d: str) -> DataFrame:
    providers.register(spark, LabelService(d))
    return providers.raw_labels(spark, _TERMS, _RAW, delay=0)


@query(f"WITH {_LABELS_FOUND} SELECT topic, CAST(seq AS INTEGER) AS seq, coalesce(nullif(brand_name, ''), generic_name) AS brand_name FROM f")
def label_fetch(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = parsing.parse_labels(_labels(spark, d), keep=("seq",))
    return ok.select("topic", "seq", "brand_name")


@query(f"""WITH {_LABELS_FOUND}, n AS (SELECT topic, seq, coalesce(nullif(brand_name, ''), generic_name) AS brand_name FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY topic, lower({S.strip("brand_name")}) ORDER BY seq) AS rn FROM n), c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq) AS place FROM k WHERE rn = 1)
SELECT topic, brand_name, 'openfda' AS source FROM c WHERE place <= {_KEPT}""")
def label_run(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "labels")
    kept, _ = jobs.label_tables(_labels(spark, d), _KEPT)
    store.write_json(kept.drop("seq"), path)
    return store.read_json(spark, path, "drug").select("topic", "brand_name", "source")


@query("""SELECT topic, CASE WHEN drug_id % 7 = 0 THEN 'empty list of names' ELSE 'No brand_name or generic_name' END AS error, count(*) AS n FROM drugs WHERE drug_id % 7 = 0 OR drug_id % 5 = 0 GROUP BY ALL""")
def label_failures(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("drug_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("drug_id") % 5 != 0, F.array("brand_name"))
    payload = F.to_json(F.struct(F.struct(brand.alias("brand_name")).alias("openfda"), F.array("indications_and_usage").alias("indications_and_usage")))
    _, failed = parsing.parse_labels(table(spark, d, "drugs").select("topic", payload.alias("payload")))
    return failed.groupBy("topic", "error").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class ItemService:
    """A repository of items: those of every seventh handle are missing, every fifth has no bundle ORIGINAL."""

    def __call__(self, address: str, asked: dict) -> tuple[int, str]:
        if address == providers.ITEM_SEARCH:
            number = int(asked["id"].rpartition("/")[2])
            return (404, "") if number % 7 == 0 else (200, json.dumps({"uuid": f"item-{number}"}))
        number = int(address.split("item-")[1].split("/")[0])
        if address.endswith("/bundles"):
            bundles = [{"name": n, "_links": {"bitstreams": {"href": f"https://repository.example/item-{number}/{n}"}}} for n in (["TEXT"] if number % 5 == 0 else ["TEXT", "ORIGINAL"])]
            return 200, json.dumps({"_embedded": {"bundles": bundles}})
        return 200, json.dumps({"_embedded": {"bitstreams": [{"_links": {"content": {"href": f"https://repository.example/{i}/{number}"}}} for i in ("first", "second")]}})


@query("SELECT guideline_id, CASE WHEN guideline_id % 7 <> 0 AND guideline_id % 5 <> 0 THEN 'https://repository.example/first/' || guideline_id END AS url FROM guidelines")
def resolved_handles(spark: SparkSession, d: str) -> DataFrame:
    handles = table(spark, d, "guidelines").select("guideline_id", F.concat(F.lit("10665/"), "guideline_id").alias("handle"))
    return providers.resolved(handles, ItemService()).select("guideline_id", "url")


@dataclass(frozen=True)
class DocumentService:
    """Gives the raw text of a document for its address, as a file with a form feed between paragraphs."""

    folder: str

    def __call__(self, address: str) -> tuple[int, bytes]:
        held = [r for r in _rows(f"{self.folder}/guidelines.parquet", None) if r["source_url"] == address]
        first = min(held, key=lambda r: r["guideline_id"])
        return (200, (first["raw_text"] or "").replace("\n\n", "\f").encode()) if first["guideline_id"] % 4 else (503, b"")


@dataclass(frozen=True)
class PictureText(documents.PlainText):
    """Pages of text as pictures: one of the lengths of its words for every page, and its first words drawn where asked."""

    @staticmethod
    def picture(page: str) -> tuple[bytes, int, int]:
        values = bytes(min(255, 20 * len(w)) for w in page.split())
        return b"P5 %d 1 255\n" % len(values) + values, len(values), 1

    def images(self, data: bytes) -> list[documents.Image]:
        return [documents.Image(i, 0, *self.picture(p.raw)) for i, p in enumerate(self.pages(data))]

    def raster(self, data: bytes, pages: list[int], dpi: int) -> list[documents.Image]:
        read = self.pages(data)
        return [documents.Image(i, 0, *self.picture(read[i].raw)) for i in pages if 0 <= i < len(read)]


_DOCS = """o AS (SELECT topic, topic_ord, source_url AS doc, min(guideline_id) OVER (PARTITION BY source_url) AS first_doc FROM (SELECT topic, source_url, guideline_id FROM guidelines) JOIN topic_list USING (topic)
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY guideline_id) = 1),
u AS (SELECT *, min(topic_ord) OVER (PARTITION BY doc) AS first_ord FROM o),
r AS (SELECT source_url, raw_text, guideline_id FROM guidelines QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY guideline_id) = 1)"""


def _topic_docs(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "guidelines").groupBy("topic").agg(F.min_by("source_url", "guideline_id").alias("doc"), F.min_by("title", "guideline_id").alias("title"))
    return g.join(table(spark, d, "topic_list"), "topic").select("topic", "topic_ord", "title", "doc")


def _run(spark: SparkSession, d: str):
    docs = _topic_docs(spark, d)
    files, lost = providers.downloaded(docs, DocumentService(d), "doc")
    return jobs.guideline_run(files, lost, docs, documents.PlainText())


@query(f"""WITH {_DOCS} SELECT topic, CASE WHEN guideline_id % 4 = 0 THEN 'failed' WHEN topic_ord > first_ord THEN 'success (cached)' ELSE 'success' END AS status,
CASE WHEN guideline_id % 4 = 0 THEN 'status 503' END AS error FROM u JOIN r ON r.source_url = u.doc""")
def guideline_run_status(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)[1]


_CLEANED = S.strip(f"regexp_replace(t, '{K.HEADER_FOOTER}', '', 'g')")


@query(f"""WITH {_DOCS}, p AS (SELECT source_url, unnest(generate_series(1, len(x))) AS n, unnest(x) AS t, len(x) AS pages FROM (SELECT source_url, string_split(replace(coalesce(raw_text, ''), chr(10) || chr(10), chr(12)), chr(12)) AS x FROM r WHERE guideline_id % 4 <> 0)),
c AS (SELECT source_url, n, pages, {_CLEANED} AS t FROM p), f AS (SELECT source_url, pages, coalesce(string_agg(t, chr(10) ORDER BY n) FILTER (t <> ''), '') AS full_text FROM c GROUP BY source_url, pages)
SELECT topic, md5(full_text) AS digest, CAST(pages AS INTEGER) AS num_pages, 0 AS num_tables, doc AS source_url FROM u JOIN f ON f.source_url = u.doc""")
def guideline_run_documents(spark: SparkSession, d: str) -> DataFrame:
    (guidelines, _, _), _ = _run(spark, d)
    return guidelines.select("topic", F.md5("clean_text").alias("digest"), "num_pages", "num_tables", "source_url")


_BLACK, _WIDE = 30.0, 4
_PICTURES = f"""p AS (SELECT guideline_id, unnest(generate_series(0, len(x) - 1)) AS page_number, unnest(x) AS t FROM (SELECT guideline_id, string_split(replace(raw_text, chr(10) || chr(10), chr(12)), chr(12)) AS x FROM guidelines WHERE raw_text IS NOT NULL)),
w AS (SELECT guideline_id, page_number, list_transform(list_filter(regexp_split_to_array(t, '[{S.SPACE}]+'), lambda x: x <> ''), lambda x: least(255, 20 * length(x))) AS v FROM p)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "guidelines").filter("raw_text IS NOT NULL")
    return g.select("guideline_id", F.col("guideline_id").cast("string").alias("doc"), F.encode(F.replace("raw_text", F.lit("\n\n"), F.lit("\f")), "UTF-8").alias("data"))


@query(f"WITH {_PICTURES} SELECT guideline_id, CAST(page_number AS INTEGER) AS page_number, CAST(len(v) AS INTEGER) AS width FROM w WHERE len(v) >= {_WIDE} AND list_aggregate(v, 'stddev_pop') >= {_BLACK}")
def document_images(spark: SparkSession, d: str) -> DataFrame:
    found = documents.extract_images(_files(spark, d), PictureText()).filter(F.col("width") >= _WIDE)
    kept = images.without_blank(found, images.gray_deviation(F.col("data")), _BLACK)
    return kept.select(F.col("doc").cast("long").alias("guideline_id"), "page_number", "width")


@query(f"WITH {_PICTURES} SELECT guideline_id, CAST(page_number AS INTEGER) AS page_number, CAST(len(v) AS INTEGER) AS width, 'rasterized_page' AS image_type FROM w WHERE page_number % 3 = 1")
def rasterised_pages(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    wanted = files.select("doc", F.explode(F.sequence(F.lit(1), F.lit(3001), F.lit(3))).alias("page_number"))  # most are out of range
    drawn = documents.raster_pages(files, wanted, PictureText())
    return drawn.select(F.col("doc").cast("long").alias("guideline_id"), "page_number", "width", "image_type")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """Tables as images: the bytes are their text, every ninth file is missing."""
    t = table(spark, d, "who_tables")
    name = F.concat(T.file_name(F.col("topic")), F.lit("_page"), "page_number", F.lit("_img"), "table_id", F.lit(".png"))
    return t.select("table_id", "topic", "page_number", F.lit(0).alias("image_index"), name.alias("filename"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("embedded").alias("image_type"), F.encode(T.table_text(F.col("table_data")), "UTF-8").alias("data"))


_SHOWN = f"s AS (SELECT table_id, topic, page_number, replace(topic, ' ', '_') || '_page' || page_number || '_img' || table_id || '.png' AS filename, {S.table_text('table_data')} AS body FROM who_tables)"


@query(f"WITH {_SHOWN} SELECT topic, page_number, filename, 'embedded' AS image_type FROM s")
def images_stored(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "images")
    store.save_images(_shown(spark, d), path)
    return store.load_image_table(spark, path).select("topic", "page_number", "filename", "image_type")


def byte_counts(data: bytes) -> list[float]:
    """An image model of eight numbers: how many bytes have each remainder by eight."""
    if not data:
        raise ValueError("empty image")
    out = [0.0] * 8
    for b in data:
        out[b % 8] += 1.0
    return out


def _image_run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path, files = scratch(spark, "image-run"), scratch(spark, "image-files")
    shown = _shown(spark, d)
    store.save_images(shown.filter("table_id % 9 <> 0"), files)
    model = embedding.Once("byte counts", lambda: byte_counts)
    missing = jobs.image_corpus(shown.drop("data"), store.load_images_data(spark, files), model, table(spark, d, "topic_list"), path, dimensions=8)
    return store.load_image_embeddings(spark, path, dimensions=8), missing


@query(f"""WITH {_SHOWN}, o AS (SELECT s.*, coalesce(topic_ord, {1 << 30}) AS ord FROM s LEFT JOIN topic_list USING (topic) WHERE table_id % 9 <> 0),
k AS (SELECT *, CASE WHEN regexp_matches(filename, '{K.COVER_PAGE}') THEN filename || '_' || topic ELSE md5(body) END AS key, row_number() OVER (PARTITION BY body ORDER BY ord, page_number, filename) AS rn FROM o)
SELECT min(filename) FILTER (rn = 1) AS filename, string_agg(topic, '|' ORDER BY ord, page_number, filename) AS topics, CAST(strlen(min(body)) AS BIGINT) AS n_bytes FROM k WHERE body <> '' GROUP BY key""")
def image_run(spark: SparkSession, d: str) -> DataFrame:
    vectors, _ = _image_run(spark, d)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).cast("long")
    return vectors.select("filename", F.array_join("topics", "|").alias("topics"), total.alias("n_bytes"))


@query(f"WITH {_SHOWN} SELECT filename FROM s WHERE table_id % 9 = 0")
def missing_image_files(spark: SparkSession, d: str) -> DataFrame:
    return _image_run(spark, d)[1].select("filename")


# ---- chunks of all sources


@query("SELECT source, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ("
       f"SELECT 'pubmed' AS source, text FROM ({SQL['chunk_article']}) UNION ALL SELECT 'openfda', text FROM ({SQL['chunk_drug_fields']}) UNION ALL SELECT 'who', text FROM ({SQL['chunk_guideline']})) GROUP BY source")  # fmt: skip
def chunk_all_sources(spark: SparkSession, d: str) -> DataFrame:
    names = ("articles", "drugs", "guidelines", "who_tables", "topic_list")
    chunks = jobs.chunk_corpus(*[table(spark, d, n) for n in names])
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


_LIMIT, _WINDOW, _FLOOR = 60, 50, 10


@query(f"""WITH RECURSIVE t0 AS (SELECT table_id, guideline_id, page_number, table_data, {S.tokens(S.table_text("table_data"))} AS n, 'T' || guideline_id || ' (table, page ' || page_number AS heading FROM who_tables),
big AS (SELECT * FROM t0 WHERE n > {_LIMIT}), {S.parts("big", "table_id", "list_transform(table_data, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | '))")}, {S.packed("s", _LIMIT)},
g AS (SELECT key AS table_id, g AS group_no, string_agg(part, chr(10) ORDER BY pos) AS content FROM p GROUP BY key, g),
h AS (SELECT g.*, heading || ', part ' || (group_no + 1) || '/' || count(*) OVER (PARTITION BY g.table_id) || '): ' AS prefix FROM g JOIN t0 USING (table_id)),
l AS (SELECT *, {S.lossless("content")} AS x, {S.tokens("prefix")} AS pn FROM h), w AS (SELECT *, greatest({_WINDOW} - pn, {_FLOOR}) AS w, len(x) + pn <= {_WINDOW} AS fits FROM l),
u AS (SELECT *, unnest(generate_series(0, CASE WHEN fits THEN 0 ELSE greatest(CAST(ceil(len(x) / w) AS BIGINT), 1) - 1 END)) AS sub_index FROM w)
SELECT table_id, CAST(0 AS BIGINT) AS group_no, CAST(0 AS BIGINT) AS sub_index, heading || '): ' || {S.table_text("table_data")} AS text FROM t0 WHERE n <= {_LIMIT}
UNION ALL SELECT table_id, group_no, sub_index, prefix || CASE WHEN fits THEN content ELSE array_to_string(x[sub_index * w + 1 : (sub_index + 1) * w], '') END FROM u""")
def table_split_pieces(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "who_tables").select(F.col("guideline_id").alias("doc_key"), F.concat(F.lit("T"), "guideline_id").alias("title"), F.array("topic").alias("topics"), F.col("table_id").alias("table_ord"), "page_number", "table_data")
    out = C.table_pieces(t, _LIMIT, _WINDOW, _FLOOR)
    return out.select(F.col("table_ord").alias("table_id"), F.col("group_no").cast("long"), F.col("sub_index").cast("long"), "text")


_ITEMS = 6


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT *, row_number() OVER w AS pos, coalesce(round(list_cosine_similarity(lag(e) OVER w, e), 6) < 0, false) AS starts FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
r AS (SELECT label, vec_id, pos, 1 AS n, 0 AS g FROM s WHERE pos = 1
  UNION ALL SELECT s.label, s.vec_id, s.pos, CASE WHEN s.starts OR r.n >= {_ITEMS} THEN 1 ELSE r.n + 1 END, CASE WHEN s.starts OR r.n >= {_ITEMS} THEN r.g + 1 ELSE r.g END FROM r JOIN s ON s.label = r.label AND s.pos = r.pos + 1)
SELECT label, CAST(g AS BIGINT) AS chunk_index, count(*) AS n_items, min(vec_id) AS first_item FROM r GROUP BY label, g""")
def chunk_semantic_rows(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    near = similarity.likeness_to_previous(v, "embedding", ["vec_id"], ["label"]).select("label", "vec_id", F.lit(1).alias("size"), (F.col("similarity") < 0).alias("starts"))
    packs = pack_rows(near, ["label"], ["vec_id"], "size", _ITEMS, mark="starts", out="chunk_index")
    return packs.groupBy("label", F.col("chunk_index").cast("long").alias("chunk_index")).agg(F.count(F.lit(1)).alias("n_items"), F.min("vec_id").alias("first_item"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 37 + 11) % (SELECT count(*) FROM embeddings) AND a.vec_id <> b.vec_id""")
def cosine_chosen_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.select(F.col("vec_id").alias("a"), ((F.col("vec_id") * 37 + 11) % v.count()).alias("b")).filter("a <> b")
    return similarity.of_pairs(v, pairs, "vec_id", "embedding").select("a", "b", "similarity")
