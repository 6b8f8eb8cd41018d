"""Queries of merging, chunking by source, parsing, images and runs, over the tables of the domain."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions import text as T
from lamina.operators import dedup, embedding, images, metrics, pages, parsing
from lamina.operators import sources_chunking as C
from lamina.plans import jobs
from lamina.plans import sql as S
from lamina.plans.registry import SQL, query
from lamina.session import scratch, table
from lamina.sources import store
from lamina.streaming import ingest

_TOPIC_OF = lambda t: f"(SELECT {t}.*, coalesce(topic_ord, {1 << 30}) AS ord FROM {t} LEFT JOIN topic_list USING (topic))"
_ARTICLES = f"""a AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY ord, fetched_at, title NULLS FIRST) AS rn FROM {_TOPIC_OF("articles")}),
m AS (SELECT pmid, max(title) FILTER (rn = 1) AS title, max(abstract) FILTER (rn = 1) AS abstract, string_agg(topic, '|' ORDER BY rn) AS topics FROM a GROUP BY pmid)"""


@query(f"""WITH RECURSIVE {_ARTICLES}, {S.parts("m", "pmid", S.sentences("abstract"))}, {S.packed("s", K.ARTICLE_TOKENS)},
c AS (SELECT key AS pmid, g, string_agg(part, ' ' ORDER BY pos) AS raw_text FROM p GROUP BY key, g)
SELECT pmid || '_pubmed_' || g AS chunk_id, {S.uuid5("pmid || '_pubmed_' || g")} AS point_id, title || ': ' || raw_text AS text, raw_text, topics, pmid AS source_id, CAST(g AS BIGINT) AS chunk_index FROM c JOIN m USING (pmid)""")
def chunk_article(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.article_chunks(table(spark, d, "articles"), table(spark, d, "topic_list"))
    return chunks.select("chunk_id", "point_id", "text", "raw_text", F.array_join("topics", "|").alias("topics"), "source_id", F.col("chunk_index").cast("long"))


_LABELS = f"""a AS (SELECT *, lower({S.strip("brand_name")}) AS key0, row_number() OVER (PARTITION BY lower({S.strip("brand_name")}) ORDER BY ord, drug_id) AS rn FROM {_TOPIC_OF("drugs")}),
m AS (SELECT key0, string_agg(topic, '|' ORDER BY rn) AS topics FROM a GROUP BY key0),
f AS (SELECT key0, brand_name, unnest([{", ".join(str(i) for i in range(7))}]) AS ord_, unnest([{", ".join(repr(f) for f in K.DRUG_SECTIONS)}]) AS field,
  unnest([{", ".join(repr(x) for x in K.DRUG_SECTIONS.values())}]) AS label, unnest([{", ".join(K.DRUG_SECTIONS)}]) AS body FROM a WHERE rn = 1),
g AS (SELECT *, key0 || chr(3) || ord_ AS fkey, {S.tokens("body")} AS n FROM f WHERE coalesce(body, '') <> ''),
big AS (SELECT fkey, body FROM g WHERE n > {K.LABEL_TOKENS})"""


@query(f"""WITH RECURSIVE {_LABELS}, {S.parts("big", "fkey", S.sentences("body"))}, {S.packed("s", K.LABEL_TOKENS)},
c AS (SELECT fkey, 0 AS piece, body AS raw_text FROM g WHERE n <= {K.LABEL_TOKENS} UNION ALL SELECT key, p.g, string_agg(part, ' ' ORDER BY pos) FROM p GROUP BY key, p.g),
i AS (SELECT g.*, c.raw_text, row_number() OVER (PARTITION BY g.key0 ORDER BY g.ord_, c.piece) - 1 AS chunk_index FROM c JOIN g USING (fkey))
SELECT brand_name || '_openfda_' || chunk_index AS chunk_id, field, brand_name || ' — ' || label || ': ' || raw_text AS text, raw_text, topics, chunk_index FROM i JOIN m USING (key0)""")
def chunk_drug_fields(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.label_chunks(table(spark, d, "drugs"), table(spark, d, "topic_list"))
    return chunks.select("chunk_id", F.col("metadata.field").alias("field"), "text", "raw_text", F.array_join("topics", "|").alias("topics"), F.col("chunk_index").cast("long"))


@query(f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY ord, guideline_id) AS rn FROM {_TOPIC_OF("guidelines")}),
m AS (SELECT max(guideline_id) FILTER (rn = 1) AS doc_key, max(title) FILTER (rn = 1) AS title, max(clean_text) FILTER (rn = 1) AS clean_text,
  string_agg(topic, '|' ORDER BY rn) AS topics, string_agg(topic, '+' ORDER BY topic) AS canonical FROM a GROUP BY source_url),
{S.parts("m", "doc_key", S.sentences("clean_text"))}, {S.packed("s", K.GUIDELINE_TOKENS)},
t AS (SELECT key AS doc_key, 0 AS kind, 0 AS x, g AS y, string_agg(part, ' ' ORDER BY pos) AS raw_text, CAST(NULL AS INTEGER) AS page FROM p GROUP BY key, g
  UNION ALL SELECT guideline_id, 1, table_id, 0, {S.table_text("table_data")}, page_number FROM who_tables),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY kind, x, y) - 1 AS chunk_index FROM t JOIN m USING (doc_key))
SELECT doc_key, canonical || '_who_' || CASE kind WHEN 0 THEN 'text' ELSE 'table' END || '_' || chunk_index AS chunk_id, CASE kind WHEN 0 THEN 'text' ELSE 'table' END AS chunk_type,
  CASE kind WHEN 0 THEN title || ': ' || raw_text ELSE title || ' (table, page ' || page || '): ' || raw_text END AS text, topics, chunk_index FROM n""")
def chunk_guideline(spark: SparkSession, d: str) -> DataFrame:
    chunks = C.guideline_chunks(table(spark, d, "guidelines"), table(spark, d, "who_tables"), table(spark, d, "topic_list"))
    return chunks.select("doc_key", "chunk_id", "chunk_type", "text", F.array_join("topics", "|").alias("topics"), F.col("chunk_index").cast("long"))


@query("""SELECT source, point_id, chunk_id, chunk_index, metadata.title AS title FROM
(SELECT *, row_number() OVER (PARTITION BY source, point_id ORDER BY written_at, metadata.title NULLS FIRST) AS rn FROM chunks) WHERE rn = 1""")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("source", "point_id", "chunk_id", "chunk_index", F.col("metadata.title").alias("title"), "written_at")
    once = embedding.deduplicated(chunks, ["written_at", "title"], within=["source"])
    return once.select("source", "point_id", "chunk_id", "chunk_index", "title")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = C.with_topic_order(table(spark, d, "articles").select("pmid", "title", "topic", "fetched_at"), table(spark, d, "topic_list"))
    return dedup.merge_by_key(rows, "pmid", ["topic_ord", "fetched_at", "title"], "topic", ["title"])


@query(f"WITH {_ARTICLES} SELECT pmid, title, topics FROM m")
def topics_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("pmid", "title", F.array_join("topics", "|").alias("topics"))


@query("SELECT topic, pmid, count(*) AS n FROM articles GROUP BY topic, pmid")
def fanout_topics(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fan_out(_merged(spark, d).select("pmid", "topics")).groupBy("topic", "pmid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_topics, count(*) AS n_keys FROM (SELECT pmid, count(*) AS n_topics FROM articles GROUP BY pmid) GROUP BY n_topics")
def overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overlap(_merged(spark, d)).withColumn("n_topics", F.col("n_topics").cast("long"))


_GROUPS = [("|".join(g), "+".join(sorted(g))) for g in K.GUIDELINE_GROUPS]


@query("SELECT topics, array_to_string(list_sort(string_split(topics, '|')), '+') AS canonical_id FROM " + S.values([(g[0],) for g in _GROUPS], "topics"))
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(g,) for g in K.GUIDELINE_GROUPS], "topics array<string>")
    return groups.select(F.array_join("topics", "|").alias("topics"), T.canonical_id(F.col("topics")).alias("canonical_id"))


@query(f"""WITH k AS (SELECT topic, drug_id, brand_name, row_number() OVER (PARTITION BY topic, lower({S.strip("brand_name")}) ORDER BY drug_id) AS rn FROM drugs),
c AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY drug_id) AS place FROM k WHERE rn = 1) SELECT topic, drug_id, brand_name FROM c WHERE place <= {K.LABELS_PER_TOPIC}""")
def brand_dedup_cap(spark: SparkSession, d: str) -> DataFrame:
    once = dedup.first_by_key(table(spark, d, "drugs").select("topic", "drug_id", "brand_name"), ["topic", T.brand_key(F.col("brand_name"))], ["drug_id"])
    return dedup.capped(once, ["topic"], ["drug_id"], K.LABELS_PER_TOPIC)


@query(f"""WITH have AS (SELECT DISTINCT t AS topic, source_id AS pmid FROM (SELECT unnest(topics) AS t, source_id, chunk_index FROM chunks WHERE source = 'pubmed') WHERE chunk_index = 0),
n AS (SELECT topic, count(DISTINCT pmid) AS have FROM have GROUP BY topic),
c AS (SELECT topic, pmid FROM (SELECT DISTINCT topic, pmid FROM articles) x WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.topic = x.topic AND h.pmid = x.pmid)),
r AS (SELECT c.topic, c.pmid, row_number() OVER (PARTITION BY c.topic ORDER BY c.pmid) AS rn, {K.ARTICLES_PER_TOPIC} - coalesce(n.have, 0) AS need FROM c LEFT JOIN n USING (topic))
SELECT topic, pmid FROM r WHERE rn <= need""")
def new_keys_needed(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "articles").select("topic", "pmid").distinct().withColumn("rank", F.col("pmid"))
    have = table(spark, d, "chunks").filter("source = 'pubmed' AND chunk_index = 0").select(F.explode("topics").alias("topic"), F.col("source_id").alias("pmid"))
    return dedup.new_keys(found, have, "topic", "pmid", "rank", K.ARTICLES_PER_TOPIC).select("topic", "pmid")


@query("SELECT t.topic, coalesce(o.term, t.topic) AS term FROM topic_list t LEFT JOIN (SELECT * FROM " + S.values(list(K.SEARCH_TERMS.items()), "topic, term") + ") o ON o.topic = t.topic")
def search_override(spark: SparkSession, d: str) -> DataFrame:
    overrides = spark.createDataFrame(list(K.SEARCH_TERMS.items()), "topic string, term string")
    return dedup.with_search_term(table(spark, d, "topic_list").select("topic"), overrides)


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Articles as the provider would send them; those of unknown language come without their id."""
    a = table(spark, d, "articles")
    date = F.split("pub_date", "-")
    part = lambda i: F.coalesce(F.get(date, F.lit(i)), F.lit(""))
    known = F.col("pub_date") != "unknown"
    author = lambda x: F.struct(F.split(x, " ", 2)[0].alias("LastName"), F.get(F.split(x, " ", 2), F.lit(1)).alias("ForeName"), F.lit(None).cast("string").alias("CollectiveName"))
    article = F.struct(
        F.col("title").alias("ArticleTitle"), F.array("language").alias("Language"), F.struct(F.array_compact(F.array("abstract")).alias("AbstractText")).alias("Abstract"),
        F.transform("authors", author).alias("AuthorList"),
        F.struct(F.col("journal").alias("Title"), F.struct(F.struct(F.when(known, part(0)).alias("Year"), F.when(known, part(1)).alias("Month"), F.when(known, part(2)).alias("Day")).alias("PubDate")).alias("JournalIssue")).alias("Journal"),
    )
    return a.select("topic", F.to_json(F.struct(F.struct(F.when(F.col("language") != "und", F.col("pmid")).alias("PMID"), article.alias("Article")).alias("MedlineCitation"))).alias("payload"))


@query("""SELECT pmid, topic, coalesce(abstract, '') AS abstract, pub_date, language, array_to_string(list_filter(authors, lambda x: contains(x, ' ')), '; ') AS authors FROM articles
WHERE language <> 'und' AND title IS NOT NULL""")
def parse_safe_ok(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = parsing.parse_articles(_payloads(spark, d))
    return ok.select("pmid", "topic", "abstract", "pub_date", "language", F.array_join("authors", "; ").alias("authors"))


@query("SELECT topic, 'missing pmid' AS error, count(*) AS n FROM articles WHERE language = 'und' AND title IS NOT NULL GROUP BY topic")
def parse_safe_failed(spark: SparkSession, d: str) -> DataFrame:
    _, failed = parsing.parse_articles(_payloads(spark, d))
    return failed.groupBy("topic", "error").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(nullif(brand_name, ''), generic_name) AS brand_name, coalesce(nullif(generic_name, ''), brand_name) AS generic_name, drug_class,
coalesce(indications_and_usage, '') AS indications_and_usage, nullif(adverse_reactions, '') AS adverse_reactions, topic FROM drugs WHERE coalesce(nullif(brand_name, ''), nullif(generic_name, '')) IS NOT NULL""")
def parse_labels_ok(spark: SparkSession, d: str) -> DataFrame:
    names = F.struct(F.array("brand_name").alias("brand_name"), F.array("generic_name").alias("generic_name"), F.when(F.col("drug_class").isNotNull(), F.array("drug_class")).alias("pharm_class_epc"))
    payload = F.to_json(F.struct(names.alias("openfda"), *[F.when(F.col(f).isNotNull(), F.array(f)).alias(f) for f in K.DRUG_SECTIONS]))
    ok, _ = parsing.parse_labels(table(spark, d, "drugs").select("topic", payload.alias("payload")))
    return ok.select("brand_name", "generic_name", "drug_class", "indications_and_usage", "adverse_reactions", "topic")


@query("""SELECT o_orderkey, coalesce(nullif(concat_ws('-', CAST(year(o_orderdate) AS VARCHAR), nullif(CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END, ''),
nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') END, '')), ''), 'unknown') AS pub_date FROM orders""")
def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    month = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.date_format("o_orderdate", "MM"))
    day = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format("o_orderdate", "dd"))
    return o.select("o_orderkey", parsing.partial_date(F.date_format("o_orderdate", "yyyy"), month, day).alias("pub_date"))


_PAGES = """g AS (SELECT guideline_id, string_split(raw_text, chr(10) || chr(10)) AS x FROM guidelines WHERE raw_text IS NOT NULL),
pg AS (SELECT guideline_id, unnest(generate_series(0, len(x) - 1)) AS page_number, unnest(x) AS t FROM g)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "guidelines").filter("raw_text IS NOT NULL").select("guideline_id", F.posexplode(F.split("raw_text", "\n\n")).alias("page_number", "raw"))


@query(f"WITH {_PAGES} SELECT guideline_id, md5(coalesce(string_agg(t, chr(10) ORDER BY page_number) FILTER (t <> ''), '')) AS digest, count(*) AS num_pages FROM pg GROUP BY guideline_id")
def page_concat(spark: SparkSession, d: str) -> DataFrame:
    return pages.assemble(_pages(spark, d), "guideline_id", "page_number", "raw").select("guideline_id", F.md5("full_text").alias("digest"), "num_pages")


_CAPTION = f"regexp_matches(t, '(?i){K.FIGURE_CAPTION}')"


@query(f"WITH {_PAGES} SELECT guideline_id, page_number FROM pg WHERE {_CAPTION}")
def figure_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.figure_pages(_pages(spark, d)).select("guideline_id", F.col("page_number").cast("long"))


@query(f"WITH {_PAGES} SELECT guideline_id, page_number FROM pg WHERE {_CAPTION} AND NOT EXISTS (SELECT 1 FROM who_tables w WHERE w.guideline_id = pg.guideline_id AND w.page_number = pg.page_number)")
def figure_without_image(spark: SparkSession, d: str) -> DataFrame:
    captions = pages.figure_pages(_pages(spark, d)).select("guideline_id", "page_number")
    return pages.figures_without_image(captions, table(spark, d, "who_tables"), ("guideline_id", "page_number")).select("guideline_id", F.col("page_number").cast("long"))


_HEAD = "md5(array_to_string(list_transform(table_data[1], lambda c: coalesce(c, '')), ' | '))"


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """Tables in the place of images: their columns and rows as sides, their first row as bytes."""
    t = table(spark, d, "who_tables")
    first = F.get("table_data", F.lit(0))
    return t.select("table_id", "topic", "page_number", F.size(first).alias("width"), F.size("table_data").alias("height"), F.md5(F.array_join(first, " | ", "")).alias("digest"))


@query(f"""WITH t AS (SELECT table_id, topic, {_HEAD} AS h FROM who_tables WHERE len(table_data[1]) >= 3 AND len(table_data) >= 3),
c AS (SELECT *, count(*) OVER (PARTITION BY topic, h) AS n, row_number() OVER (PARTITION BY topic, h ORDER BY table_id) AS rn FROM t) SELECT topic, table_id FROM c WHERE n <= 3 AND rn = 1""")
def image_filter_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return images.once_per_document(images.large_enough(_grids(spark, d), 3), F.col("digest"), "topic", ["table_id"]).select("topic", "table_id")


@query(f"""WITH t AS (SELECT table_id, topic, coalesce(topic_ord, {1 << 30}) AS ord, {_HEAD} AS h, replace(topic, ' ', '_') || '_page' || (page_number - 1) || '_img' || (len(table_data) % 2) || '.png' AS filename
  FROM who_tables LEFT JOIN topic_list USING (topic)),
k AS (SELECT *, CASE WHEN regexp_matches(filename, '{K.COVER_PAGE}') THEN filename || '_' || topic ELSE h END AS key FROM t)
SELECT key, arg_min(filename, ord * 1000000 + table_id) AS filename, string_agg(topic, '|' ORDER BY ord, table_id) AS topics FROM k GROUP BY key""")
def image_cover_rule(spark: SparkSession, d: str) -> DataFrame:
    grids = C.with_topic_order(_grids(spark, d), table(spark, d, "topic_list"))
    name = F.concat(T.file_name(F.col("topic")), F.lit("_page"), F.col("page_number") - 1, F.lit("_img"), F.col("height") % 2, F.lit(".png"))
    named = grids.withColumns({"filename": name, "image_type": F.lit("embedded")})
    return images.once_across_topics(named, F.col("digest"), ["topic_ord", "table_id"]).select("key", "filename", F.array_join("topics", "|").alias("topics"))


@query("SELECT source_url, count(*) AS n, min(guideline_id) AS first_id FROM guidelines GROUP BY source_url")
def url_memo(spark: SparkSession, d: str) -> DataFrame:
    named = dedup.with_first(table(spark, d, "guidelines").select("guideline_id", "source_url"), "source_url", "guideline_id")
    return named.groupBy("source_url", "first_id").agg(F.count(F.lit(1)).alias("n"))


_BATCH, _MOST = 2000, 12


def _request_batches(spark: SparkSession, d: str) -> DataFrame:
    """Sizes are counted where texts are read; the first delivery of a chunk is told by its size alone."""
    sized = table(spark, d, "chunks").filter("chunk_id IS NOT NULL").select("source", "source_id", "chunk_id", "written_at", F.col("metadata.title").alias("title"), T.token_count(F.col("text")).alias("n"))
    once = dedup.first_by_key(sized, ["chunk_id"], ["written_at", "title"])
    return embedding.request_batches(once, "chunk_id", "n", ["source", "source_id"], ["chunk_id"], _BATCH, _MOST, count=lambda n: n)


@query(f"""WITH RECURSIVE u AS (SELECT source, source_id, chunk_id, {S.tokens("text")} AS tok FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY written_at, metadata.title NULLS FIRST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY chunk_id) AS pos FROM u),
p AS (SELECT source, source_id, chunk_id, pos, tok AS run, 1 AS n, 0 AS b FROM o WHERE pos = 1
  UNION ALL SELECT o.source, o.source_id, o.chunk_id, o.pos, CASE WHEN p.run + o.tok > {_BATCH} OR p.n >= {_MOST} THEN o.tok ELSE p.run + o.tok END,
    CASE WHEN p.run + o.tok > {_BATCH} OR p.n >= {_MOST} THEN 1 ELSE p.n + 1 END, CASE WHEN p.run + o.tok > {_BATCH} OR p.n >= {_MOST} THEN p.b + 1 ELSE p.b END
  FROM p JOIN o ON o.source = p.source AND o.source_id = p.source_id AND o.pos = p.pos + 1)
SELECT source, source_id, chunk_id, CAST(b AS BIGINT) AS batch_id FROM p""")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    return _request_batches(spark, d).select("source", "source_id", "chunk_id", F.col("batch_id").cast("long"))


@query(SQL["embed_batches"].replace("SELECT source, source_id, chunk_id, CAST(b AS BIGINT) AS batch_id FROM p", "SELECT p.source, p.source_id, CAST(p.b AS BIGINT) AS batch_id, count(*) AS n_chunks, CAST(sum(o.tok) AS BIGINT) AS n_tokens FROM p JOIN o USING (source, source_id, chunk_id) GROUP BY p.source, p.source_id, p.b"))
def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.batch_stats(_request_batches(spark, d).withColumn("batch_id", F.col("batch_id").cast("long")), ["source", "source_id"])


@query("SELECT t.topic, count(c.topic) AS n_chunks FROM topic_list t LEFT JOIN (SELECT unnest(topics) AS topic FROM chunks) c ON c.topic = t.topic GROUP BY t.topic")
def chunks_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return metrics.chunks_by_topic(table(spark, d, "topic_list"), table(spark, d, "chunks"))


@query("SELECT DISTINCT point_id, chunk_id, source, array_to_string(topics, '|') AS topics, source_id, chunk_type FROM chunks")
def index_projection(spark: SparkSession, d: str) -> DataFrame:
    return store.index_columns(table(spark, d, "chunks")).withColumn("topics", F.array_join("topics", "|")).distinct()


_ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY written_at, chunk_id) AS rn FROM chunks) WHERE rn = 1)"


def _once(spark: SparkSession, d: str) -> DataFrame:
    return embedding.deduplicated(table(spark, d, "chunks").select("point_id", "chunk_id", "source", "source_id", "text", "topics", "chunk_type", "written_at"), ["written_at", "chunk_id"])


@query(f"SELECT source, n_chunks, n_tokens, round(n_tokens * {K.DOLLARS_PER_MILLION} / 1e6, 8) AS dollars FROM (SELECT source, count(*) AS n_chunks, CAST(sum({S.tokens('text')}) AS BIGINT) AS n_tokens FROM {_ONCE} GROUP BY source)")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    return metrics.token_cost(_once(spark, d), "source", "text")


@query("SELECT source, count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_chars FROM chunks GROUP BY source")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.chunk_lengths(table(spark, d, "chunks"), "source", "text")


@query(f"SELECT point_id, length(text) AS n_chars FROM {_ONCE} ORDER BY length(text) DESC, point_id LIMIT 5")
def longest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.longest(_once(spark, d), "text", ["point_id"]).withColumn("n_chars", F.col("n_chars").cast("long"))


@query("SELECT topic, count(DISTINCT source_id) AS n_keys, count(*) AS n_chunks FROM (SELECT source_id, unnest(topics) AS topic FROM chunks) GROUP BY topic")
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.topic_counts(table(spark, d, "chunks"), "source_id")


@query("SELECT count(*) AS topics, CAST(sum(n) AS BIGINT) AS fetched, CAST(sum(f) AS BIGINT) AS failed FROM (SELECT topic, count(*) AS n, count(*) FILTER (language = 'und') AS f FROM articles GROUP BY topic)")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "articles").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("language") == "und").alias("f"))
    return metrics.run_totals(runs.withColumn("one", F.lit(1)), topics="one", fetched="n", failed="f")


@query("SELECT topic FROM topic_list WHERE topic NOT IN (SELECT topic FROM guidelines WHERE topic IS NOT NULL)")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return metrics.missing_from(table(spark, d, "topic_list"), table(spark, d, "guidelines"), "topic")


@query("SELECT guideline_id, topic, first_id FROM guidelines JOIN (SELECT source_url, min(guideline_id) AS first_id FROM guidelines GROUP BY source_url) USING (source_url)")
def retag_documents(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "guidelines").select("guideline_id", "topic", "source_url")
    return dedup.with_first(g, "source_url", "guideline_id").select("guideline_id", "topic", "first_id")


@query("""SELECT replace(topic, ' ', '_') AS topic, source, count(*) AS n FROM (SELECT unnest(topics) AS topic, source FROM chunks) GROUP BY topic, source""")
def store_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "store")
    chunks = table(spark, d, "chunks").select("chunk_id", "point_id", "text", "raw_text", "source", "topics", "source_id", "chunk_index", "chunk_type", "metadata")
    store.save_chunks(chunks, path)
    return store.load_chunks(spark, path).groupBy("topic", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT topic, pmid FROM articles")
def stream_articles(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark, "stream")
    schema = table(spark, d, "articles").select("topic", "pmid", "title", "fetched_at").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields).replace("timestamp_ntz", "timestamp")
    for run in range(2):  # the second run finds nothing new
        stream = ingest.unique_articles(spark, f"{d}/articles.parquet", ddl)
        ingest.ingest_stream(stream, f"{base}/table", f"{base}/state-{run}").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("topic", "pmid")


@query(f"""WITH f AS (SELECT topic, pmid, row_number() OVER (PARTITION BY topic ORDER BY pmid) AS rn FROM (SELECT DISTINCT topic, pmid FROM articles WHERE language <> 'und')),
n AS (SELECT topic, count(*) FILTER (rn <= {K.ARTICLES_PER_TOPIC}) AS n FROM f GROUP BY topic)
SELECT topic, n AS fetched, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS skipped, 1 AS run FROM n UNION ALL SELECT topic, 0, 0, n, 2 FROM n""")
def ingest_incremental(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "articles")
    raw = _payloads(spark, d)
    found = table(spark, d, "articles").filter("language <> 'und'").select("topic", "pmid").distinct().withColumn("rank", F.col("pmid"))
    reader = lambda chosen: raw.withColumn("pmid", F.get_json_object("payload", "$.MedlineCitation.PMID")).join(chosen.select("topic", "pmid"), ["topic", "pmid"], "left_semi").dropDuplicates(["topic", "pmid"]).drop("pmid")
    first = jobs.ingest_articles(spark, found, reader, path)
    second = jobs.ingest_articles(spark, found, reader, path)
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
