"""Queries of the text functions and chunkers, over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import constants as K
from lamina.functions import text as T
from lamina.functions.text import SPACE
from lamina.functions.vectors import cosine
from lamina.operators import chunking, embedding, metrics, similarity
from lamina.operators.packing import packed
from lamina.plans import sql as S
from lamina.plans.registry import query
from lamina.session import table

#: Budgets of the queries: those of production, but smaller where the test texts would never reach them.
CHUNK, PREFIXED, PREFIXED_FLOOR, ROWS = 300, 400, 100, 60


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").filter("text IS NOT NULL")


@query(f"SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS idx, unnest(x) AS sentence FROM (SELECT doc_id, {S.sentences('text')} AS x FROM documents WHERE text IS NOT NULL) WHERE len(x) > 0")
def sentences_abbrev(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


@query(f"SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS idx, unnest(x) AS sentence FROM (SELECT doc_id, {S.sentences_plain('text')} AS x FROM documents WHERE text IS NOT NULL) WHERE len(x) > 0")
def sentences_regex(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences_plain(F.col("text"))).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


@query(f"SELECT doc_id, CAST({S.tokens('text')} AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query(f"""WITH RECURSIVE {S.parts("documents", "doc_id", S.sentences("text"))}, {S.packed("s", CHUNK)}
SELECT key AS doc_id, CAST(g AS BIGINT) AS chunk_index, string_agg(part, ' ' ORDER BY pos) AS chunk, CAST(sum(tok) AS BIGINT) AS n_tokens FROM p GROUP BY key, g""")
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_sentences(_docs(spark, d), "text", CHUNK).select("doc_id", F.col("chunk_index").cast("long"), "chunk", "n_tokens")


@query(f"""WITH t AS (SELECT doc_id, {S.lossless("text")} AS x FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(generate_series(0, CAST(floor((len(x) - 1) / {CHUNK}) AS BIGINT))) AS chunk_index, x FROM t WHERE len(x) > 0)
SELECT doc_id, chunk_index, array_to_string(x[chunk_index * {CHUNK} + 1 : (chunk_index + 1) * {CHUNK}], '') AS chunk FROM u""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_windows(_docs(spark, d), "text", CHUNK).select("doc_id", F.col("chunk_index").cast("long"), "chunk")


@query(f"""WITH RECURSIVE {S.parts("documents", "doc_id", S.sentences_plain("text"))},
r AS (SELECT key, pos AS stop, CAST(0 AS BIGINT) AS start, tok AS run, CAST(NULL AS BIGINT) AS e_start, CAST(NULL AS BIGINT) AS e_stop FROM st WHERE pos = 0
  UNION ALL
  SELECT n.key, n.pos,
    CASE WHEN r.run + n.tok > {CHUNK} AND r.stop - r.start + 1 >= 2 THEN n.pos - 2 ELSE r.start END,
    CASE WHEN r.run + n.tok > {CHUNK} AND r.stop - r.start + 1 >= 2 THEN (SELECT sum(q.tok) FROM st q WHERE q.key = n.key AND q.pos BETWEEN n.pos - 2 AND n.pos - 1) + n.tok ELSE r.run + n.tok END,
    CASE WHEN r.run + n.tok > {CHUNK} THEN r.start END, CASE WHEN r.run + n.tok > {CHUNK} THEN r.stop END
  FROM r JOIN st n ON n.key = r.key AND n.pos = r.stop + 1),
c AS (SELECT key, e_start AS a, e_stop AS b FROM r WHERE e_start IS NOT NULL
  UNION ALL SELECT key, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stop DESC) AS rn FROM r) WHERE rn = 1),
n AS (SELECT key, a, b, row_number() OVER (PARTITION BY key ORDER BY b) - 1 AS chunk_index FROM c)
SELECT n.key AS doc_id, n.chunk_index, string_agg(st.part, ' ' ORDER BY st.pos) AS chunk FROM n JOIN st ON st.key = n.key AND st.pos BETWEEN n.a AND n.b GROUP BY n.key, n.chunk_index""")
def chunk_sliding(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_sentences(_docs(spark, d), "text", CHUNK, T.sentences_plain, overlap=2).select("doc_id", F.col("chunk_index").cast("long"), "chunk")


@query(f"""WITH RECURSIVE {S.parts("documents", "doc_id", S.paragraphs("text"), "pp")},
q AS (SELECT key, pos, tok, tok AS run, tok > {CHUNK} AS large, 0 AS g FROM ppt WHERE pos = 0
  UNION ALL SELECT n.key, n.pos, n.tok, CASE WHEN q.large OR n.tok > {CHUNK} OR q.run + n.tok > {CHUNK} THEN n.tok ELSE q.run + n.tok END, n.tok > {CHUNK},
    CASE WHEN q.large OR n.tok > {CHUNK} OR q.run + n.tok > {CHUNK} THEN q.g + 1 ELSE q.g END FROM q JOIN ppt n ON n.key = q.key AND n.pos = q.pos + 1),
c AS (SELECT q.key, q.g, q.key || chr(3) || q.g AS ckey, any_value(q.large) AS large, string_agg(a.part, chr(10) || chr(10) ORDER BY q.pos) AS chunk FROM q JOIN pp a ON a.key = q.key AND a.pos = q.pos GROUP BY q.key, q.g),
big AS (SELECT ckey, chunk FROM c WHERE large), {S.parts("big", "ckey", S.sentences_plain("chunk"))}, {S.packed("s", CHUNK)},
f AS (SELECT key, g, 0 AS j, chunk FROM c WHERE NOT large UNION ALL SELECT c.key, c.g, p.g, string_agg(p.part, ' ' ORDER BY p.pos) FROM p JOIN c ON c.ckey = p.key GROUP BY c.key, c.g, p.g)
SELECT key AS doc_id, row_number() OVER (PARTITION BY key ORDER BY g, j) - 1 AS chunk_index, chunk FROM f""")
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_paragraphs(_docs(spark, d), "doc_id", "text", CHUNK).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"""WITH RECURSIVE t AS (SELECT guideline_id, clean_text, regexp_extract_all(clean_text, '{K.SECTION_HEADER}', 1) AS h, regexp_split_to_array(clean_text, '{K.SECTION_HEADER}') AS b FROM guidelines WHERE clean_text IS NOT NULL),
n AS (SELECT *, list_transform(h, lambda x: {S.strip("regexp_replace(x, '" + K.TRAILING_NUMBER + "', '')")}) AS plain FROM t),
f AS (SELECT *, coalesce(list_min(list_filter(generate_series(1, len(h)), lambda i: list_contains(plain[1 : i - 1], plain[i]))), 0) AS first FROM n),
x AS (SELECT guideline_id, h, b, unnest(generate_series(first, len(h))) AS i FROM f WHERE first > 0),
sec AS (SELECT guideline_id, i, {S.strip("chr(10) || h[i] || chr(10) || b[i + 1]")} AS chunk FROM x),
z AS (SELECT *, {S.tokens("chunk")} AS n, guideline_id || chr(3) || i AS ckey FROM sec WHERE chunk <> ''),
big AS (SELECT ckey, chunk FROM z WHERE n > {K.SECTION_TOKENS} UNION ALL SELECT guideline_id || chr(3) || 0, clean_text FROM f WHERE first = 0), {S.parts("big", "ckey", S.sentences("chunk"))}, {S.packed("s", 300)},
o AS (SELECT guideline_id, i, 0 AS j, chunk FROM z WHERE n <= {K.SECTION_TOKENS}
  UNION ALL SELECT CAST(string_split(key, chr(3))[1] AS BIGINT), CAST(string_split(key, chr(3))[2] AS BIGINT), g, string_agg(part, ' ' ORDER BY pos) FROM p GROUP BY key, g)
SELECT guideline_id, row_number() OVER (PARTITION BY guideline_id ORDER BY i, j) - 1 AS chunk_index, chunk FROM o""")
def chunk_section(spark: SparkSession, d: str) -> DataFrame:
    return chunking.by_sections(table(spark, d, "guidelines").select("guideline_id", "clean_text"), "guideline_id", "clean_text").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"""WITH t AS (SELECT guideline_id, title || ': ' AS prefix, clean_text, {S.lossless("clean_text")} AS x FROM guidelines WHERE clean_text IS NOT NULL),
w AS (SELECT *, {S.tokens("prefix")} AS p, greatest({PREFIXED} - {S.tokens("prefix")}, {PREFIXED_FLOOR}) AS w FROM t),
n AS (SELECT *, CASE WHEN len(x) + p <= {PREFIXED} THEN 1 ELSE greatest(CAST(ceil(len(x) / w) AS BIGINT), 1) END AS n_subs FROM w),
u AS (SELECT *, unnest(generate_series(0, n_subs - 1)) AS sub_index FROM n)
SELECT guideline_id, sub_index, n_subs, prefix || CASE WHEN len(x) + p <= {PREFIXED} THEN clean_text ELSE array_to_string(x[sub_index * w + 1 : (sub_index + 1) * w], '') END AS piece FROM u""")
def token_window_fallback(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "guidelines").filter("clean_text IS NOT NULL").select("guideline_id", F.concat("title", F.lit(": ")).alias("prefix"), "clean_text")
    out = chunking.windows_with_prefix(g, "clean_text", "prefix", PREFIXED, PREFIXED_FLOOR)
    return out.select("guideline_id", F.col("sub_index").cast("long"), F.col("n_subs").cast("long"), "piece")


@query("""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, floor(vec_id / 100) AS part FROM embeddings),
s AS (SELECT *, row_number() OVER w - 1 AS pos, round(list_cosine_similarity(lag(e) OVER w, e), 6) AS sim FROM v WINDOW w AS (PARTITION BY label, part ORDER BY vec_id)),
r AS (SELECT label, part, vec_id, pos, vec_id % 5 + 1 AS run, 0 AS g FROM s WHERE pos = 0
  UNION ALL SELECT s.label, s.part, s.vec_id, s.pos, CASE WHEN s.sim < 0 OR r.run + s.vec_id % 5 + 1 > 12 THEN s.vec_id % 5 + 1 ELSE r.run + s.vec_id % 5 + 1 END,
    CASE WHEN s.sim < 0 OR r.run + s.vec_id % 5 + 1 > 12 THEN r.g + 1 ELSE r.g END FROM r JOIN s ON s.label = r.label AND s.part = r.part AND s.pos = r.pos + 1)
SELECT label, CAST(part AS BIGINT) AS part, CAST(g AS BIGINT) AS chunk_index, count(*) AS n_items FROM r GROUP BY label, part, g""")
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("part", F.floor(F.col("vec_id") / 100))
    near = similarity.likeness_to_previous(v, "embedding", ["vec_id"], ["label", "part"])
    # a document of a hundred vectors at most; chunk_semantic_rows takes whole labels
    item = F.array_sort(F.collect_list(F.struct("vec_id", "similarity")))
    docs = near.groupBy("label", "part").agg(item.alias("i")).select("label", "part", "i", F.transform("i", lambda x: x["similarity"]).alias("sims"), F.transform("i", lambda x: (x["vec_id"] % 5 + 1).cast("int")).alias("sizes"))
    return chunking.by_similarity(docs, "i", "sizes", "sims", 0.0, 12).select("label", "part", F.col("chunk_index").cast("long"), F.col("n_items").cast("long"))


@query(f"SELECT table_id, {S.table_text('table_data')} AS table_text FROM who_tables")
def table_serialize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "who_tables").select("table_id", T.table_text(F.col("table_data")).alias("table_text"))


_ROWS = "list_transform(table_data, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | '))"


@query(f"""WITH RECURSIVE {S.parts("who_tables", "table_id", _ROWS)}, {S.packed("s", ROWS)}
SELECT key AS table_id, CAST(g + 1 AS BIGINT) AS part, count(*) AS n_rows, string_agg(part, chr(10) ORDER BY pos) AS piece FROM p GROUP BY key, g""")
def table_row_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "who_tables").select("table_id", F.transform("table_data", lambda r: F.array_join(r, " | ", "")).alias("rows"))
    cut = rows.withColumn("r", packed(F.transform("rows", T.token_count), ROWS)).select("*", F.posexplode("r").alias("g", "x"))
    return cut.select("table_id", (F.col("g") + 1).cast("long").alias("part"), F.col("x.len").cast("long").alias("n_rows"), F.array_join(F.slice("rows", F.col("x.start") + 1, F.col("x.len")), "\n").alias("piece"))


@query(f"SELECT DISTINCT chunk_id, {S.uuid5('chunk_id')} AS computed, {S.uuid5('chunk_id')} = point_id AS agrees FROM chunks WHERE chunk_id IS NOT NULL")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    computed = T.point_id(F.col("chunk_id"))
    return table(spark, d, "chunks").filter("chunk_id IS NOT NULL").select("chunk_id", computed.alias("computed"), (computed == F.col("point_id")).alias("agrees")).distinct()


_STRIPPED = S.strip(f"regexp_replace(raw_text, '{K.HEADER_FOOTER}', '', 'g')")


@query(f"SELECT guideline_id, md5({_STRIPPED}) AS digest, length({_STRIPPED}) AS n_chars FROM guidelines WHERE raw_text IS NOT NULL")
def header_footer_strip(spark: SparkSession, d: str) -> DataFrame:
    stripped = T.without_furniture(F.col("raw_text"))
    return table(spark, d, "guidelines").filter("raw_text IS NOT NULL").select("guideline_id", F.md5(stripped).alias("digest"), F.length(stripped).cast("long").alias("n_chars"))


def _phrase(words: str) -> str:
    return "(^|[^\\p{L}\\p{N}])" + words + "($|[^\\p{L}\\p{N}])"


@query(f"SELECT drug_id FROM drugs WHERE regexp_matches(lower(indications_and_usage), '{_phrase('peripheral[^\\p{L}\\p{N}]+oedema')}')")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "drugs").filter(T.says_phrase(F.col("indications_and_usage"), "peripheral oedema")).select("drug_id")


@query(f"SELECT drug_id FROM drugs WHERE regexp_matches(lower(indications_and_usage), '{_phrase('(peripheral|oedema)')}')")
def or_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "drugs").filter(T.says_any(F.col("indications_and_usage"), "peripheral oedema")).select("drug_id")


@query("""SELECT vec_id, round(list_aggregate(CAST(embedding AS DOUBLE[]), 'stddev_pop'), 6) AS std FROM embeddings WHERE list_aggregate(CAST(embedding AS DOUBLE[]), 'stddev_pop') >= 0.1""")
def blank_vectors(spark: SparkSession, d: str) -> DataFrame:
    x, n = F.col("embedding"), F.size("embedding")
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    std = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v.cast("double") - mean) * (v.cast("double") - mean)) / n)
    return table(spark, d, "embeddings").select("vec_id", std.alias("s")).filter("s >= 0.1").select("vec_id", F.round("s", 6).alias("std"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_cosine_similarity(q.e, r.e), 6) AS similarity FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, neighbour, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM c) WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return similarity.nearest(v, v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT vec_id, label, round(list_cosine_similarity(lag(e) OVER w, e), 6) AS similarity FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def lag_similarity(spark: SparkSession, d: str) -> DataFrame:
    return similarity.likeness_to_previous(table(spark, d, "embeddings"), "embedding", ["vec_id"], ["label"]).select("vec_id", "label", "similarity")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return v.join(other, v["vec_id"] == other["a"]).select("a", "b", F.round(cosine(F.col("embedding"), F.col("eb")), 6).alias("similarity"))


_SIGNS = 64


@query(f"""WITH u AS (SELECT point_id, text FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY written_at, chunk_id) AS rn FROM chunks) WHERE rn = 1),
w AS (SELECT point_id, unnest(list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '')) AS word FROM u WHERE text IS NOT NULL),
h AS (SELECT point_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w),
v AS (SELECT point_id, (h >> 1) % {_SIGNS} AS i, sum(CASE WHEN h & 1 = 1 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL),
a AS (SELECT point_id, text, unnest(generate_series(0, {_SIGNS - 1})) AS i FROM u)
SELECT a.point_id, CASE WHEN any_value(a.text) IS NOT NULL THEN string_agg(CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END, '' ORDER BY a.i) END AS signs FROM a LEFT JOIN v ON v.point_id = a.point_id AND v.i = a.i GROUP BY a.point_id""")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    """The vectors by the signs of their numbers, which no rounding touches."""
    once = table(spark, d, "chunks").select("point_id", "chunk_id", "text", "written_at")
    once = embedding.deduplicated(once, ["written_at", "chunk_id"])
    vectors = embedding.embed_texts(once.select("point_id", "text"), embedding.HashedProvider(_SIGNS))
    return vectors.select("point_id", F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "").alias("signs"))


_MARKS = "|".join(a.replace(".", "\\.") for a in K.ABBREVIATIONS)


@query(f"""SELECT doc_id, idx, sentence FROM (SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS idx, unnest(x) AS sentence FROM (SELECT doc_id, {S.sentences('text')} AS x FROM documents WHERE text IS NOT NULL) WHERE len(x) > 0)
WHERE regexp_matches(sentence, '\\b({_MARKS})\\.') AND length(sentence) < 300 ORDER BY doc_id, idx LIMIT 1""")
def abbreviation_probe(spark: SparkSession, d: str) -> DataFrame:
    return metrics.abbreviation_probe(sentences_abbrev(spark, d), "sentence", ["doc_id", "idx"])


@query("SELECT vec_id, label, md5(array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ' ')) AS digest FROM embeddings")
def vectors_by_position(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    index, matrix = v.select(F.col("vec_id").alias("place"), "vec_id", "label"), v.select(F.col("vec_id").alias("place"), "embedding")
    digest = F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), " "))
    return similarity.zipped(index, matrix).select("vec_id", "label", digest.alias("digest"))
