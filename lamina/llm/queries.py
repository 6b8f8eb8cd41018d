"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import budget, collapse, encode, encoding, mix, noise, sentences, similar, split
from lamina.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar.similar_pairs(table(spark, d, "drugs"))
    return pairs.withColumnsRenamed({"a": "drug_id_a", "b": "drug_id_b"})


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_groups(table(spark, d, "drugs")).withColumnRenamed("record_id", "drug_id")


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_budget(table(spark, d, "chunks"), table(spark, d, "articles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse.copies_of_first(table(spark, d, "drugs"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse.collapse_records(table(spark, d, "drugs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return noise.noisy_lines(table(spark, d, "guidelines"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return noise.repaired_texts(table(spark, d, "guidelines"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    items = split.corpus_items(table(spark, d, "guidelines"), table(spark, d, "drugs"), table(spark, d, "who_tables"))
    return split.split_items(items, table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("n_pieces > 1 AND piece_no = 0").select("item_field", "item_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.corpus_sentences(table(spark, d, "articles"), table(spark, d, "guidelines"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.document_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mix.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_kept_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), keep="shares")[1]


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_documents(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_token_budget, p3_found, p3_records, p4_found, p4_repaired, p5_found, p5_pieces,
        p6_found, p7_ids, p8_found, p8_shares, p8_kept_shares, p8_mixture, p9_found, p9_restored,
    )
}

_NAMES = """
  SELECT drug_id,
         least(regexp_replace(lower(coalesce(brand_name, '')), '[^\\p{L}\\p{N}]', '', 'g'),
               regexp_replace(lower(coalesce(generic_name, '')), '[^\\p{L}\\p{N}]', '', 'g')) AS low,
         greatest(regexp_replace(lower(coalesce(brand_name, '')), '[^\\p{L}\\p{N}]', '', 'g'),
                  regexp_replace(lower(coalesce(generic_name, '')), '[^\\p{L}\\p{N}]', '', 'g')) AS high
  FROM drugs
"""

_TRIPLES = """
w AS (SELECT drug_id, regexp_extract_all(lower(coalesce(indications_and_usage, '') || ' ' || coalesce(warnings_and_cautions, '')), '[\\p{L}\\p{N}]+') AS x FROM drugs),
t AS (SELECT DISTINCT drug_id, x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] AS triple FROM (SELECT drug_id, x, unnest(generate_series(1, len(x) - 2)) AS i FROM w WHERE len(x) >= 3)),
n AS (SELECT drug_id, count(*) AS n FROM t GROUP BY drug_id),
m AS (SELECT p.drug_id AS a, q.drug_id AS b, count(*) AS m FROM t p JOIN t q ON p.triple = q.triple AND p.drug_id < q.drug_id GROUP BY p.drug_id, q.drug_id),
pairs AS (SELECT a, b FROM m JOIN n x ON x.drug_id = a JOIN n y ON y.drug_id = b WHERE 10 * m >= 7 * (x.n + y.n - m))
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_TRIPLES} SELECT a AS drug_id_a, b AS drug_id_b FROM pairs",
    "p1_groups": f"""
WITH RECURSIVE {_TRIPLES},
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r AS (SELECT drug_id AS a, drug_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS drug_id, min(b) AS group_id FROM r GROUP BY a),
c AS (SELECT drug_id, array_to_string(x, ' ') AS said FROM w)
SELECT g.drug_id, group_id, count(DISTINCT o.said) FILTER (o.said <> c.said) AS n_links FROM g JOIN c USING (drug_id) LEFT JOIN e ON e.a = g.drug_id LEFT JOIN c o ON o.drug_id = e.b GROUP BY g.drug_id, group_id
""",
    "p3_found": f"""
WITH k AS ({_NAMES}), g AS (SELECT drug_id, min(drug_id) OVER (PARTITION BY low, high) AS first_id FROM k)
SELECT DISTINCT first_id, drug_id AS copy_id FROM g WHERE drug_id <> first_id
""",
    "p3_records": f"""
WITH k AS ({_NAMES})
SELECT min(drug_id) AS first_id, low, high, count(*) AS n_copies FROM k GROUP BY low, high
""",
    "p5_found": r"""
WITH items AS (
  SELECT 'guidelines.clean_text' AS item_field, guideline_id AS item_id, clean_text AS body FROM guidelines
  UNION ALL SELECT 'drugs.adverse_reactions', drug_id, adverse_reactions FROM drugs
  UNION ALL SELECT 'who_tables.table_data', table_id,
    array_to_string(list_transform(table_data, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | ')), chr(10))
    FROM who_tables)
SELECT DISTINCT i.item_field, i.item_id FROM items i JOIN size_limits l USING (item_field) WHERE length(i.body) > l.max_chars
""",
}
