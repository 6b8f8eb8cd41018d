"""Raw provider records to rows; what cannot be parsed is set aside with its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import constants as K
from lamina import schemas as S


def author_names(authors: Column) -> Column:
    """Last and first name, else the collective name; authors with neither are left out, the order kept."""
    full = lambda a: F.when((F.coalesce(a["LastName"], F.lit("")) != "") & (F.coalesce(a["ForeName"], F.lit("")) != ""), F.concat(a["LastName"], F.lit(" "), a["ForeName"]))
    name = lambda a: F.coalesce(full(a), F.nullif(a["CollectiveName"], F.lit("")))
    return F.coalesce(F.filter(F.transform(authors, name), lambda n: n.isNotNull()), F.array().cast("array<string>"))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """What there is of year, month and day joined by ``-``, or ``unknown``."""
    parts = [F.nullif(x, F.lit("")) for x in (year, month, day)]
    return F.coalesce(F.nullif(F.concat_ws("-", *parts), F.lit("")), F.lit("unknown"))


def parse_articles(raw: DataFrame, payload: str = "payload", topic: str = "topic", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Articles and failures of JSON payloads.

    Failures have ``source, topic, key, error``: payloads that are no JSON, and records without id, title or language.
    The columns in ``keep`` come along on both sides.
    """
    record = F.from_json(F.col(payload), S.RAW_ARTICLE_DDL, {"mode": "PERMISSIVE"})
    r = raw.select(F.col(topic).alias("topic"), *keep, record.alias("r"))
    article = F.col("r.MedlineCitation.Article")
    date = article["Journal"]["JournalIssue"]["PubDate"]
    pmid = F.col("r.MedlineCitation.PMID")
    parsed = r.select(
        pmid.alias("pmid"), article["ArticleTitle"].alias("title"), F.coalesce(F.array_join(article["Abstract"]["AbstractText"], " "), F.lit("")).alias("abstract"),
        author_names(article["AuthorList"]).alias("authors"), F.coalesce(article["Journal"]["Title"], F.lit("")).alias("journal"),
        partial_date(date["Year"], date["Month"], date["Day"]).alias("pub_date"), F.get(article["Language"], F.lit(0)).alias("language"), "topic",
        F.lit("pubmed").alias("source"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url"), *keep,
    )
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("pmid", "title", "language")]))
    checked = parsed.withColumn("lacking", lacking)
    ok = checked.filter(F.size("lacking") == 0).drop("lacking")
    failed = checked.filter(F.size("lacking") > 0).select(F.lit("pubmed").alias("source"), "topic", F.col("pmid").alias("key"), F.concat(F.lit("missing "), F.array_join("lacking", ", ")).alias("error"), *keep)
    return ok, failed


def parse_labels(raw: DataFrame, payload: str = "payload", topic: str = "topic", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Drug labels and failures of JSON payloads.

    Brand and generic name stand in for each other; a record with neither, or with an empty list of
    names, fails. Sections are joined by a space; an empty one is null, but for the indications.
    """
    record = F.from_json(F.col(payload), S.RAW_DRUG_DDL, {"mode": "PERMISSIVE"})
    r = raw.select(F.col(topic).alias("topic"), *keep, record.alias("r"))
    names = F.col("r.openfda")
    first = lambda f: F.nullif(F.get(names[f], F.lit(0)), F.lit(""))
    section = lambda f: F.coalesce(F.array_join(F.col(f"r.{f}"), " "), F.lit(""))
    empty_list = F.coalesce(F.size(names["brand_name"]) == 0, F.lit(False)) | F.coalesce(F.size(names["generic_name"]) == 0, F.lit(False)) | F.coalesce(F.size(names["pharm_class_epc"]) == 0, F.lit(False))
    parsed = r.select(
        F.coalesce(first("brand_name"), first("generic_name")).alias("brand_name"), F.coalesce(first("generic_name"), first("brand_name")).alias("generic_name"),
        first("pharm_class_epc").alias("drug_class"), section("indications_and_usage").alias("indications_and_usage"),
        *[F.nullif(section(f), F.lit("")).alias(f) for f in K.DRUG_SECTIONS if f != "indications_and_usage"],
        "topic", F.lit("openfda").alias("source"), empty_list.alias("empty_list"), *keep,
    )
    bad = F.col("empty_list") | F.col("brand_name").isNull()
    ok = parsed.filter(~bad).drop("empty_list")
    error = F.when(F.col("empty_list"), F.lit("empty list of names")).otherwise(F.lit("No brand_name or generic_name"))
    failed = parsed.filter(bad).select("source", "topic", F.lit(None).cast("string").alias("key"), error.alias("error"), *keep)
    return ok, failed


def bundle_files_url(bundles: Column) -> Column:
    """From the answer about the bundles of an item (JSON): the address of the files of the bundle named ORIGINAL; null if there is none."""
    listed = F.from_json(bundles, "struct<_embedded:struct<bundles:array<struct<name:string,_links:struct<bitstreams:struct<href:string>>>>>>")["_embedded"]["bundles"]
    return F.get(F.filter(listed, lambda b: b["name"] == "ORIGINAL"), F.lit(0))["_links"]["bitstreams"]["href"]


def first_file_url(files: Column) -> Column:
    """From the answer about the files of a bundle (JSON): the content address of the first; null if there is none."""
    listed = F.from_json(files, "struct<_embedded:struct<bitstreams:array<struct<_links:struct<content:struct<href:string>>>>>>")["_embedded"]["bitstreams"]
    return F.get(listed, F.lit(0))["_links"]["content"]["href"]
