"""Network providers as Spark data sources.

The transport is a parameter: a callable of (address, parameters) that gives (status, body). Without
one, addresses are fetched with the standard library; tests and offline runs pass saved payloads.
A provider's rate holds for the whole job: topics are read in ``at_once`` partitions (one unless asked
otherwise), and each waits that many delays before a request.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina import constants as K
from lamina.operators.parsing import bundle_files_url, first_file_url
from lamina.session import cut_lineage
from lamina.settings import request_delay

Transport = Callable[[str, dict], tuple[int, str]]

ARTICLE_SEARCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi"
ARTICLE_FETCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"
LABEL_SEARCH = "https://api.fda.gov/drug/label.json"


def http(address: str, parameters: dict) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    try:
        with urlopen(f"{address}?{urlencode(parameters)}", timeout=30) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, ""


def search_articles(topic: str, most: int, transport: Transport, email: str, key: str | None = None) -> list[str]:
    """Ids of articles on a topic in the provider's order; the limit is part of the request."""
    asked = {"db": "pubmed", "term": topic, "retmax": most, "retmode": "json", "email": email} | ({"api_key": key} if key else {})
    status, body = transport(ARTICLE_SEARCH, asked)
    if status != 200:
        raise OSError(f"article search: status {status}")
    return list(json.loads(body)["esearchresult"]["idlist"])


def fetch_labels(topic: str, transport: Transport, limit: int = K.RAW_LABELS_PER_TOPIC, attempts: int = 3, key: str | None = None, term: str | None = None, wait: Callable[[float], None] = time.sleep) -> list[dict]:
    """Raw labels whose indications hold the term as a phrase.

    Another status than 200 gives nothing and is not tried again; a failed connection is, after two
    seconds, and gives nothing in the end.
    """
    asked = {"search": f'indications_and_usage:"{term or topic}"', "limit": limit} | ({"api_key": key} if key else {})
    for attempt in range(attempts):
        try:
            status, body = transport(LABEL_SEARCH, asked)
            return json.loads(body).get("results", []) if status == 200 else []
        except OSError:
            if attempt + 1 < attempts:
                wait(2.0)
    return []


class _Topics(InputPartition):
    def __init__(self, topics: list[tuple[int, str]]) -> None:
        self.topics = topics


class _TopicReader(DataSourceReader):
    """Reads topics one after the other, in at most ``at_once`` partitions."""

    def __init__(self, options: dict, transport: Transport) -> None:
        self.options, self.transport = options, transport
        self.at_once = max(1, int(options.get("at_once", 1)))

    def partitions(self) -> list[_Topics]:
        topics = list(enumerate(json.loads(self.options["topics"])))
        return [_Topics(topics[i :: self.at_once]) for i in range(min(self.at_once, len(topics)))] or [_Topics([])]

    def delay(self) -> float:
        return request_delay(bool(self.options.get("api_key")))

    def asked(self) -> Transport:
        """The transport, which waits before every request but the first."""
        waited = [False]

        def ask(address: str, parameters: dict) -> tuple[int, str]:
            if waited[0]:
                time.sleep(float(self.options.get("delay", self.delay())) * self.at_once)
            waited[0] = True
            return self.transport(address, parameters)

        return ask

    def read(self, partition: _Topics) -> Iterator[tuple]:
        ask = self.asked()
        for rank, topic in partition.topics:
            for seq, payload in enumerate(self.payloads(topic, ask)):
                yield topic, rank, seq, payload


class _LabelReader(_TopicReader):
    def delay(self) -> float:
        return 0.25  # 240 requests a minute

    def payloads(self, topic: str, ask: Transport) -> Iterator[str]:
        terms = json.loads(self.options.get("terms", "{}"))
        limit = int(self.options.get("limit", K.RAW_LABELS_PER_TOPIC))
        return map(json.dumps, fetch_labels(topic, ask, limit, key=self.options.get("api_key"), term=terms.get(topic)))


class _SearchReader(_TopicReader):
    def payloads(self, topic: str, ask: Transport) -> Iterator[str]:
        return iter(search_articles(topic, int(self.options.get("limit", K.ARTICLES_PER_TOPIC)), ask, self.options["email"], self.options.get("api_key")))


class _ArticleReader(_TopicReader):
    def payloads(self, topic: str, ask: Transport) -> Iterator[str]:
        email, key = self.options["email"], self.options.get("api_key")
        wanted = json.loads(self.options.get("ids", "{}")).get(topic) if "ids" in self.options else search_articles(topic, int(self.options.get("limit", K.ARTICLES_PER_TOPIC)), ask, email, key)
        if not wanted:
            return iter(())
        status, body = ask(ARTICLE_FETCH, {"db": "pubmed", "id": ",".join(wanted), "retmode": "xml", "email": email} | ({"api_key": key} if key else {}))
        if status != 200:
            raise OSError(f"article fetch: status {status}")
        return article_payloads(body)


def article_payloads(xml: str) -> Iterator[str]:
    """One JSON payload an article of a fetched set."""
    from xml.etree import ElementTree

    text = lambda e: "".join(e.itertext()) if e is not None else None
    for entry in ElementTree.fromstring(xml).iter("PubmedArticle"):
        c = entry.find("MedlineCitation")
        a = c.find("Article")
        date = a.find("Journal/JournalIssue/PubDate")
        yield json.dumps(
            {
                "MedlineCitation": {
                    "PMID": text(c.find("PMID")),
                    "Article": {
                        "ArticleTitle": text(a.find("ArticleTitle")),
                        "Language": [text(x) for x in a.findall("Language")],
                        "Abstract": {"AbstractText": [text(x) for x in a.findall("Abstract/AbstractText")]},
                        "AuthorList": [{k: text(x.find(k)) for k in ("LastName", "ForeName", "CollectiveName")} for x in a.findall("AuthorList/Author")],
                        "Journal": {"Title": text(a.find("Journal/Title")), "JournalIssue": {"PubDate": {k: text(date.find(k)) if date is not None else None for k in ("Year", "Month", "Day")}}},
                    },
                }
            }
        )


RAW_DDL = "topic string, topic_ord int, seq int, payload string"


def register(spark: SparkSession, transport: Transport = http) -> None:
    """Make the formats ``lamina_labels``, ``lamina_articles`` and ``lamina_article_ids`` known to the session.

    Options: ``topics`` (JSON list), ``limit``, ``api_key``, ``at_once``, ``delay``; for labels ``terms`` (JSON
    map), for articles ``email`` and ``ids`` (JSON map of topics to the ids to fetch, instead of a search).
    ``lamina_article_ids`` gives the ids of a search as payloads, in the provider's order.
    """

    def source(named: str, reads: type[_TopicReader]) -> type[DataSource]:
        class Source(DataSource):
            @classmethod
            def name(cls) -> str:
                return named

            def schema(self) -> str:
                return RAW_DDL

            def reader(self, schema) -> DataSourceReader:
                return reads(dict(self.options), transport)

        return Source

    for named, reads in (("lamina_labels", _LabelReader), ("lamina_articles", _ArticleReader), ("lamina_article_ids", _SearchReader)):
        spark.dataSource.register(source(named, reads))


def raw_labels(spark: SparkSession, topics: list[str], limit: int = K.RAW_LABELS_PER_TOPIC, **options: object) -> DataFrame:
    reader = spark.read.format("lamina_labels").option("topics", json.dumps(topics)).option("terms", json.dumps(K.SEARCH_TERMS)).option("limit", limit)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def raw_articles(spark: SparkSession, topics: list[str], email: str, limit: int = K.ARTICLES_PER_TOPIC, **options: object) -> DataFrame:
    reader = spark.read.format("lamina_articles").option("topics", json.dumps(topics)).option("email", email).option("limit", limit)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def found_articles(spark: SparkSession, topics: list[str], email: str, limit: int = K.ARTICLES_PER_TOPIC, **options: object) -> DataFrame:
    """``topic, pmid, rank``: the ids a search gives, in the provider's order."""
    reader = spark.read.format("lamina_article_ids").option("topics", json.dumps(topics)).option("email", email).option("limit", limit)
    return reader.options(**{k: str(v) for k, v in options.items()}).load().selectExpr("topic", "payload AS pmid", "seq AS rank")


ITEM_SEARCH = "https://iris.who.int/server/api/pid/find"
ITEM_BUNDLES = "https://iris.who.int/server/api/core/items/{}/bundles"


def resolved(handles: DataFrame, transport: Transport = http, handle: str = "handle", out: str = "url") -> DataFrame:
    """``handles`` with the content address of the first file of each item's ORIGINAL bundle.

    Three requests: the item, its bundles, the files of the bundle. An answer other than 200, or one
    without what is looked for, gives null, as a null handle does.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in handles.schema.fields)

    def ask(address: str, parameters: dict | None = None) -> str | None:
        status, body = transport(address, parameters or {})
        return body if status == 200 else None

    def item(h: str | None) -> str | None:
        said = ask(ITEM_SEARCH, {"id": f"hdl:{h}"}) if h is not None else None
        return ask(ITEM_BUNDLES.format(json.loads(said)["uuid"])) if said else None

    def step(df: DataFrame, column: str, request: Callable[[str | None], str | None]) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                yield batch.assign(_said=[request(x) for x in batch[column]]).drop(columns="_next", errors="ignore")

        return df.mapInPandas(run, f"{schema}, _said string")

    bundles = step(handles, handle, item)
    files = step(bundles.withColumn("_next", bundle_files_url(F.col("_said"))).drop("_said"), "_next", lambda u: ask(u) if u else None)
    return files.withColumn(out, first_file_url(F.col("_said"))).drop("_said")


def downloaded(addresses: DataFrame, transport: Callable[[str], tuple[int, bytes]], url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Files of distinct addresses, ``doc, data``, each fetched once, and the failures, ``doc, error``."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for address in batch["doc"]:
                try:
                    status, data = transport(address)
                    rows.append((address, bytes(data), None) if status == 200 else (address, None, f"status {status}"))
                except OSError as e:
                    rows.append((address, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "data", "error"])

    once = addresses.select(F.col(url).alias("doc")).filter("doc IS NOT NULL").distinct()
    got = cut_lineage(once.mapInPandas(run, "doc string, data binary, error string"))
    return got.filter("error IS NULL").drop("error"), got.filter("error IS NOT NULL").select("doc", "error")
