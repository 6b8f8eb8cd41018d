"""Binary documents: pages, tables and images through an extractor, one document a row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGE_DDL = "doc string, page_number int, clean string, raw string, tables array<array<array<string>>>"
IMAGE_DDL = "doc string, page_number int, image_index int, data binary, width int, height int, image_type string"


@dataclass
class Page:
    clean: str
    raw: str
    tables: list = field(default_factory=list)


@dataclass
class Image:
    page_number: int
    image_index: int
    data: bytes
    width: int
    height: int


class Extractor(Protocol):
    """Opens the bytes of a document."""

    def pages(self, data: bytes) -> list[Page]: ...
    def images(self, data: bytes) -> list[Image]: ...
    def raster(self, data: bytes, pages: list[int], dpi: int) -> list[Image]: ...


class PlainText:
    """Extractor of plain text with form feeds between pages; it has no tables and no images."""

    def pages(self, data: bytes) -> list[Page]:
        return [Page(p, p) for p in data.decode("utf-8", "replace").split("\f")]

    def images(self, data: bytes) -> list[Image]:
        return []

    def raster(self, data: bytes, pages: list[int], dpi: int) -> list[Image]:
        return []


class Pdf:
    """Extractor of PDF files; its libraries are optional and asked for where it is used."""

    def pages(self, data: bytes) -> list[Page]:
        import io

        import pdfplumber

        out = []
        with pdfplumber.open(io.BytesIO(data)) as pdf:
            for page in pdf.pages:
                found = page.find_tables()
                x0, top, x1, bottom = page.bbox
                rest = page
                for t in found:
                    a, b, c, d = t.bbox
                    rest = rest.outside_bbox((max(a, x0), max(b, top), min(c, x1), min(d, bottom)))
                out.append(Page(rest.extract_text() or "", page.extract_text() or "", [t.extract() for t in found]))
        return out

    def images(self, data: bytes) -> list[Image]:
        import fitz

        out = []
        with fitz.open(stream=data, filetype="pdf") as pdf:
            for number, page in enumerate(pdf):
                for index, entry in enumerate(page.get_images(full=True)):
                    image = pdf.extract_image(entry[0])
                    out.append(Image(number, index, image["image"], image["width"], image["height"]))
        return out

    def raster(self, data: bytes, pages: list[int], dpi: int) -> list[Image]:
        import fitz

        out = []
        with fitz.open(stream=data, filetype="pdf") as pdf:
            for number in pages:
                if 0 <= number < len(pdf):
                    image = pdf[number].get_pixmap(dpi=dpi)
                    out.append(Image(number, 0, image.tobytes("png"), image.width, image.height))
        return out


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc`` (path) and ``data`` of the files of a folder."""
    return spark.read.format("binaryFile").load(path).selectExpr("path AS doc", "content AS data")


def _opened(extractor: Extractor, data: bytes | None) -> tuple[list[Page], str | None]:
    try:
        return extractor.pages(bytes(data)), None
    except Exception as e:
        return [], f"{type(e).__name__}: {e}"


def broken_documents(documents: DataFrame, extractor: Extractor) -> DataFrame:
    """``doc, error`` of the documents that cannot be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [(doc, _opened(extractor, data)[1]) for doc, data in zip(batch["doc"], batch["data"])]
            yield pd.DataFrame([x for x in told if x[1]], columns=["doc", "error"])

    return documents.select("doc", "data").mapInPandas(run, "doc string, error string")


def extract_pages(documents: DataFrame, extractor: Extractor) -> DataFrame:
    """Pages of documents (doc, data), numbered from 0. A document that cannot be opened has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc"], batch["data"]):
                rows = [(doc, i, p.clean, p.raw, p.tables) for i, p in enumerate(_opened(extractor, data)[0])]
                yield pd.DataFrame(rows, columns=["doc", "page_number", "clean", "raw", "tables"])

    return documents.select("doc", "data").mapInPandas(run, PAGE_DDL)


def extract_images(documents: DataFrame, extractor: Extractor) -> DataFrame:
    """Embedded images of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc"], batch["data"]):
                rows = [(doc, x.page_number, x.image_index, x.data, x.width, x.height, "embedded") for x in extractor.images(bytes(data))]
                yield pd.DataFrame(rows, columns=["doc", "page_number", "image_index", "data", "width", "height", "image_type"])

    return documents.select("doc", "data").mapInPandas(run, IMAGE_DDL)


def raster_pages(documents: DataFrame, wanted: DataFrame, extractor: Extractor, dpi: int = 150) -> DataFrame:
    """Pages ``wanted`` (doc, page_number) as images; numbers out of range are passed over."""
    from pyspark.sql import functions as F

    asked = wanted.groupBy("doc").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data, pages in zip(batch["doc"], batch["data"], batch["pages"]):
                rows = [(doc, x.page_number, x.image_index, x.data, x.width, x.height, "rasterized_page") for x in extractor.raster(bytes(data), [int(p) for p in pages], dpi)]
                yield pd.DataFrame(rows, columns=["doc", "page_number", "image_index", "data", "width", "height", "image_type"])

    return documents.select("doc", "data").join(asked, "doc").mapInPandas(run, IMAGE_DDL)
