"""Pages of documents: cleaning, assembly, figure captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.text import FURNITURE, has_caption, strip, without_furniture


def clean_pages(pages: DataFrame, furniture: str = FURNITURE) -> DataFrame:
    """``clean`` and ``raw`` of each page without what ``furniture`` matches, and stripped; null becomes empty."""
    return pages.withColumns({c: without_furniture(F.coalesce(F.col(c), F.lit("")), furniture) for c in ("clean", "raw")})


def assemble(pages: DataFrame, doc: str = "doc", page: str = "page_number", text: str = "clean") -> DataFrame:
    """``doc, full_text, num_pages``: the texts of the pages in order, empty ones left out but counted."""
    kept = F.struct(F.col(page).alias("p"), F.col(text).alias("t"))
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", kept))), lambda x: x["t"]), "\n")
    return pages.groupBy(doc).agg(full.alias("full_text"), F.count(F.lit(1)).alias("num_pages"))


def figure_pages(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Pages whose raw text names a figure or algorithm."""
    return pages.filter(has_caption(strip(F.coalesce(F.col(raw), F.lit("")))))


def figures_without_image(captions: DataFrame, images: DataFrame, keys: tuple[str, str] = ("doc", "page_number")) -> DataFrame:
    """Caption pages that no kept image stands on."""
    return captions.join(images.select(*keys).distinct(), list(keys), "left_anti")
