"""Text functions as columns; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina import constants as K

#: White space as Python's ``strip`` knows it, for a character class of either engine.
SPACE = r" \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A token stand-in: letters, up to three digits, or signs.
TOKEN = rf"\p{{L}}+|\p{{N}}{{1,3}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: The same with the white space before it; joined, they give the text back.
LOSSLESS_TOKEN = rf"[{SPACE}]*(?:{TOKEN})|[{SPACE}]+$"
_ABBREVIATION = "|".join(re.escape(a) for a in K.ABBREVIATIONS if " " not in a)  # compared with one token, so none of two words


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def token_count(text: Column) -> Column:
    """Number of token stand-ins; null gives 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))), F.lit(0))


def lossless_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({LOSSLESS_TOKEN})"), F.lit(1))


@dataclass(frozen=True)
class Tokens:
    """A tokenizer as columns: the number of tokens of a text, and its tokens, which joined give it back."""

    count: Callable[[Column], Column]
    split: Callable[[Column], Column]


#: The stand-in, the same in Spark and SQL.
STAND_IN = Tokens(token_count, lossless_tokens)


def tokens_by(make: Callable[[], Callable[[str], list[str]]]) -> Tokens:
    """A tokenizer that ``make`` builds once in each worker: a function from a text to its tokens, spaces included.

    Null texts have no tokens.
    """
    held: list[Callable[[str], list[str]]] = []

    def cut(text: str | None) -> list[str]:
        if not held:
            held.append(make())
        return held[0](text) if text is not None else []

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(cut(t)) for t in texts], dtype="int32")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(t) for t in texts], dtype=object)

    return Tokens(count, split)


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences_plain(text: Column) -> Column:
    """Pieces between an end mark and a capital letter; not stripped, as the plain split leaves them."""
    return F.filter(F.split(text, rf"(?<=[.!?])[{SPACE}]+(?=[A-Z])"), lambda s: strip(s) != "")


def sentences(text: Column) -> Column:
    """Sentences by end mark, not after an abbreviation; stripped, none empty. Line breaks end nothing."""
    return _filled(F.split(text, rf"(?<=[.!?])(?<!(?<![A-Za-z0-9_])(?:{_ABBREVIATION})\.)[{SPACE}]+"))


def paragraphs(text: Column) -> Column:
    return _filled(F.split(text, rf"\n[{SPACE}]*\n"))


def point_id(chunk_id: Column) -> Column:
    """UUID version 5 of ``chunk_id`` in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(K.URL_NAMESPACE)), F.encode(chunk_id, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def canonical_id(topics: Column) -> Column:
    """Topics in code point order joined by ``+``; the list itself keeps its order."""
    return F.array_join(F.array_sort(topics), "+")


def file_name(topic: Column) -> Column:
    return F.replace(topic, F.lit(" "), F.lit("_"))


def brand_key(brand: Column) -> Column:
    return F.lower(strip(brand))


#: Lines begin where the expression for a whole line does, so that it is tried once a line.
FURNITURE = "(?dm)" + K.HEADER_FOOTER.replace("(.*", "(^.*", 1)


def without_furniture(text: Column, furniture: str = FURNITURE) -> Column:
    """``text`` without what ``furniture`` matches: lines of the organisation and every "N of M", also in prose; stripped."""
    return strip(F.regexp_replace(text, furniture, ""))


def has_caption(text: Column) -> Column:
    return text.rlike("(?i)" + K.FIGURE_CAPTION)


def says_phrase(text: Column, phrase: str) -> Column:
    """Whether ``text`` holds the words of ``phrase`` side by side, in any case."""
    words = rf"[^\p{{L}}\p{{N}}]+".join(re.escape(w) for w in phrase.lower().split())
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}]){words}(?![\p{{L}}\p{{N}}])")


def says_any(text: Column, phrase: str) -> Column:
    """Whether ``text`` holds any word of ``phrase``."""
    words = "|".join(re.escape(w) for w in phrase.lower().split())
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")


def table_text(cells: Column) -> Column:
    """Rows of cells joined by a bar, null as empty, on lines of their own."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, " | ", "")), "\n", "")
