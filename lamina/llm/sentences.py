"""Sentence boundaries across languages and scripts (problem 6).

Rules are pairs of expressions, for what stands before and after a position, and say break or no break.
Tables of rules are cascaded: those of the language, then those of its script family, then the common
ones. At each candidate position the first rule that matches decides. Positions inside a quotation are
candidates only at its end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.bloom import hashes_of
from lamina.llm.layout import BLANK, HEADING, TEXT, read_lines, running_of, with_running
from lamina.session import ship_package, spread

#: Separates paragraphs in the text that the rules see.
PARAGRAPH = " "
_PARAGRAPHS = re.compile(rf"{PARAGRAPH}|\n[^\S\n]*\n")


@dataclass(frozen=True)
class Rule:
    """Break or not where ``before`` matches up to the position and ``after`` from it on.

    ``tails`` are the endings of what ``before`` can match, which are looked at first; None is any. A
    ``before`` of None matches everywhere.
    """

    breaks: bool
    before: re.Pattern | None
    after: re.Pattern
    tails: tuple[str, ...] | None = None


def _rule(breaks: bool, before: str, after: str = "", tails: str | tuple[str, ...] = ()) -> Rule:
    return Rule(breaks, re.compile(rf"(?:{before})\Z") if before else None, re.compile(after), tuple(tails) or None)


def _short(words: str, after: str = "") -> Rule:
    """No break after one of the abbreviations, which are given without their point."""
    return _rule(False, rf"(?<![^\W\d_])(?:{'|'.join(re.escape(w) for w in words.split())})\.", after, tuple(w + "." for w in words.split()))


_OPEN = r"[\s“„«‹‘¿¡\"'(\[「『]*"
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĘĚŁŃÓŚŠŹŻŽА-ЯЁΑ-Ω"
_STARTS = rf"(?:{_OPEN}[{_UPPER}\d−–-]|{_OPEN}[a-zµ]{{1,3}}[A-Z])"

# fixed values: abbreviations by language
TABLES: dict[str, list[Rule]] = {
    "en": [
        _short("No Nos Vol Fig Figs Sect Eq Ref Refs Tab Chap Art p pp", r"\s+[\dIVXA-Z]"),
        _short("cf vs e.g i.e al Approx approx ca Dr Mr Mrs Ms Prof St resp incl viz"),
        _short("cm kg mg mL", r"\s+[a-z]"),
    ],
    "de": [
        _short("z B d h u a o s bzw vgl Abb Tab Nr ca Dr Prof evtl ggf inkl Kap Bd sog Str"),
        _short("usw etc", r"\s+[a-zäöü]"),
        _rule(False, r"(?<!\d)\d{1,2}\.", r"\s+(?:Tag|Tage|Woche|Monat|Jahr|Quartal|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Lebensjahr)", "."),
    ],
    "fr": [_short("p pp ex cf M MM Mme Mmes Dr Pr c.-à-d fig art vol env chap éd n")],
    "es": [_short("p pp ej pág págs Dr Dra Sr Sra Srta aprox fig núm art cap vol EE UU Ud Uds")],
    "pt": [_short("p pp ex pág págs Dr Dra Sr Sra aprox fig núm cap cf art vol")],
    "ru": [_short("см рис табл напр стр ул им т е д п др тыс млн проф ср"), _rule(False, r"(?<![^\W_])[А-ЯЁ]\.", r"\s+[А-ЯЁ]", ".")],
    "ar": [_short("ص د م أ"), _rule(False, r"[»”\"]", r"\s*ف", "»”\"")],
    "hi": [_short("डॉ प्रो श्री सं"), _rule(False, r"[”\"]", r"\s*(?:और|तो|कि|कहकर|यह)\b", "”\"")],
    "ja": [_rule(False, r"[」』]", r"\s*[とっていうにをがはもで]", "」』")],
    "zh": [_rule(False, r"[”」』]", r"\s*[是的，、这]", "”」』")],
    "th": [],
}
_LATIN = [
    _rule(False, r"(?<![^\W\d_])[A-Z]\.", r"\s*[A-Z]\.", "."),
    _rule(True, r"(?:[^\W\d_]{2}|[%)\d°])\.", rf"[{_UPPER}](?:[^\W\d_]|[\s'’])", "."),
    _rule(True, r"[!?][”»\"’)\]]*", rf"[{_UPPER}“„«¿¡]", "!?”»\"’)]"),
    _rule(False, r"\.", r"[^\s ]", "."),
]
FAMILIES: dict[str, list[Rule]] = {"latin": _LATIN, "spaceless": [_rule(False, r"\.", r"[^\s ]", ".")], "caseless": [_rule(False, r"\.", r"[^\s ]", ".")]}
COMMON = [
    _rule(True, "", rf"\s*(?:{PARAGRAPH}|\Z)"),
    _rule(True, r"[^\s…]…[”»’\"]*", rf"\s+{_OPEN}[{_UPPER}]", "…”»’\""),
    _rule(False, r"…[”»’\"』」）)\]]*", r"\s*[^\s]", "…”»’\"』」）)]"),
    _rule(False, "", r"\s*[—–,;:，、؛،]"),
    _rule(True, "", rf"\s*{_STARTS}"),
    _rule(False, "", r"\s*[“„«‹‘¿¡\"'(\[]*[a-zà-öø-ÿāăąćčďęěłńœśšźżžа-яё]"),
    _rule(True, "", ""),
]
FAMILY = {"zh": "spaceless", "ja": "spaceless", "th": "spaceless", "ar": "caseless", "hi": "caseless"}

#: Three-letter codes of languages with a table.
CODES = {"eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "por": "pt", "rus": "ru", "ara": "ar", "hin": "hi", "jpn": "ja", "chi": "zh", "zho": "zh", "tha": "th"}

#: fixed values: frequent words that tell languages of one script apart
_TELL = {
    "en": "the of and in to with was for were is", "de": "der die und nicht bei von mit wurde für nach das den dem ist ein eine zu", "fr": "les des une dans est la pour chez été du le et un aux sur par",
    "es": "los las una del con por fue según tras más la el y en un se es", "pt": "não em uma dos foi com após são ao por o os da do das na no se um",
}
_TELLS = {w: [k for k, v in _TELL.items() if w in v.split()] for v in _TELL.values() for w in v.split()}


_SCRIPTS = [(re.compile(f"[{signs}]"), language) for signs, language in (("぀-ヿ", "ja"), ("一-鿿", "zh"), ("\u0e00-\u0e7f", "th"), ("\u0900-\u097f", "hi"), ("\u0600-\u06ff", "ar"), ("Ѐ-ӿ", "ru"))]
_WORDS = re.compile(r"[^\W\d_]+")


_LATIN_ONLY = re.compile("[^\u0400-\u9fff]*\\Z")


def _signs(text: str) -> list[int]:
    """Signs of each script other than Latin in a text."""
    if _LATIN_ONLY.match(text):
        return [0] * len(_SCRIPTS)
    return [len(pattern.findall(text)) for pattern, _ in _SCRIPTS]


def _script(signs: list[int], length: int) -> str | None:
    """Language of the script other than Latin that a text is written in, if any."""
    return next((language for n, (_, language) in zip(signs, _SCRIPTS) if n > length / 12), None)


def _told(text: str) -> dict[str, int]:
    """Frequent words of each Latin-script language in a text."""
    told = dict.fromkeys(_TELL, 0)
    for w, n in Counter(_WORDS.findall(text.casefold())).items():
        for k in _TELLS.get(w, ()):
            told[k] += n
    return told


def _best(told: dict[str, int], whole: str | None = None) -> str:
    return max(told, key=lambda k: (told[k], k == whole, k == "en"))


def language_of(text: str, code: str | None = None) -> str:
    """Language of a text: that of ``code`` where it has a table, else told by script and frequent words of all of it."""
    known = CODES.get((code or "").casefold(), (code or "").casefold()[:2])
    if known in TABLES:
        return known
    return _script(_signs(text), len(text)) or _best(_told(text))


def languages_of(text: str) -> list[tuple[int, str]]:
    """Start and language of each paragraph of a text: that of the text unless the paragraph tells another.

    Another script tells one; another language of Latin script needs two of its frequent words and
    more than the language of the text has.
    """
    stops = [*[m.end() for m in _PARAGRAPHS.finditer(text)], len(text)]
    starts = [0, *stops[:-1]]
    signs = [_signs(text[a:b]) for a, b in zip(starts, stops)]
    told = [_told(text[a:b]) for a, b in zip(starts, stops)]
    whole = _script([sum(x) for x in zip(*signs)], len(text)) or _best({k: sum(t[k] for t in told) for k in _TELL})
    out = []
    for a, b, sign, words in zip(starts, stops, signs, told):
        language = _script(sign, b - a)
        if language is None:
            best = _best(words, whole)
            language = best if words[best] >= max(2, words.get(whole, 0) + 1) else whole
        elif language == "zh" and whole == "ja":
            language = whole
        out.append((a, language))
    return out


_END = re.compile(r"[.!?。！？؟।…]+(?:\n?[”’\"』」）)\]]|[   \n]?»|(?<=[.!?])“)*")
_THAI_END = re.compile(r"(?<=[฀-๿ๆ])(?=[  \n ]+[฀-๿])")
_CLOSED = re.compile(r"[.!?。！？؟।…][”’»\"'」』）)\]\s]*\Z")
_NOTHING = re.compile(r"\s*\Z")
_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
_MARKS = re.compile(rf"[“”„«»「」『』]|{PARAGRAPH}|\n[^\S\n]*\n")
#: Characters before an end mark that a rule can concern: more than the longest abbreviation has.
BEFORE = 24


def quotations(text: str) -> list[tuple[int, int]]:
    """Start and end (past the closing mark) of the outermost quotations, of any length.

    A quotation holds those within it and ends in its paragraph. A mark left open is a mistake and opens
    nothing, but where a text is cut off, without an end mark, its last paragraph's ends with the text.
    """
    out: list[tuple[int, int]] = []
    open_: list[tuple[str, int]] = []  # awaited closing mark, start
    done: list[tuple[int, int]] = []  # closed within what is open
    for m in _MARKS.finditer(text):
        mark = m[0]
        closes = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == mark), None)
        if closes is not None:
            start = open_[closes][1]
            del open_[closes:]
            done = [d for d in done if d[0] < start] + [(start, m.end())]
            if not open_:
                out += done
                done = []
        elif mark in _PAIRS:
            open_.append((_PAIRS[mark], m.start()))
        elif mark not in "”»」』":  # a paragraph's end
            out += done
            done, open_ = [], []
    if open_ and not _CLOSED.search(text, max(0, len(text.rstrip()) - 8)):
        start = open_[0][1]
        done = [d for d in done if d[0] < start] + [(start, len(text) + 1)]
    return out + done


def sentence_ends(text: str, language: str | None = None) -> list[int]:
    """Positions past the last character of each sentence of a text (one or more paragraphs).

    Without ``language`` each paragraph has the rules of its own. A last sentence without an end mark is not in the result.
    """
    languages = [(0, language)] if language else languages_of(text)
    parts = [p[0] for p in languages]
    cascades = {k: TABLES[k] + FAMILIES[FAMILY.get(k, "latin")] + COMMON for _, k in languages}
    quotes = quotations(text)
    starts = [q[0] for q in quotes]
    ends = []
    spoken = lambda at: languages[max(0, bisect_right(parts, at - 1) - 1)][1]
    candidates = {m.end(): m.start() for m in _END.finditer(text)}
    if "th" in cascades:
        candidates |= {m.start(): m.start() for m in _THAI_END.finditer(text) if spoken(m.start()) == "th"}
    for at, marks in sorted(candidates.items()):
        now = spoken(at)
        k = bisect_right(starts, at - 1) - 1
        if k >= 0 and at <= quotes[k][1]:
            if at < quotes[k][1]:
                continue  # inside a quotation
            if now in FAMILY:
                before = text[max(0, quotes[k][0] - 8) : quotes[k][0]].rstrip()[-1:]
                if before not in ("：", ":") and not _NOTHING.match(text, at):
                    continue  # the sentence around it goes on
        before = text[max(0, marks - BEFORE) : at]
        for rule in cascades[now]:
            if (rule.tails is None or before.endswith(rule.tails)) and (rule.before is None or rule.before.search(before)) and rule.after.match(text, at):
                if rule.breaks:
                    ends.append(at)
                break
    return ends


def abstract_ends(text: str, code: str | None = None) -> list[int]:
    """Sentence ends of a plain text; the last sentence may lack an end mark. Blank texts have none."""
    body = text.rstrip()
    if not body.strip():
        return []
    known = CODES.get((code or "").casefold(), (code or "").casefold()[:2])
    ends = [e for e in sentence_ends(body, known if known in TABLES else None) if e <= len(body)]
    return ends if ends and ends[-1] == len(body) else [*ends, len(body)]


def page_text_ends(text: str, title: str | None, running: frozenset[str]) -> list[int]:
    """Sentence ends of a text in pages and lines, in positions of that text.

    Headings, running lines and page numbers are passed over, also inside a sentence.
    """
    parts: list[str] = []
    joined: list[int] = []
    origin: list[int] = []
    at = size = 0
    for line in read_lines(text, title, running):
        if line.kind == TEXT:
            piece = line.text + "\n"
            joined.append(size)
            origin.append(at)
        else:
            piece = PARAGRAPH if line.kind in (BLANK, HEADING) else ""
        parts.append(piece)
        size += len(piece)
        at += len(line.text) + 1
    body = "".join(parts)
    if not body.strip(f"{PARAGRAPH} \n"):
        return []
    out = []
    for e in sentence_ends(body):
        k = bisect_right(joined, e - 1) - 1
        out.append(origin[k] + e - joined[k])
    return sorted(set(out))


def article_sentences(articles: DataFrame) -> DataFrame:
    """``item_field, item_key, end_pos`` for the abstract of each pmid, once. Null and blank abstracts have none.

    Abstracts are cut where they are read and only positions are shuffled. Of the rows of a pmid one
    that names its language counts first; should abstracts differ, the least of language and hash does.
    """
    ship_package(articles.sparkSession)
    told = F.when(F.col("language") != "und", F.col("language"))
    rows = articles.select("pmid", "abstract", told.alias("language")).filter(F.col("pmid").isNotNull() & F.col("abstract").isNotNull())

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [abstract_ends(text, code) for text, code in zip(batch["abstract"], batch["language"])]
            yield pd.DataFrame({"pmid": batch["pmid"], "order": [code or "~" for code in batch["language"]], "hash": hashes_of(batch["abstract"]), "ends": ends})

    cut = spread(rows).mapInPandas(split, "pmid string, order string, hash long, ends array<int>")
    once = cut.groupBy("pmid").agg(F.min_by("ends", F.struct("order", "hash")).alias("ends"))
    return once.select(F.lit("articles.abstract").alias("item_field"), F.col("pmid").alias("item_key"), F.explode("ends").alias("end_pos"))


def guideline_sentences(guidelines: DataFrame) -> DataFrame:
    """The same for ``clean_text`` of each guideline; its key is ``guideline_id`` as a string; rows without one are left out."""
    ship_package(guidelines.sparkSession)
    raw = ["raw_text"] if "raw_text" in guidelines.columns else []
    chosen, sent = with_running(guidelines.select("guideline_id", "title", "clean_text", *raw).filter("guideline_id IS NOT NULL"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [("guidelines.clean_text", str(key), e) for key, title, text, running in zip(batch["guideline_id"], batch["title"], batch["clean_text"], running_of(batch, sent)) if text for e in page_text_ends(text, title, running)]
            yield pd.DataFrame(rows, columns=["item_field", "item_key", "end_pos"])

    return spread(chosen.drop("raw_text")).mapInPandas(split, "item_field string, item_key string, end_pos int")


def corpus_sentences(articles: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Every end of a sentence in running text, once."""
    return article_sentences(articles).unionByName(guideline_sentences(guidelines)).distinct()
