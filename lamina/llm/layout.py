"""Lines of page-based text: running headers and footers, page numbers, headings, tables, running text.

Lines are judged by their form, by their document (title, repetition, numbering) and by a table of
running lines of the whole corpus: lines that recur in many documents while the text around them goes on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import cut_lineage

BLANK, HEADER, PAGE, HEADING, TEXT, TABLE = "blank", "header", "page", "heading", "text", "table"

#: A line is a running line of the corpus if so many documents hold it, whatever their number in all,
RUNNING_DOCUMENTS = 3
#: and if the text does not simply go on with it in this part of its occurrences.
RUNNING_LOOSE = 0.3
#: Running lines that are sent to all workers at most, some megabytes; more are joined by document.
RUNNING_SENT = 20_000

_FOLD = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ги", "ш"), ("fi", "n"), ("fl", "n")]
_FOLD_CHARS = str.maketrans("0156843czqlitäöüãàáâéèêнпиаÄ", "oisbbaaeeqiiiaouaaaaeeeпппaa")

_N = r"[0-9lIOoSBZ]{1,4}"
_PAGE = re.compile(
    rf"^\s*(?P<pre>[-–—|\[(<•·*\s]*(?:(?:page|pag|pág|página|pg|p|seite|s|стр|с|страница|صفحة|ص|第)\b\.?\s*|第\s*)?)(?P<n>{_N}|[ivxlcIVXLC]{{1,7}})"
    rf"(?P<post>(?:\s*(?:/|of|de|sur|von|из|من|共|over)\s*(?P<of>{_N}))?\s*页?[-–—|\])>•·*\s]*)$",
    re.IGNORECASE,
)
_NUMBERED = re.compile(rf"^(?:(?:page |p\. ?)?(?P<a>{_N}|[ivxlc]{{1,6}})(?:\s{{2,}}|\s*\|\s*))?(?P<body>.*?\S)(?:(?:\s{{2,}}|\s*\|\s*)(?:page |p\. ?)?(?P<b>{_N}|[ivxlc]{{1,6}}))?\s*$", re.IGNORECASE)
_HEADING = re.compile(r"^\d{1,2}(?:\.\d{1,2}){0,3}\.? (?=\S)(?!\d)")
_FINAL = re.compile(r"[.!?…。！？؟।:;,،，、；：]['”’»\")\]』」）]*\s*$")
_ENDED = re.compile(r"[.!?…。！？؟।](?:\s?['”’»\")\]』」）])*\s*$")
_SEP = re.compile(r"\s+")
_DIVIDED = re.compile(r"[^\W\d_][-‐¬\u00ad]\s*$")


@lru_cache(maxsize=1 << 15)
def folded(line: str) -> str:
    """``line`` in one case, with glyphs that are misread for each other made the same."""
    s = _SEP.sub(" ", line.casefold()).strip(" .-–—|").replace("|", "i")
    for a, b in _FOLD:
        s = s.replace(a, b)
    return s.translate(_FOLD_CHARS)


@lru_cache(maxsize=8)
def _by_edge(running: frozenset[str]) -> dict[tuple[int, str, bool], list[str]]:
    """The running lines by length and first or last four characters; nearly equal lines share one of the two."""
    out: dict[tuple[int, str, bool], list[str]] = {}
    for key in running:
        out.setdefault((len(key), key[:4], True), []).append(key)
        out.setdefault((len(key), key[-4:], False), []).append(key)
    return out


@lru_cache(maxsize=1 << 15)
def nearly_running(key: str, running: frozenset[str]) -> bool:
    """Whether ``key`` is one of the running lines but for one place of up to three characters."""
    if len(key) < 10:
        return False
    known = _by_edge(running)
    for n in range(len(key) - 2, len(key) + 3):
        for other in (*known.get((n, key[:4], True), ()), *known.get((n, key[-4:], False), ())):
            short = min(n, len(key))
            a = 0
            while a < short and key[a] == other[a]:
                a += 1
            b = 0
            while b < short - a and key[-1 - b] == other[-1 - b]:
                b += 1
            if a + b >= max(n, len(key)) - 3:
                return True
    return False


def bare(line: str) -> tuple[str, bool]:
    """``line`` without a page number or year set apart at either end, and whether there was one."""
    m = _NUMBERED.match(line) if "|" in line or "  " in line else None
    if not m:
        return line.strip(), False
    return m["body"].strip(), m["a"] is not None or m["b"] is not None


def page_form(line: str) -> tuple[str, int | None] | None:
    """Form and number of a line that holds a page number only; the number is None where it is roman."""
    m = _PAGE.match(line)
    if not m:
        return None
    n = m["n"]
    digits = n.translate(str.maketrans("lIOoSBZ", "1100582"))
    roman = not any(c.isdigit() for c in n) and re.fullmatch("[ivxlcIVXLC]+", n)
    if not roman and not any(c.isdigit() for c in n) and not (m["of"] or m["pre"].strip()):
        return None
    form = f"{_SEP.sub(' ', m['pre'].casefold()).strip()}{'r' if roman else 'N'}{'/' if m['of'] else ''}{re.sub(r'[0-9lIOoSBZ]+', 'N', m['post']).strip().casefold()}"
    return form, int(digits) if not roman and digits.isdigit() else None


def starts_loose(line: str) -> bool:
    """Whether a line begins as a sentence, heading or number does, not as a continued one."""
    s = line.lstrip("“„«‹\"'(¿¡‘ ")
    return not s or not s[0].islower()


def _wordy(body: str) -> bool:
    return sum(c.isalpha() for c in body) >= 4 and not _FINAL.search(body) and len(body) <= 90 and not _HEADING.match(body)


@dataclass
class Line:
    text: str
    kind: str


@lru_cache(maxsize=1 << 15)
def _titled(key: str, named: str) -> bool:
    """Whether a line is the title but for a few characters; most lines differ in their signs already."""
    if key == named:
        return True
    if abs(len(key) - len(named)) > 4 or len(set(key) ^ set(named)) > 0.4 * len(named):
        return False
    both = SequenceMatcher(None, named, key, False)
    return both.quick_ratio() >= 0.9 and both.ratio() >= 0.9


def read_lines(text: str | None, title: str | None, running: frozenset[str], tables: bool = False, given: dict[int, str] | None = None) -> list[Line]:
    """The lines of a text with their kinds; those of the lines in ``given`` are known.

    With ``tables`` lines may be rows of tables, so that a bare number is a page number only where it
    goes on with the numbers before it.
    """
    if not text:
        return []
    raw = text.split("\n")
    kinds = [TEXT] * len(raw)
    named = folded(title) if title else None
    forms: list[tuple[str, int | None] | None] = []
    repeated = Counter(folded(bare(x)[0]) for x in raw if x.strip())
    lengths = sorted(len(x) for x in raw if x.strip())
    usual = 0.6 * lengths[len(lengths) * 3 // 4] if lengths else 0  # of full lines
    given = given or {}
    for i, x in enumerate(raw):
        if i in given:
            kinds[i] = given[i]
            forms.append(page_form(x) if given[i] == PAGE else None)
            continue
        forms.append(page_form(x) if x.strip() else None)
        if not x.strip():
            kinds[i] = BLANK
            continue
        if forms[i] and forms[i][0] not in ("N", "r"):
            continue
        body, numbered = bare(x)
        key = folded(body)
        if (named and len(key) > 3 and _titled(key, named)) or (
            (key in running or starts_loose(body) and nearly_running(key, running)) and not _FINAL.search(body) and (numbered or _wordy(body))
        ):
            kinds[i] = HEADER
        elif repeated[key] >= 2 and _wordy(body) and body.lower() == body.upper() and len(x) <= usual and starts_loose(body):
            kinds[i] = HEADER
        elif numbered and _wordy(body) and repeated[key] >= 2 and (re.match(rf"^{_N}\s{{2,}}|.*\s{{2,}}{_N}\s*$|.*\|", x)):
            kinds[i] = HEADER
    _mark_pages(raw, kinds, forms, tables)
    for i, x in enumerate(raw):
        if kinds[i] == TEXT and i not in given and _is_heading(raw, kinds, i):
            kinds[i] = HEADING
    return [Line(x, k) for x, k in zip(raw, kinds)]


def _mark_pages(raw: list[str], kinds: list[str], forms: list, tables: bool) -> None:
    if tables:  # a dash is an empty cell
        for i, f in enumerate(forms):
            if f and ("–" in f[0] or "—" in f[0]):
                forms[i] = None
    told = Counter(f[0] for f, k in zip(forms, kinds) if f and k in (TEXT, PAGE) and f[0] not in ("N", "r"))
    main = told.most_common(1)[0][0] if told else None
    bare_lines = [(i, f[1]) for i, (f, k) in enumerate(zip(forms, kinds)) if f and k in (TEXT, PAGE) and f[0] == "N"]
    chain: set[int] = set()
    if main is None and bare_lines:
        chain = _consecutive(bare_lines, tables)
    near = lambda i: any(0 <= j < len(raw) and kinds[j] == HEADER for j in (i - 1, i + 1))
    for i, f in enumerate(forms):
        if not f or kinds[i] != TEXT:
            continue
        form = f[0]
        if form == "N":
            if i in chain:
                kinds[i] = PAGE
        elif form == "r":
            if near(i) or not tables:
                kinds[i] = PAGE
        elif form == main or near(i) or not tables:
            kinds[i] = PAGE


def _consecutive(numbers: list[tuple[int, int | None]], tables: bool) -> set[int]:
    """Lines of the longest run of numbers that go up by one, gaps of up to two allowed for; all without tables."""
    known = [(i, n) for i, n in numbers if n is not None]
    if not tables:
        return {i for i, _ in numbers}
    best: dict[int, tuple[int, int | None]] = {}
    chains: list[list[int]] = []
    length: list[int] = []
    back: list[int] = []
    last: dict[int, int] = {}
    for k, (_, n) in enumerate(known):
        p = last.get(n - 1, last.get(n - 2, -1))
        back.append(p)
        length.append(1 + (length[p] if p >= 0 else 0))
        if n not in last or length[last[n]] <= length[k]:
            last[n] = k
    if not length:
        return set()
    k = max(range(len(known)), key=lambda j: (length[j], -known[j][1]))
    out = set()
    while k >= 0:
        out.add(known[k][0])
        k = back[k]
    return out if len(out) >= 2 else set()


def _is_heading(raw: list[str], kinds: list[str], i: int) -> bool:
    x = raw[i].strip()
    if len(x) > 110 or _FINAL.search(x) and not x.endswith(":"):
        return False
    before = next((j for j in range(i - 1, -1, -1) if kinds[j] not in (HEADER, PAGE)), None)
    ended = before is None or kinds[before] in (BLANK, HEADING) or bool(_ENDED.search(raw[before]))
    if _HEADING.match(x):
        rest = _HEADING.sub("", x)
        apart = i > 0 and kinds[i - 1] in (HEADER, PAGE)  # at a page's top it may stand inside a sentence
        return (ended or apart) and starts_loose(rest) and any(c.isalpha() for c in rest)
    after = next((j for j in range(i + 1, len(raw)) if kinds[j] not in (HEADER, PAGE)), None)
    alone = (before is None or kinds[before] == BLANK) and (after is None or kinds[after] == BLANK)
    return alone and ended and starts_loose(x) and len(x) <= 60 and after is not None


def mark_tables(lines: list[Line], known: Collection[int] = ()) -> None:
    """Make table rows of the text lines that neither end a sentence nor run on to the next one.

    A line runs on if it ends in a divided word, or if it is full and the next text line is none of a
    table. ``known`` lines keep their kind.
    """
    texts = [i for i, x in enumerate(lines) if x.kind == TEXT]
    if not texts:
        return
    divided = sorted(len(lines[i].text) for i in texts if _DIVIDED.search(lines[i].text))
    lengths = sorted(len(lines[i].text) for i in texts)
    width = divided[len(divided) // 2] if len(divided) >= 3 else lengths[len(lengths) * 9 // 10]
    after: int | None = None
    for i in reversed(texts):
        x = lines[i].text.rstrip()
        if i not in known and not _ENDED.search(x) and not _DIVIDED.search(x):
            goes_on = after is not None and lines[after].kind == TEXT and all(lines[j].kind in (HEADER, PAGE) for j in range(i + 1, after))
            if not goes_on or len(x) + 1 + len(lines[after].text.split()[0]) <= width - 2 or len(x) > width + 8:
                lines[i].kind = TABLE
        after = i


def matches(clean: list[str], raw: list[str]) -> dict[int, int]:
    """Raw line of each clean line, where the clean lines are the raw ones with some left out."""
    out, j = {}, 0
    for i, x in enumerate(clean):
        k = j
        while k < len(raw) and raw[k] != x:
            k += 1
        if k < len(raw):
            out[i], j = k, k + 1
    return out


def running_table(guidelines: DataFrame) -> DataFrame:
    """``line``: folded forms of the lines that run through many documents.

    A form needs a fixed number of documents, so that a header is found whatever else the corpus holds.
    Lines the raw text has beyond the clean one may be rows of tables and count beside a page number only.
    """
    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for clean, raw in zip(batch["clean_text"], batch["raw_text"]):
                seen: dict[str, list[int]] = {}
                clean_lines, raw_lines = (clean or "").split("\n"), (raw or "").split("\n")
                known = set(matches(clean_lines, raw_lines).values())
                for lines, tables in ((clean_lines, False), (raw_lines, True)):
                    full = [i for i, x in enumerate(lines) if x.strip()]
                    for at, i in enumerate(full):
                        if tables and i in known:
                            continue
                        body, numbered = bare(lines[i])
                        if page_form(lines[i]) or not _wordy(body) or not starts_loose(body):
                            continue
                        below = full[at + 1] if at + 1 < len(full) else None
                        near = [f for j in (i - 1, i + 1) if 0 <= j < len(lines) and (f := page_form(lines[j]))]
                        paged = any(f[0] not in ("N", "r") for f in near) if tables else bool(near)
                        if tables and not paged:
                            continue
                        gap = below is None or below > i + 1
                        cased = body[:1].isupper()
                        loose = numbered or paged or gap or (cased and lines[below].strip()[:1].isupper())
                        count = seen.setdefault(folded(body), [0, 0, 0])
                        count[0] += 1
                        count[1] += loose
                        count[2] += numbered or paged
                rows += [(k, *v) for k, v in seen.items()]
            yield pd.DataFrame(rows, columns=["line", "n", "loose", "paged"])

    raw = "raw_text" if "raw_text" in guidelines.columns else "CAST(NULL AS string) AS raw_text"
    found = guidelines.selectExpr("clean_text", raw).mapInPandas(candidates, "line string, n long, loose long, paged long").groupBy("line")
    sums = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum("loose").alias("loose"), F.sum("paged").alias("paged"))
    return sums.filter((F.col("docs") >= RUNNING_DOCUMENTS) & (F.col("loose") >= RUNNING_LOOSE * F.col("n")) & (F.col("n") >= 1.3 * F.col("docs"))).select("line")


def with_running(guidelines: DataFrame) -> tuple[DataFrame, frozenset[str] | None]:
    """The documents and the running lines of the corpus, for :func:`running_of`.

    Up to ``RUNNING_SENT`` lines are sent to all workers. More are joined: each document then has, in the
    column ``running``, those that a line of its own equals or nearly equals, which decides the same.
    """
    table = cut_lineage(running_table(guidelines))
    if table.count() <= RUNNING_SENT:
        return guidelines, frozenset(r["line"] for r in table.collect())
    return guidelines.join(_running_by_document(guidelines, table), "guideline_id", "left"), None


def running_of(batch: pd.DataFrame, sent: frozenset[str] | None) -> Iterable[frozenset[str]]:
    """The running lines that concern each document of a batch."""
    return repeat(sent, len(batch)) if sent is not None else (frozenset(x) if x is not None else frozenset() for x in batch["running"])


def _running_by_document(guidelines: DataFrame, table: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, clean, raw in zip(batch["guideline_id"], batch["clean_text"], batch["raw_text"]):
                said = {bare(x) for text in (clean, raw) for x in (text or "").split("\n") if x.strip()}
                rows += [(doc, key) for key in {folded(body) for body, numbered in said if not _FINAL.search(body) and (numbered or _wordy(body))}]
            yield pd.DataFrame(rows, columns=["guideline_id", "key"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [k == x or nearly_running(k, frozenset((x,))) for k, x in zip(batch["key"], batch["line"])]
            yield batch.loc[keep, ["guideline_id", "line"]]

    edges = lambda c, n: F.array(F.concat_ws("|", F.lit("a"), n, F.substring(c, 1, 4)), F.concat_ws("|", F.lit("b"), n, F.expr(f"right({c}, 4)")))
    raw = "raw_text" if "raw_text" in guidelines.columns else "CAST(NULL AS string) AS raw_text"
    held = guidelines.filter("guideline_id IS NOT NULL").selectExpr("guideline_id", "clean_text", raw).mapInPandas(keys, "guideline_id long, key string")
    wide = held.withColumn("by", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("edge", F.explode(edges("key", F.length("key") + F.col("by"))))
    listed = table.withColumn("edge", F.explode(edges("line", F.length("line"))))
    pairs = wide.join(listed, "edge").select("guideline_id", "key", "line").distinct()
    return pairs.mapInPandas(near, "guideline_id long, line string").groupBy("guideline_id").agg(F.collect_set("line").alias("running"))
