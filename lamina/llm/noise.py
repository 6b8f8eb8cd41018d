"""Noise in the text of scanned pages (problem 4).

Words are counted over the whole corpus and skip-gram vectors are learned from it. A rare word is linked
to frequent ones by plausible glyph edits (rn for m, l for i, 5 for s ...). Every occurrence of a linked
word is judged by itself: the vectors say how well each printed form stands among the words around it,
the best one is taken, and a word that looks real stays where none of them fits. Line-end marks are
joined or kept by what the corpus writes. Running lines and page numbers go, the rest is reflowed.
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.bloom import filter_bits, hashes_of, holds, merged_filter
from lamina.llm.frames import frame_of
from lamina.llm.layout import BLANK, HEADER, HEADING, PAGE, TABLE, TEXT, Line, mark_tables, matches, read_lines, running_of, with_running
from lamina.llm.skipgram import AT_ONCE, CHANCE, Pairs, by_word, model_words, train
from lamina.operators.skew import join_groups
from lamina.session import cut_lineage, ship_package, spread

log = logging.getLogger(__name__)

#: What a scanner makes of what was printed: (misread, printed).
GLYPHS = [
    ("c", "e"), ("e", "c"), ("ä", "a"), ("l", "t"), ("ri", "n"), ("l", "i"), ("i", "l"), ("5", "s"), ("0", "o"), ("1", "l"), ("1", "i"),
    ("rn", "m"), ("m", "rn"), ("ii", "u"), ("ii", "n"), ("ii", "ñ"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("q", "g"), ("vv", "w"), ("6", "b"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("8", "b"), ("9", "g"), ("4", "a"), ("3", "e"), ("2", "z"), ("|", "l"), ("|", "i"), ("f", "t"), ("t", "f"),
    ("u", "n"), ("n", "u"), ("h", "b"), ("b", "h"), ("o", "c"), ("o", "e"), ("ö", "o"), ("ü", "u"), ("h", "li"), ("n", "ri"), ("w", "vv"), ("nn", "m"), ("tn", "m"), ("in", "m"), ("t", "l"),
    ("п", "н"), ("н", "п"), ("н", "и"), ("и", "н"), ("4", "а"), ("0", "о"), ("3", "з"), ("ги", "ш"), ("6", "б"), ("6", "é"), ("6", "ó"), ("е", "с"), ("с", "е"), ("ц", "п"), ("м", "и"), ("о", "с"), ("л", "п"), ("ш", "щ"), ("щ", "ш"), ("ьi", "ы"), ("т", "г"), ("г", "т"),
]
#: A link needs a printed word so many times as frequent as the misread one; a digit, ligature or bar
#: within a word needs no more than that the printed word is as frequent.
RATIO = 1.5
#: Least evidence for a misreading of a word that looks real: the logarithm of the ratio plus the fit, half
#: that of this occurrence and half that of all of the link. A fit of 0 is chance: frequencies alone must
#: then be eight to one.
EVIDENCE = math.log(8)

WORD = re.compile(r"[^\W_]+(?:[|][^\W_]+)*(?:[-'’‐][^\W_]+(?:[|][^\W_]+)*)*")
PARTS = re.compile(r"[-‐]")
_MARK = re.compile(r"([-‐¬­])\s*$")
_TAIL = re.compile(r"([^\W_](?:[^\s(“„«\[/]*[^\W_])?)[-‐¬­]\s*$")
_HEAD = re.compile(r"\s*([^\W_]+(?:[-'’‐][^\W_]+)*)")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿฀-๿]")  # what stands between two signs of such a script is no word
_ODD = re.compile(r"[ﬀﬁﬂﬃﬄ|]")


@lru_cache(maxsize=1 << 14)
def printed_forms(word: str) -> tuple[str, ...]:
    """Words that ``word`` may be a misreading of, by one or two glyph edits of one kind, or of two kinds."""
    once: set[str] = set()
    for misread, printed in GLYPHS:
        start = word.find(misread)
        if start < 0:
            continue
        if word.count(misread) > 1:
            once.add(word.replace(misread, printed))
        while start >= 0:
            once.add(word[:start] + printed + word[start + len(misread) :])
            start = word.find(misread, start + 1)
    twice: set[str] = set()
    if odd(word):  # the plain sign of a misread word leaves room for a second edit
        for w in once:
            for misread, printed in GLYPHS:
                start = w.find(misread)
                while start >= 0:
                    twice.add(w[:start] + printed + w[start + len(misread) :])
                    start = w.find(misread, start + 1)
    return tuple((once | twice) - {word})


def odd(word: str) -> bool:
    """Whether a word holds signs no printed word has: a ligature, a bar, a digit between small letters."""
    return bool(_ODD.search(word)) or _digit_within(word)


def _digit_within(word: str) -> bool:
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    return 1 <= digits <= max(1, letters // 3) and letters >= 2


def text_lines(lines: list[Line]) -> list[int]:
    return [i for i, line in enumerate(lines) if line.kind == TEXT]


def line_end(lines: list[Line], texts: list[int], at: int) -> tuple[str, str, str] | None:
    """Of the text line ``texts[at]`` that ends in a dividing mark: the mark, the word before and the word after."""
    line = lines[texts[at]].text
    m = _MARK.search(line)
    if not m or at + 1 >= len(texts):
        return None
    a, b = _TAIL.search(line), _HEAD.match(lines[texts[at + 1]].text)
    if not a or not b:
        return None
    return m[1], a[1], b[1]


def _words(line: str) -> list[str]:
    return WORD.findall(line)


def running_words(lines: list[Line]) -> list[tuple[int, str]]:
    """Words of the running text with their lines, without those parted at a line end."""
    texts = text_lines(lines)
    out: list[tuple[int, str]] = []
    cut = False
    for k, i in enumerate(texts):
        words = _words(lines[i].text)
        if cut and words:
            words = words[1:]
        cut = line_end(lines, texts, k) is not None
        if cut and words:
            words = words[:-1]
        out += [(i, w) for w in words]
    return out


@lru_cache(maxsize=1 << 16)
def _spelt(word: str) -> tuple[str, ...]:
    """A word in lower case, and its parts where it is a compound."""
    w = word.casefold() if not _ODD.search(word) else word.lower()  # which would take a ligature apart
    parts = PARTS.split(w)
    return (w,) if len(parts) == 1 else (w, *[p for p in parts if p])


KINDS = (BLANK, HEADER, PAGE, HEADING, TEXT, TABLE)
_DIGIT = {k: str(i) for i, k in enumerate(KINDS)}


def read_fields(clean: str | None, raw: str | None, title: str | None, running: frozenset[str]) -> tuple[list[Line], list[Line], dict[int, int]]:
    """Lines of both texts, and of which clean line a raw line is one and the same; those are of the same kind."""
    lines = read_lines(clean, title, running)
    known = {k: i for i, k in matches([x.text for x in lines], raw.split("\n")).items()} if raw else {}
    full = read_lines(raw, title, running, tables=True, given={k: lines[i].kind for k, i in known.items()})
    mark_tables(full, known)
    return lines, full, known


PAGES = "tag string, guideline_id long, clean_text string, raw_text string, clean_kinds string, raw_kinds string, known string, shared string, item_field string, line_no int, a string, b string, c string, d string, e string, n long"
_COLUMNS = [x.split(" ")[0] for x in PAGES.split(", ")]


def read_pages(guidelines: DataFrame) -> DataFrame:
    """All that one layout of the documents gives, in tagged rows.

    ``doc``: a document with the kinds of its lines (a digit each), by ``known`` the raw lines that the
    clean text has and by ``shared`` the clean lines that the raw one has, in the same order.
    ``word``: a word of the running text (a) with its number (n), compounds also by part; what both
    texts of a document have is counted once.
    ``line``: a running line or page number and its kind (a). ``end``: a line that ends in a dividing
    mark: the word joined (a), hyphened (b), its parts at the seam joined (c), left (d), right (e), and
    whether the mark is no hyphen (n).
    """
    chosen, sent = with_running(guidelines.select("guideline_id", "title", "clean_text", "raw_text").filter("guideline_id IS NOT NULL"))
    digits = lambda lines: "".join([_DIGIT[x.kind] for x in lines])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        found: Counter[str] = Counter()

        def words() -> pd.DataFrame:
            total: Counter[str] = Counter()
            for w, n in found.items():
                for s in _spelt(w):
                    total[s] += n
            found.clear()
            return pd.DataFrame({c: {"tag": "word", "a": list(total), "n": list(total.values())}.get(c) for c in _COLUMNS}, index=range(len(total)), dtype=object)

        for batch in batches:
            rows: list[dict] = []
            for key, title, clean, raw, running in zip(batch["guideline_id"], batch["title"], batch["clean_text"], batch["raw_text"], running_of(batch, sent)):
                lines, full, known = read_fields(clean, raw, title, running)
                flags = lambda held, of: "".join(["1" if k in held else "0" for k in range(len(of))])
                shared = set(known.values())
                rows.append({"tag": "doc", "guideline_id": key, "clean_text": clean, "raw_text": raw, "clean_kinds": digits(lines), "raw_kinds": digits(full), "known": flags(known, full), "shared": flags(shared, lines)})
                for field, now, counted in (("raw_text", full, ()), ("clean_text", lines, shared)):
                    if len(counted) < len(now):
                        found.update([w for i, w in running_words(now) if i not in counted])
                    rows += [{"tag": "line", "guideline_id": key, "item_field": field, "line_no": i, "a": x.kind} for i, x in enumerate(now) if x.kind in (HEADER, PAGE)]
                    texts = text_lines(now)
                    for k, i in enumerate(texts):
                        end = line_end(now, texts, k)
                        if end:
                            mark, left, right = end
                            l, r = PARTS.split(left)[-1].casefold(), PARTS.split(right)[0].casefold()
                            rows.append({"tag": "end", "guideline_id": key, "item_field": field, "line_no": i, "a": (left + right).casefold(), "b": f"{left}-{right}".casefold(), "c": l + r, "d": l, "e": r, "n": int(mark in "¬\u00ad")})
            yield frame_of(rows, _COLUMNS)
            if len(found) > 200_000:
                yield words()
        if found:
            yield words()

    return spread(chosen).mapInPandas(read, PAGES)


def _lines(text: str | None, kinds: str) -> list[Line]:
    return [Line(x, KINDS[int(k)]) for x, k in zip((text or "").split("\n"), kinds)]


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[Line], list[Line], dict[int, int]]]:
    """Of each document its key, raw and clean lines, and of the clean lines the raw text has their places there."""
    for batch in batches:
        for key, clean, raw, a, b, known, shared in zip(*[batch[c] for c in ("guideline_id", "clean_text", "raw_text", "clean_kinds", "raw_kinds", "known", "shared")]):
            yield key, _lines(raw, b), _lines(clean, a), dict(zip([i for i, x in enumerate(shared) if x == "1"], [k for k, x in enumerate(known) if x == "1"]))


def _held(bitmap, words: set[str]) -> set[str]:
    """The words a filter holds or seems to."""
    listed = list(words)
    return {w for w, h in zip(listed, holds(bitmap, hashes_of(listed))) if h} if listed else set()


def linked_words(vocabulary: DataFrame) -> DataFrame:
    """``word, printed, n_word, n_printed, is_odd``: rare words of the vocabulary and the more frequent ones they may be misread from."""

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"]):
                if len(word) < 3 or not any(c.isalpha() for c in word) or _SPACELESS.search(word):
                    continue
                rows += [(word, form, n, odd(word)) for form in printed_forms(word) if not odd(form) or not odd(word)]
            yield pd.DataFrame(rows, columns=["word", "printed", "n_word", "is_odd"])

    made = spread(vocabulary).mapInPandas(forms, "word string, printed string, n_word long, is_odd boolean")
    linked = made.join(vocabulary.select(F.col("word").alias("printed"), F.col("n").alias("n_printed")), "printed")
    enough = F.col("n_printed") >= F.when(F.col("is_odd"), 1).otherwise(RATIO) * F.col("n_word")
    return linked.filter(enough).select("word", "printed", "n_word", "n_printed", "is_odd")


SURROUNDINGS = "w int, c int, n long, guideline_id long, item_field string, line_no int, word string, context array<int>"


def surroundings(documents: DataFrame, links: DataFrame, model: dict[str, int]) -> DataFrame:
    """One reading of the running words: counted pairs of words of the model, and occurrences of linked words.

    A pair has ``w, c, n``; what both texts of a document have is counted once. An occurrence has its
    place, the ``word`` (``w`` is null) and the words of the model around it.
    """
    words = links.select("word").distinct()
    sc = documents.sparkSession.sparkContext
    keys = sc.broadcast(merged_filter(words.select(F.xxhash64("word")), filter_bits(words.count()), repeated=False))
    known = sc.broadcast(model)
    columns = [x.split(" ")[0] for x in SURROUNDINGS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = known.value
        pairs = Pairs(max(1, len(ids)))
        told: dict[str, tuple[int, tuple[str, ...]]] = {}  # of a word its id and its suspected spellings

        def counted() -> pd.DataFrame:
            w, c, n = pairs.flush()
            nothing = dict.fromkeys(columns[3:], pd.Series([None] * len(w), dtype=object))
            return pd.DataFrame({"w": w, "c": c, "n": n} | nothing)

        def suspects(lines: list[Line], skipped: dict[int, int]) -> Iterator[tuple[int, str, list[int]]]:
            """Line, spelling and words around of suspected words; pairs of lines not ``skipped`` are counted."""
            said = running_words(lines)
            new = {w for _, w in said if w not in told}
            if new:
                held = _held(keys.value, {s for w in new for s in _spelt(w)})
                told.update((w, (ids.get(_spelt(w)[0], -1), tuple(s for s in _spelt(w) if s in held))) for w in new)
            at = np.fromiter((told[w][0] for _, w in said), np.int64, len(said))
            pairs.add(at[[i not in skipped for i, _ in said]] if skipped else at)
            for k, (i, w) in enumerate(said):
                for s in told[w][1]:
                    yield i, s, [int(at[j]) for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(at) and at[j] >= 0]

        for key, full, lines, shared in _each(batches):
            rows = [(key, "raw_text", *x) for x in suspects(full, {})]
            place = {k: i for i, k in shared.items()}
            rows += [(key, "clean_text", place[i], s, near) for _, _, i, s, near in rows if i in place]
            if len(shared) < len(lines):
                rows += [(key, "clean_text", *x) for x in suspects(lines, shared) if x[0] not in shared]
            if rows:
                yield frame_of([dict(zip(columns[3:], r)) for r in rows], columns)
            if pairs.held > AT_ONCE:
                yield counted()
            if len(told) > AT_ONCE:
                told.clear()
        yield counted()

    return documents.mapInPandas(read, SURROUNDINGS)


def judged(seen: DataFrame, links: DataFrame, model: dict[str, int], vectors: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``guideline_id, item_field, line_no, word, printed`` of the occurrences that are misread.

    The printed form is the one with the best sum of the logarithm of its frequency and its fit among
    the words around. A word with a sign no printed word has is misread; one that looks real is where
    the evidence, of this occurrence and of all of its link, allows it. Where no word of the model is
    around, or the printed form is out of the model, frequencies alone tell.
    """
    forms = links.groupBy("word").agg(F.collect_list(F.struct("printed", "n_printed")).alias("forms"), F.first("is_odd").alias("is_odd"), F.first("n_word").alias("n_word"))
    shared = seen.sparkSession.sparkContext.broadcast((model, *vectors))
    place = ["guideline_id", "item_field", "line_no", "word"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, contexts = shared.value
        for batch in batches:
            rows = []
            for *at, near, options, is_odd, n_word in batch[[*place, "context", "forms", "is_odd", "n_word"]].itertuples(index=False, name=None):
                around = contexts[np.asarray(near, np.int64)].mean(axis=0) if len(near) else None
                fits = [float(words[ids[o["printed"]]] @ around) + CHANCE if around is not None and o["printed"] in ids else None for o in options]
                best = max(range(len(options)), key=lambda k: (math.log(options[k]["n_printed"]) + (fits[k] or 0.0), options[k]["printed"]))
                rows.append((*at, options[best]["printed"], fits[best], is_odd, math.log(options[best]["n_printed"] / n_word)))
            yield pd.DataFrame(rows, columns=[*place, "printed", "fit", "is_odd", "prior"]).astype({"fit": "float64"})

    fitted = seen.join(forms, "word").mapInPandas(judge, "guideline_id long, item_field string, line_no int, word string, printed string, fit double, is_odd boolean, prior double")
    fitted = cut_lineage(fitted.withColumn("fit", F.nanvl("fit", F.lit(None).cast("double"))))
    whole = fitted.groupBy("word", "printed").agg(F.count(F.lit(1)).alias("n"), F.avg("fit").alias("mean_fit"))
    told = join_groups(fitted, whole, ["word", "printed"], "n", fitted.count())
    misread = F.col("is_odd") | (F.col("prior") + (F.coalesce("fit", F.lit(0.0)) + F.coalesce("mean_fit", F.lit(0.0))) / 2 >= EVIDENCE - 1e-9)
    kinds = told.agg(F.count(F.lit(1)), F.count("fit"), F.count(F.when(~F.col("is_odd") & F.col("fit").isNotNull(), 1)), F.count(F.when(~misread, 1))).first()
    log.info("linked words: %d occurrences, %d with a fit, %d of them of words that look real; %d kept as they are", *kinds)
    return told.filter(misread).select(*place, "printed")


class Scans:
    """Analysis of the guidelines of one corpus, shared by the finding and the repairing query."""

    def __init__(self, guidelines: DataFrame) -> None:
        ship_package(guidelines.sparkSession)
        self.pages = cut_lineage(read_pages(guidelines))
        self.documents = self.pages.filter("tag = 'doc'").select("guideline_id", "clean_text", "raw_text", "clean_kinds", "raw_kinds", "known", "shared")
        words = self.pages.filter("tag = 'word'").groupBy(F.col("a").alias("word"))
        self.vocabulary = cut_lineage(words.agg(F.sum("n").alias("n")))
        self.links = cut_lineage(linked_words(self.vocabulary))
        model, often = model_words(self.vocabulary)
        read = cut_lineage(surroundings(self.documents, self.links, model))
        vectors = train(cut_lineage(by_word(read.filter("w IS NOT NULL").select("w", "c", "n"))), often)
        self.misread = cut_lineage(judged(read.filter("w IS NULL"), self.links, model, vectors))

    def furniture(self) -> DataFrame:
        """``guideline_id, item_field, line_no, kind`` of running lines and page numbers."""
        return self.pages.filter("tag = 'line'").select("guideline_id", "item_field", "line_no", F.col("a").alias("kind"))

    def breaks(self) -> DataFrame:
        """``guideline_id, item_field, line_no, joined, is_break`` of lines that end in a dividing mark."""
        named = dict(zip("abcde", ["joined", "hyphened", "seam", "left", "right"]))
        held = self.pages.filter("tag = 'end'").select("guideline_id", "item_field", "line_no", (F.col("n") > 0).alias("sure"), *[F.col(c).alias(f) for c, f in named.items()])
        forms = list(named.values())
        long = held.select("guideline_id", "item_field", "line_no", F.explode(F.create_map(*[x for f in forms for x in (F.lit(f), F.col(f))])).alias("form", "word"))
        told = long.join(self.vocabulary, "word").groupBy("guideline_id", "item_field", "line_no").agg(*[F.max(F.when(F.col("form") == f, F.col("n"))).alias(f"n_{f}") for f in forms])
        n = {f: F.coalesce(F.col(f"n_{f}"), F.lit(0)) for f in forms}
        together, apart = F.greatest(n["joined"], n["seam"]), n["hyphened"]
        both_words = (n["left"] >= 3) & (n["right"] >= 3)
        verdict = F.when(F.col("sure"), True).when(together > apart, True).when(apart > together, False).otherwise(~both_words)
        return held.join(told, ["guideline_id", "item_field", "line_no"], "left").select("guideline_id", "item_field", "line_no", "joined", verdict.alias("is_break"))

    def misread_lines(self) -> DataFrame:
        """``guideline_id, item_field, line_no, word, printed`` of the misread words of the running text."""
        return self.misread.select("guideline_id", "item_field", "line_no", "word", "printed").distinct()


def noisy_lines(guidelines: DataFrame) -> DataFrame:
    """``guideline_id, item_field, line_no, kind``: the noisy lines of ``clean_text`` and ``raw_text``.

    Kinds are ``header``, ``page``, ``break`` and ``chars``; lines count from 0. Null and empty texts have
    none. A line is listed once a kind, whatever the number of its faults. Raw lines that no clean line
    equals are judged by themselves, rows of tables told apart by their form. Rows without an id are
    left out, since nothing could name their lines; repeated rows give the same lines once.
    """
    scans = Scans(guidelines)
    found = scans.breaks().filter("is_break").select("guideline_id", "item_field", "line_no", F.lit("break").alias("kind"))
    found = found.unionByName(scans.misread_lines().select("guideline_id", "item_field", "line_no", F.lit("chars").alias("kind")))
    return scans.furniture().unionByName(found).distinct()


def repaired_texts(guidelines: DataFrame) -> DataFrame:
    """``guideline_id, item_field, repaired``: each text in paragraphs, without furniture, divided or misread words.

    One row for ``raw_text`` and one for ``clean_text``; a field without a text comes back empty. Rows of
    tables stay lines of their own, after the paragraph they interrupt.
    """
    scans = Scans(guidelines)
    joins = scans.breaks().groupBy("guideline_id").agg(F.collect_list(F.struct("item_field", "line_no", "is_break")).alias("ends"))
    words = scans.misread_lines().groupBy("guideline_id").agg(F.collect_list(F.struct("item_field", "line_no", "word", "printed")).alias("words"))
    rows = scans.documents.join(joins, "guideline_id", "left").join(words, "guideline_id", "left")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (key, full, clean, _), ends, faults in zip(_each(iter([batch])), batch["ends"], batch["words"]):
                for field, lines in (("raw_text", full), ("clean_text", clean)):
                    for fault in faults if faults is not None else []:
                        if fault["item_field"] != field:
                            continue
                        line = lines[fault["line_no"]]
                        line.text = re.sub(rf"(?<![^\W_]){re.escape(fault['word'])}(?![^\W_])", lambda m, p=fault["printed"]: p[:1].upper() + p[1:] if m[0][:1].isupper() else p, line.text, flags=re.IGNORECASE)
                    told = {e["line_no"]: e["is_break"] for e in ends if e["item_field"] == field} if ends is not None else {}
                    out.append((key, field, reflow(lines, told)))
            yield pd.DataFrame(out, columns=["guideline_id", "item_field", "repaired"])

    return rows.mapInPandas(repair, "guideline_id long, item_field string, repaired string")


def reflow(lines: list[Line], ends: dict[int, bool]) -> str:
    """The running text in paragraphs and the headings, each on a line of its own; tables after their paragraph."""
    blocks: list[str] = []
    table: list[str] = []
    now, glue, spaceless = "", " ", False

    def close() -> None:
        nonlocal now
        if now:
            blocks.append(now)
        if table:
            blocks.append("\n".join(table))
            table.clear()
        now = ""

    finished = True
    for i, line in enumerate(lines):
        text = line.text.strip()
        if line.kind == HEADING:
            close()
            blocks.append(text)
            finished = True
        elif line.kind == BLANK:
            if finished:
                close()
        elif line.kind == TABLE:
            if now and finished:
                close()
            table.append(text)
        elif line.kind not in (HEADER, PAGE):
            if table and finished:
                close()
            spaceless = bool(re.search(r"[぀-ヿ一-鿿。，；：！？”」]$", now)) and bool(re.match(r"[぀-ヿ一-鿿，。；：“「A-Za-z0-9]", text))
            now = f"{now}{'' if not now or glue == '' or spaceless else glue}{text}"
            glue = " "
            if i in ends:
                now, glue = (re.sub(r"[-‐¬­]\s*$", "", now) if ends[i] else now), ""
            finished = bool(re.search(r"[.!?…。！？؟।]['”’»\")\]』」）\s]*$", text))
    close()
    return "\n\n".join(blocks)
