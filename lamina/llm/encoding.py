"""Text decoded with a wrong character encoding (problem 9).

The garbled forms of every distinct clean word of the corpus, under every chain of a wrong decoding,
make a table; the distinct words of the documents are hash-joined against it, and what matches is put
back. Forms that lost characters (U+FFFD) are in the table too and are put back where only one word can
have become so. A word that no clean text holds is accepted where undoing a chain that began with UTF-8
gives valid UTF-8 of characters the corpus holds. A word with a mark of loss that nothing matches counts
as damaged where the mark touches a letter or another mark.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.bloom import filter_bits, hashes_of, holds, merged_filter
from lamina.llm.frames import ids
from lamina.session import cut_lineage, ship_package, spread

#: A word: letters and characters beyond ASCII, one of the latter at least. A run: such characters as
#: Latin text and single-byte decodings use, also where they touch another script.
WORD = r"((?<![A-Za-z\x{80}-\x{10FFFF}])[A-Za-z]*+[\x{80}-\x{10FFFF}][A-Za-z\x{80}-\x{10FFFF}]*+)"
RUN = r"([\x{80}-\x{2FF}\x{2000}-\x{22FF}]{2,}+)"
#: Characters of garbled forms that are tested against the filter at once.
AT_ONCE = 1 << 20
#: A form that could be a word of its own is garbled where its original is in so many times as many texts,
#: or where a document has so many of them under one chain, whose originals are together so many times as frequent.
CLEAR, TOGETHER = 3, 3

SOURCES = ("cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1256", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr", "cp874", "cp1250", "mac_roman", "cp437", "cp850")
TARGETS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "koi8-r", "mac_roman", "cp437", "cp850", "cp866", "cp874", "gbk", "big5", "shift_jis")
WIDE = ("gbk", "big5", "shift_jis")
READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866")
TWICE = ("cp1252", "latin-1", "cp1251", "cp1250", "mac_roman")

Chain = tuple[tuple[str, str], ...]
#: Every chain: pairs of (encoding of the bytes, encoding they were read in).
CHAINS: list[Chain] = (
    [(("utf-8", t),) for t in TARGETS]
    + [(("utf-8", t), ("utf-8", u)) for t in TWICE for u in TWICE]
    + [((s, t),) for s in SOURCES for t in READERS if s != t]
    + [((s, t), ("utf-8", u)) for s in ("cp1252", "cp1251", "koi8-r", "gbk", "shift_jis", "cp1256", "cp874") for t in ("cp1252", "latin-1", "cp1251") if s != t for u in ("cp1252", "latin-1")]
)
#: Chains that lose characters: bytes no UTF-8 or no ASCII is made of, each read as U+FFFD, and what becomes of that.
LOSSY: list[Chain] = (
    [((s, "utf-8"),) for s in SOURCES] + [(("utf-8", "ascii"),), (("cp1252", "ascii"),)]
    + [((s, "utf-8"), ("utf-8", t)) for s in ("cp1252", "cp1251", "gbk") for t in ("cp1252", "latin-1")]
)
#: All of them by the encoding of the first bytes.
BY_SOURCE = {s: [c for c in CHAINS + LOSSY if c[0][0] == s] for s in ("utf-8", *SOURCES)}
LOST = "\ufffd"
#: Stands for a character that a chain cannot carry.
_NONE = "\uffff"


def _byte_table(name: str) -> list[str]:
    """The character of each byte; bytes without one become the C1 control of their value."""
    return [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]


#: Chains that valid UTF-8 proves; the longer first, else what was garbled twice would come back garbled once.
_UNDONE = sorted((c for c in CHAINS if all(s == "utf-8" and t not in WIDE for s, t in c)), key=len, reverse=True)

_READ = {t: _byte_table(t) for t in TARGETS if t not in WIDE}
_BACK = {t: {c: b for b, c in enumerate(table)} for t, table in _READ.items()}


class _Garbled(dict):
    """What a chain makes of each character, where that does not depend on its neighbours."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain

    def __missing__(self, code: int) -> str:
        text = chr(code)
        for source, target in self.chain:
            try:
                data = text.encode(source)
            except UnicodeEncodeError:
                text = _NONE
                break
            text = "".join([_READ[target][b] for b in data]) if target != "ascii" else "".join([chr(b) if b < 128 else LOST for b in data])
        self[code] = text
        return text


_TABLES = {c: _Garbled(c) for c in CHAINS + LOSSY if all(t in _READ or t == "ascii" for _, t in c)}


def garble(word: str, chain: Chain) -> str | None:
    """The form of ``word`` under ``chain``; None where it cannot be so encoded or stays as it is."""
    table = _TABLES.get(chain)
    if table is not None:
        text = word.translate(table)
        return None if text == word or _NONE in text else text
    text = word
    for source, target in chain:
        try:
            data = text.encode(source)
        except UnicodeEncodeError:
            return None
        text = "".join([_READ[target][b] for b in data]) if target in _READ else data.decode(target, "replace")
    return text if text != word else None


def garbled_forms(word: str) -> Iterator[tuple[str, Chain]]:
    """Every telling form of a word, once, with the first chain that gives it."""
    seen = {word}
    for source, chains in BY_SOURCE.items():
        try:
            word.encode(source)
        except UnicodeEncodeError:
            continue
        for chain in chains:
            form = garble(word, chain)
            if form is not None and form not in seen:
                seen.add(form)
                if _telling(form):
                    yield form, chain


def ungarble(text: str) -> tuple[str, str] | None:
    """The text before a chain that began with UTF-8, where undoing it gives valid, printable UTF-8."""
    for chain in _UNDONE:
        now = text
        for source, target in reversed(chain):
            back = _BACK[target]
            try:
                now = bytes([back[c] for c in now]).decode(source)
            except (KeyError, UnicodeDecodeError):
                break
        else:
            if now != text and not now.isascii() and all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in now):
                return now, "/".join(f"{s}>{t}" for s, t in chain)
    return None


def words_of(text: Column) -> Column:
    """Distinct words and runs of a text."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.regexp_extract_all(text, F.lit(RUN), F.lit(1))))


def _strong(form: str, chain: Chain) -> bool:
    """Whether ``form`` can hardly be anything but garbled: UTF-8 read byte by byte, or characters lost."""
    return LOST in form or (chain[0][0] == "utf-8" and chain[-1][1] not in WIDE and sum(c > "\x7f" for c in form) >= 2)


def _telling(form: str) -> bool:
    if form.isascii():
        return False
    return len(form) >= 3 or LOST in form or (len(form) == 2 and min(form) > "\x7f")


#: A mark of loss: U+FFFD or a C1 control other than that of a line end.
_MARK = "[\ufffd\x80-\x84\x86-\x9f]"


def damaged(word: Column) -> Column:
    """Whether a word holds a mark of loss that touches a letter or another mark."""
    return word.rlike(rf"[\p{{L}}\p{{M}}]{_MARK}|{_MARK}[\p{{L}}\p{{M}}]|{_MARK}{_MARK}")


def _known_characters(vocabulary: DataFrame) -> frozenset[str]:
    """The characters beyond ASCII that the corpus holds, at most as many as Unicode has."""
    signs = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter(F.col("c") > "\x7f").distinct()
    return frozenset(r["c"] for r in signs.collect())


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def believed(original: str, known: frozenset[str]) -> bool:
    """Whether an undone word can be meant: of characters the corpus holds, or of one script that it holds.

    Three new letters of a script vouch for it themselves.
    """
    new = [c for c in original if c > "\x7f"]
    if all(c in known for c in new):
        return True
    scripts = {_script(c) for c in original if c.isalpha()}
    return len(scripts) <= 1 and (len(new) >= 3 or scripts <= {"LATIN"} or any(_script(c) in scripts for c in known))


def garbled_words(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, original, chain``: the garbled words among the distinct words of the corpus; and the doubtful ones.

    ``vocabulary`` has each ``word`` once with the number of texts that hold it, ``n``. A form that
    could also be a word of its own counts as garbled where its original is in at least ``CLEAR``
    times as many texts; else it is doubtful, with ``odds``, the logarithm of how many times. Of several
    originals the one in most texts is taken; a word that lost characters and has several has none (null).
    """
    bitmap = vocabulary.sparkSession.sparkContext.broadcast(merged_filter(vocabulary.select(F.xxhash64("word")), filter_bits(vocabulary.count()), repeated=False))
    known = vocabulary.sparkSession.sparkContext.broadcast(_known_characters(vocabulary))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Forms that the corpus seems to hold; of the others nothing is kept."""

        def held(rows: list[tuple]) -> pd.DataFrame:
            kept = [r for r, h in zip(rows, holds(bitmap.value, hashes_of([r[0] for r in rows]))) if h]
            told = [(form, word, "/".join(f"{s}>{t}" for s, t in chain), n, _strong(form, chain)) for form, word, chain, n in kept]
            return pd.DataFrame(told, columns=["word", "original", "chain", "n_original", "strong"])

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for word, n in zip(batch["word"], batch["n"]):
                if any("\x80" <= c <= "\x9f" or c == LOST for c in word):
                    continue
                for form, chain in garbled_forms(word):
                    size += len(form)
                    rows.append((form, word, chain, n))
                if size > AT_ONCE:
                    yield held(rows)
                    rows, size = [], 0
            if rows:
                yield held(rows)

    made = spread(vocabulary).mapInPandas(forms, "word string, original string, chain string, n_original long, strong boolean")
    met = cut_lineage(made.join(vocabulary, "word"))
    clear = F.col("strong") | (F.col("n_original") >= CLEAR * F.col("n"))
    matched = met.filter(clear)
    best = matched.groupBy("word").agg(
        F.max_by(F.struct("original", "chain"), F.struct("strong", "n_original", "original")).alias("b"),
        (F.min("original") < F.max("original")).alias("several"),
    )
    best = cut_lineage(best.select("word", F.when(~(F.col("several") & F.col("word").contains(LOST)), F.col("b.original")).alias("original"), "b.chain"))

    def undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, *u) for w in batch["word"] if LOST not in w and (u := ungarble(w)) and believed(u[0], known.value)]
            yield pd.DataFrame(rows, columns=["word", "original", "chain"])

    others = vocabulary.select("word").join(best.select("word"), "word", "left_anti")
    undone = cut_lineage(others.mapInPandas(undo, "word string, original string, chain string"))
    hurt = others.filter(damaged(F.col("word"))).join(undone.select("word"), "word", "left_anti")
    found = best.unionByName(undone).unionByName(hurt.select("word", F.lit(None).cast("string").alias("original"), F.lit("lost").alias("chain")))
    # a word far more frequent than what it could stem from is its own and says nothing of the others
    near = F.col("n_original") * CLEAR >= F.col("n")
    weak = met.filter(~clear & near & (F.length("word") >= 3)).groupBy("word", "chain").agg(F.max_by(F.struct("original", "n_original", "n"), F.struct("n_original", "original")).alias("b"))
    weak = weak.select("word", "chain", "b.original", F.log(F.col("b.n_original") / F.col("b.n")).alias("odds"))
    return found, weak.join(found.select("word"), "word", "left_anti")


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").filter(F.col("text").isNotNull())


def garbled_occurrences(documents: DataFrame) -> DataFrame:
    """``doc_id, word, original, chain`` of each distinct garbled word of each document; ``original`` is null where lost."""
    ship_package(documents.sparkSession)
    beyond = _documents(documents).filter(F.col("text").rlike(r"[\x{80}-\x{10FFFF}]"))
    held = cut_lineage(beyond.select("doc_id", F.xxhash64("text").alias("said"), F.explode(words_of(F.col("text"))).alias("word")))
    vocabulary = cut_lineage(held.groupBy("word").agg(F.count_distinct("said").alias("n")))
    found, doubtful = garbled_words(vocabulary)
    sure = held.join(cut_lineage(found), "word").select("doc_id", "word", "original", "chain")
    doubtful = cut_lineage(doubtful)
    if doubtful.isEmpty():
        return sure
    # a source decoded wrongly as a whole has its words often; many of one chain in one text tell
    seen = held.join(doubtful, "word")
    told = seen.groupBy("said", "chain").agg(F.count_distinct("word").alias("words"), F.sum("odds").alias("odds"))
    told = told.filter((F.col("words") >= TOGETHER) & (F.col("odds") >= math.log(CLEAR)))
    best = told.groupBy("said").agg(F.max_by("chain", F.struct("odds", "chain")).alias("chain"))
    return sure.unionByName(seen.join(best, ["said", "chain"]).select("doc_id", "word", "original", "chain"))


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents with garbled characters, restorable or not, once each.

    Null and empty texts have none. Texts are read whole. An empty table gives no row.
    """
    return garbled_occurrences(documents).select("doc_id").distinct()


def restored_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, restored, n_words, complete`` of every garbled document.

    ``restored`` is the text with its garbled words replaced, ``complete`` whether nothing garbled is
    left that could be told. Documents that hold nothing restorable come back as they are; those without
    an id are restored like one. Only texts whose id a filter of the ids found holds are shuffled.
    """
    found = cut_lineage(garbled_occurrences(documents).select("doc_id", "word", "original"))
    words = found.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_list(F.struct("word", "original")).alias("words"))
    hit = found.select(F.xxhash64("doc_id").alias("h")).distinct()
    shared = documents.sparkSession.sparkContext.broadcast(merged_filter(hit, filter_bits(hit.count()), repeated=False))

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, hashes.to_numpy()))

    rows = _documents(documents).filter(may(F.xxhash64("doc_id"))).join(words, F.expr("doc_id <=> hit_id"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for batch in batches:
            out = []
            for doc, text, words in zip(ids(batch["doc_id"]), batch["text"], batch["words"]):
                pairs = {w["word"]: w["original"] for w in words if w["original"] is not None}
                count = 0
                if pairs:
                    pattern = re.compile("|".join(re.escape(w) for w in sorted(pairs, key=lambda w: (-len(w), w))))
                    text, count = pattern.subn(lambda m: pairs[m[0]], text)
                out.append((doc, text, count, not re.search(_MARK, text)))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "n_words", "complete"]).astype({"doc_id": object})

    return rows.mapInPandas(restore, "doc_id long, restored string, n_words long, complete boolean")
