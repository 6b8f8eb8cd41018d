"""Near-duplicate records by a Gray-order hierarchical index (problem 1).

A record is the set of its word triples, a class the records of equal words. A triple that one class
alone holds is in no intersection, so a class is fingerprinted by its other, shared triples: each bit is
the parity of those hashed there. Two fingerprints differ in at most as many bits as the sets of shared
triples do, and a similarity of ``t`` bounds that number by
``|A'| + |B'| - 2 t / (1 + t) (|A| + |B|)`` (``A'`` shared, ``A`` all triples): no pair is lost.

Classes of a similarity of ``t`` or more have one of their rarest triples in common. Such triples are
gathered into coarse cells, all that lead to the same least class into one, so that a class goes to few
cells and a cell holds whole families. Within a cell fingerprints are sorted by Gray rank under a tree
whose nodes keep the bits that all below them share and no node above them keeps yet. A search goes
down the tree adding up the differences to each node's bits and leaves a whole group once they pass the
bound. The tree is the only search; what it gives is compared by the sets themselves.

Spark takes the size of all tables made here from that of the file that the texts are in, far below what
triples and routes take. A table broadcast by that size has no bound in the driver, so all joins are told
to sort and merge.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.components import components
from lamina.operators.skew import salted
from lamina.session import cut_lineage, ship_package

log = logging.getLogger(__name__)

BITS = 512
#: Classes of a block; a route of more is searched in cells of two blocks each.
BLOCK = 2048
#: Routes of classes that lead to a cell, at most; a class comes to a cell by several routes.
CELL = 4 * BLOCK
FANOUT = 4
#: Query and fingerprint combinations that are open in a search at once, at most.
OPEN = 1 << 19
#: Members of a class that are written out from one task.
MEMBERS = 4096


def record_text(fields: list[str]) -> Column:
    """The fields in lower case with a space between them, null as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def word_triples(words: Column) -> Column:
    """Hashes of the distinct sequences of three consecutive words; none for fewer than three words."""
    triple = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(F.size(words) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 3), triple))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(triples: np.ndarray) -> np.ndarray:
    """Parity of the triples at each bit, as bits."""
    return (np.bincount((triples.view(np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each row of bits in the sequence of the reflected Gray code, as bits."""
    return np.bitwise_xor.accumulate(bits, axis=-1)


def telling_first(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The bits of each row reordered, those first that part the rows of its cell most evenly."""
    edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    counts = np.diff(np.append(edges, len(cells)))
    share = np.add.reduceat(bits, edges, axis=0, dtype=np.int32) / counts[:, None]
    return np.take_along_axis(bits, np.repeat(np.argsort(np.abs(share - 0.5), axis=1, kind="stable"), counts, axis=0), axis=1)


def _joined(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join that neither an estimate nor adaptive execution makes a broadcast."""
    return left.join(right.hint("merge"), keys, how)


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def room(held: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """What a set of ``held`` shared triples out of ``sizes`` adds to the differences a pair may have."""
    return held - 2 * threshold / (1 + threshold) * sizes


class GrayForest:
    """The trees of many cells, side by side: fingerprints in Gray order under nodes that hold shared bits.

    Rows are sorted by cell and Gray rank. A level is (pattern, own mask, least size, largest size,
    largest room, last row, first child, number of children); the first level holds the root of each
    cell, the last one the fingerprints.
    """

    def __init__(self, cells: np.ndarray, codes: np.ndarray, sizes: np.ndarray, rooms: np.ndarray, threshold: float) -> None:
        n = len(codes)
        self.codes, self.sizes, self.rooms, self.threshold = codes, sizes, rooms, threshold
        self.edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if n else np.zeros(0, np.int64)
        self.counts = np.diff(np.append(self.edges, n))
        self.cell = np.repeat(np.arange(len(self.edges)), self.counts)
        full = np.full((n, codes.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        stack = [(codes, full, sizes, sizes, rooms, np.arange(n), None)]
        count = self.counts
        while n and count.max() > 1:
            pattern, mask, low, high, most, last, _ = stack[-1]
            edges = np.cumsum(count) - count
            within = np.arange(len(pattern)) - np.repeat(edges, count)
            starts = np.flatnonzero(within % FANOUT == 0)
            children = np.diff(np.append(starts, len(pattern)))
            first = np.repeat(pattern[starts], children, axis=0)
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), starts, axis=0)
            stack.append((pattern[starts] & shared, shared, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(most, starts), last[starts + children - 1], (starts, children)))
            count = -(-count // FANOUT)
        self.levels = []
        above, family = None, None
        for pattern, mask, low, high, most, last, below in reversed(stack):
            own = mask if above is None else mask & ~np.repeat(above, family, axis=0)
            self.levels.append((pattern, own, low, high, most, last, below))
            above, family = mask, below[1] if below else None
        #: nodes visited, groups left by accumulated differences
        self.visited = self.pruned = 0

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j), i < j, of the same cell that differ in no more bits than the threshold allows."""
        work = np.cumsum(self.counts[self.cell]) if len(self.codes) else np.zeros(0, np.int64)
        at = 0
        while at < len(work):
            stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + OPEN, "right")))
            yield self._search(np.arange(at, stop))
            at = stop

    def _search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.threshold
        node, spent = self.cell[query], np.zeros(len(query), np.int64)
        below = None
        for pattern, own, low, high, most, last, children in self.levels:
            if below is not None:
                starts, many = below[0][node], below[1][node]
                base = np.repeat(np.cumsum(many) - many, many)
                node = np.repeat(starts, many) + np.arange(len(base)) - base
                query, spent = np.repeat(query, many), np.repeat(spent, many)
            ahead = last[node] > query  # each pair is met from its first row
            query, node, spent = query[ahead], node[ahead], spent[ahead]
            spent = spent + _popcount((self.codes[query] ^ pattern[node]) & own[node])
            size = self.sizes[query]
            keep = (spent <= self.rooms[query] + most[node] + 1e-6) & (high[node] >= t * size - 1e-9) & (t * low[node] <= size + 1e-9)
            self.visited += len(keep)
            if children is not None:
                self.pruned += int(len(keep) - keep.sum())
            query, node, spent = query[keep], node[keep], spent[keep]
            below = children
        return query, node


def _codes(threshold: float):
    """Fingerprint and room of each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [np.asarray(x, np.int64) for x in batch["held"]]
            codes = [np.packbits(fingerprint(x)).tobytes() for x in held]
            rooms = room(np.array([len(x) for x in held], float), batch["size"].to_numpy(float), threshold)
            yield pd.DataFrame({"rep_id": batch["rep_id"], "code": codes, "size": batch["size"], "room": rooms})

    return run


def _pairs_of_cells(threshold: float, visited, pruned):
    """Pairs within the cells of a partition sorted by cell."""

    def within(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key, part = frame["cell"].to_numpy(), frame["part"].to_numpy()
        cells = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        bits = np.unpackbits(np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1), axis=1)
        ranks = np.packbits(gray_rank(telling_first(bits, cells)), axis=1).view(">u8")
        order = np.lexsort([*ranks.T[::-1], cells])
        codes = np.packbits(bits[order], axis=1).view(np.uint64)
        frame, cells = frame.iloc[order], cells[order]
        ids, sizes = frame["rep_id"].to_numpy(), frame["size"].to_numpy()
        forest = GrayForest(cells, codes, sizes, frame["room"].to_numpy(), threshold)
        for i, j in forest.pairs():
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            yield pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()
        visited.add(forest.visited)
        pruned.add(forest.pruned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = ((batch["cell"] == batch["cell"].iat[-1]) & (batch["part"] == batch["part"].iat[-1])).to_numpy() if len(batch) else np.zeros(0, bool)
            rest, ready = batch[last], batch[~last]
            if len(ready):
                yield from within(ready)
        if rest is not None and len(rest):
            yield from within(rest)

    return run


def text_classes(records: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """``record_id, class, triples`` of records with an id and a triple; records of equal words have one class."""
    ship_package(records.sparkSession)
    words = F.regexp_extract_all(record_text(fields), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    said = records.select(F.col(record_id).alias("record_id"), words.alias("words"))
    return said.filter((F.size("words") >= 3) & F.col("record_id").isNotNull()).select("record_id", F.sha2(F.array_join("words", " "), 256).alias("class"), word_triples(F.col("words")).alias("triples"))


def shared_triples(reps: DataFrame, threshold: float) -> DataFrame:
    """``rep_id, size, held, routes`` of the classes that may have a partner.

    ``size`` is the number of all triples, ``held`` those that other classes hold too, ``routes`` the
    rarest of them: of two similar classes, ordered by the same exact counts, one of the first
    ``size - ceil(threshold size) + 1`` triples is in both, and it is no triple of one class alone.
    """
    rows = reps.select("rep_id", F.size("triples").alias("size"), F.explode("triples").alias("t"))
    counts = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # one row a triple on the right: adaptive execution splits what a hot triple brings to the left
    told = _joined(rows, counts, "t")
    held = told.groupBy("rep_id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "t"))).alias("held"))
    first = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1 - (F.col("size") - F.size("held"))
    return held.select("rep_id", "size", F.col("held.t").alias("held"), F.slice(F.col("held.t"), F.lit(1), F.greatest(first, F.lit(0)).cast("int")).alias("routes")).filter(F.size("routes") > 0)


def routed(reps: DataFrame) -> DataFrame:
    """``rep_id, cell, part``: the cells each class goes to; classes that share a route share a cell.

    A route leads to its least class, and on to the least class that one's routes lead to. Where the
    cell so made has above ``CELL`` routes of classes, the route leads to itself, and a route of more
    than ``BLOCK`` classes is searched as pairs of blocks.
    """
    rows = reps.select("rep_id", F.explode("routes").alias("route"))
    least = cut_lineage(rows.groupBy("route").agg(F.min("rep_id").alias("near"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    far = _joined(rows, least, "route").groupBy("rep_id").agg(F.min("near").alias("far"))
    meet = _joined(least, far.withColumnRenamed("rep_id", "near"), "near")
    large = meet.groupBy("far").agg(F.sum("n").alias("load")).filter(F.col("load") > CELL).select("far", F.lit(True).alias("large"))
    led = _joined(meet, large, "far", "left")
    merged = F.col("large").isNull()
    led = led.select(
        "route", F.when(merged, F.col("far")).otherwise(F.col("route")).alias("cell"), F.when(merged, 0).otherwise(1).cast("long").alias("part"),
        F.when(merged, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"),
    )
    gone = _joined(rows, led, "route")
    own, other = salted(F.col("rep_id"), 1 << 30) % F.col("blocks"), F.col("other")
    # a route of one block is in the cell as it is, one of several in a cell with each other block
    others = F.when(F.col("blocks") == 1, F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != own))
    pair = F.lit(2) + F.least(own, other).cast("long") * F.col("blocks") + F.greatest(own, other)
    spread = gone.withColumn("other", F.explode(others))
    return spread.select("rep_id", "cell", F.when(other < 0, F.col("part")).otherwise(pair).alias("part")).distinct()


def similar_classes(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal texts, ``a, b, similarity, parts_a, parts_b`` (a < b), and the members.

    The members are ``rep_id, record_id, salt, parts``: a class is known by its least record, its members
    are spread over ``parts`` salts.
    """
    spark = classes.sparkSession
    classes = cut_lineage(classes)
    reps = cut_lineage(classes.groupBy("class").agg(F.min("record_id").alias("rep_id"), F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"), F.first("triples").alias("triples")))
    known = reps.select("class", "rep_id", "parts")
    members = _joined(classes.select("record_id", "class"), known, "class").select("rep_id", "record_id", (salted(F.col("record_id"), 1 << 30) % F.col("parts")).alias("salt"), "parts")
    shared = cut_lineage(shared_triples(reps.select("rep_id", "triples"), threshold))
    codes = shared.select("rep_id", "size", "held").mapInPandas(_codes(threshold), "rep_id long, code binary, size int, room double")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = _joined(routed(shared), codes, "rep_id").repartition(parts, "cell", "part").sortWithinPartitions("cell", "part")
    visited, pruned = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    candidates = cut_lineage(cells.mapInPandas(_pairs_of_cells(threshold, visited, pruned), "a long, b long").distinct())
    log.info("Gray-order index: %d nodes visited, %d groups left by their differences", visited.value, pruned.value)
    side = lambda x: shared.select(F.col("rep_id").alias(x), F.col("size").alias(f"n{x}"), F.col("held").alias(f"t{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    compared = _joined(_joined(candidates, side("a"), "a"), side("b"), "b").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))
    links = compared.filter(F.col("similarity") >= threshold - 1e-12)
    spread_over = lambda x: known.select(F.col("rep_id").alias(x), F.col("parts").alias(f"parts_{x}"))
    return _joined(_joined(links, spread_over("a"), "a"), spread_over("b"), "b"), members


def similar_pairs(records: DataFrame, record_id: str = "drug_id", fields: tuple[str, ...] = ("indications_and_usage", "warnings_and_cautions"), threshold: float = 0.7) -> DataFrame:
    """``a, b`` (a < b): every pair of records with a similarity of ``threshold`` or more, once.

    The similarity is the number of triples in both by the number in either. Null fields are empty;
    records of fewer than three words are in no pair. Copies of a text are searched once and written
    out at the end, a large class from many tasks; records repeated under one id make no pair with themselves.
    """
    links, members = similar_classes(text_classes(records, record_id, list(fields)), threshold)
    members = cut_lineage(members)
    of = lambda x: members.select(F.col("rep_id").alias(x), F.col("salt").alias(f"s{x}"), F.col("record_id").alias(f"r{x}"))
    salts = lambda x: F.explode(F.sequence(F.lit(0), F.col(f"parts_{x}") - 1)).alias(f"s{x}")
    across = _joined(links.select("a", "b", "parts_b", salts("a")), of("a"), ["a", "sa"]).select("b", "ra", salts("b"))
    across = _joined(across, of("b"), ["b", "sb"]).select("ra", "rb")
    many = members.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep_id")
    copies = _joined(members, many, "rep_id", "left_semi")
    left = copies.select("rep_id", F.col("record_id").alias("ra"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    same = _joined(left, copies.select("rep_id", "salt", F.col("record_id").alias("rb")), ["rep_id", "salt"]).filter("ra < rb").select("ra", "rb")
    return across.unionByName(same).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct()


def similar_groups(records: DataFrame, record_id: str = "drug_id", fields: tuple[str, ...] = ("indications_and_usage", "warnings_and_cautions"), threshold: float = 0.7) -> DataFrame:
    """``record_id, group_id, n_links``: one row per record with a triple.

    A group is connected by links of similar texts; its id is the least record id in it. ``n_links`` is
    the number of other texts the record's text is similar to.
    """
    links, members = similar_classes(text_classes(records, record_id, list(fields)), threshold)
    links = cut_lineage(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep_id")).groupBy("rep_id").agg(F.count(F.lit(1)).alias("n_links"))
    group = components(links).select(F.col("node").alias("rep_id"), F.col("component").alias("group_id"))
    known = _joined(group, degree, "rep_id")
    return _joined(members, known, "rep_id", "left").select("record_id", F.coalesce("group_id", "rep_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")).distinct()
