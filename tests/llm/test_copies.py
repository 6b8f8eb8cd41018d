import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import bloom, collapse, similar
from lamina.llm.components import components


def plain(name):
    return "".join(c for c in (name or "").lower() if unicodedata.category(c)[0] in "LN")


def test_copies_against_brute_force(spark, empty):
    r = random.Random(3)
    names = ["Aspirin", " aspirin", "ASPI-RIN", "Ibuprofen", "ibu profen", "x", None, "", "É-tan", "étan"]
    rows = [(i, r.choice(names), r.choice(names), "extra") for i in range(300)] + [(900 + i, f"only {i}", "one", "extra") for i in range(50)]
    df = spark.createDataFrame(rows, "drug_id long, brand_name string, generic_name string, low string")
    sets = {}
    for i, a, b, _ in rows:
        sets.setdefault(tuple(sorted([plain(a), plain(b)])), []).append(i)
    want = sorted((min(s), i) for s in sets.values() for i in s if i != min(s))
    assert sorted(map(tuple, collapse.copies_of_first(df).collect())) == want
    got = {(x["low"], x["high"]): (x["first_id"], x["n_copies"]) for x in collapse.collapse_records(df).collect()}
    assert got == {k: (min(s), len(s)) for k, s in sets.items()}
    none = empty("drug_id long, brand_name string, generic_name string")
    assert collapse.copies_of_first(none).count() == 0 and collapse.collapse_records(none).count() == 0


def test_repeat_filter_has_no_false_negative(spark):
    df = spark.range(20_000, numPartitions=7).select(F.xxhash64(F.col("id") % 15_000).alias("h"))
    bitmap = bloom.merged_filter(df, bloom.filter_bits(20_000), repeated=True)
    hashes = np.array([x["h"] for x in df.distinct().collect()])
    repeated = {x["h"] for x in df.groupBy("h").count().filter("count > 1").collect()}
    flagged = set(hashes[bloom.holds(bitmap, hashes)].tolist())
    assert repeated <= flagged and len(flagged) < 5000 + 500


def test_filter_keeps_its_rate_beyond_a_shard(spark, monkeypatch):
    """With shards of 2 segments 600,000 keys take 7 shards; few singletons pass, and no repeat is held back."""
    monkeypatch.setattr(bloom, "SHARD", 2)
    df = spark.range(600_000, numPartitions=5).select(F.xxhash64(F.when(F.col("id") < 20_000, F.col("id") % 10_000).otherwise(F.col("id"))).alias("h"), F.lit("x").alias("may"))
    assert -(-bloom.filter_segments(600_000) // bloom.SHARD) == 7
    flagged = collapse.flag_repeats(df, "h", 600_000)
    again = df.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    got = flagged.join(again, "h").groupBy((F.col("n") > 1).alias("repeats")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("may_repeat").cast("int")).alias("passed")).collect()
    got = {r["repeats"]: (r["n"], r["passed"]) for r in got}
    assert got[True] == (20_000, 20_000) and got[False][0] == 580_000 and got[False][1] < 0.05 * 580_000
    with pytest.raises(ValueError):
        bloom.merged_filter(df.select("h"), 3 * bloom.SEGMENT * 8, repeated=True)


def test_segments_are_passed_on_in_their_shorter_form():
    few, many = np.zeros(bloom.SEGMENT, np.uint8), np.arange(bloom.SEGMENT, dtype=np.uint32).astype(np.uint8)
    few[[3, 900]] = 0b1010
    assert len(bloom._packed(few)) == 16 and len(bloom._packed(many)) == bloom.SEGMENT
    assert (bloom._unpacked(bloom._packed(few)) == few).all() and (bloom._unpacked(bloom._packed(many)) == many).all()


def triples(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(zip(w, w[1:], w[2:]))


def brute(rows, threshold=0.7):
    sets = [(i, triples(f"{a or ''} {b or ''}")) for i, a, b in rows]
    return sorted({(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(sets, 2) if i != j and a and b and len(a & b) / len(a | b) >= threshold})


def variants(seed, n=240):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.randint(8, 160))] for _ in range(20)]
    rows = []
    for i in range(n):
        t = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(t))
            if r.random() < 0.5:
                t[k] = r.choice(words)
            else:
                t.insert(k, r.choice(words))
        if r.random() < 0.2:
            t = t[len(t) // 3 :] + t[: len(t) // 3]
        rows.append((i, " ".join(t[:9]).upper(), ", ".join(t[9:])))
    return rows + [(1000, None, None), (1001, "", "  "), (1002, "one two", None), (1003, "a b c", None), (1004, None, "A, b; c!")]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_against_brute_force(spark, monkeypatch, seed):
    rows = variants(seed)
    df = spark.createDataFrame(rows, "drug_id long, indications_and_usage string, warnings_and_cautions string").withColumn("class", F.lit("clash"))
    df = df.unionByName(df.limit(1)).unionByName(df.limit(1).withColumn("drug_id", F.lit(None).cast("long")))
    want = brute(rows)
    assert sorted(map(tuple, similar.similar_pairs(df).collect())) == want and (1003, 1004) in want
    parent = {i: i for i, a, b in rows if triples(f"{a or ''} {b or ''}")}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in want:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x["record_id"]: x["group_id"] for x in similar.similar_groups(df).collect()}
    assert {k: v for k, v in got.items()} == {i: find(i) for i in parent} | {i: i for i in got if i not in parent}


@pytest.mark.parametrize("block", [2, 5])
def test_large_cells_are_parted(spark, monkeypatch, block):
    rows = variants(5, 150)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "CELL", 12 * block)
    monkeypatch.setattr(similar, "MEMBERS", 2)
    df = spark.createDataFrame([*rows, *((2000 + i, *rows[0][1:]) for i in range(7))], "drug_id long, indications_and_usage string, warnings_and_cautions string")
    shared = similar.shared_triples(similar.text_classes(df, "drug_id", ["indications_and_usage", "warnings_and_cautions"]).groupBy("class").agg(F.min("record_id").alias("rep_id"), F.first("triples").alias("triples")).select("rep_id", "triples"), 0.7)
    parts = {r["part"] for r in similar.routed(shared).select("part").distinct().collect()}
    assert 1 in parts and max(parts) > 1
    assert sorted(map(tuple, similar.similar_pairs(df).collect())) == brute([*rows, *((2000 + i, *rows[0][1:]) for i in range(7))])


def test_no_table_is_broadcast_by_the_size_of_a_file(spark, tmp_path):
    """A file tells nothing of the size of its triples: at the usual threshold the driver would hold them all."""
    fields, rows = ["indications_and_usage", "warnings_and_cautions"], variants(1)
    spark.createDataFrame(rows, "drug_id long, indications_and_usage string, warnings_and_cautions string").coalesce(1).write.parquet(f"{tmp_path}/drugs")
    df = spark.read.parquet(f"{tmp_path}/drugs")
    classes = similar.text_classes(df, "drug_id", fields)
    reps = classes.groupBy("class").agg(F.min("record_id").alias("rep_id"), F.first("triples").alias("triples")).select("rep_id", "triples")
    shared = similar.shared_triples(reps, 0.7)
    found = similar.similar_pairs(df)
    for made in (shared, similar.routed(shared), *similar.similar_classes(classes, 0.7), found):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_the_tree_is_the_search_and_leaves_groups(spark, caplog):
    df = spark.createDataFrame(variants(7, 400), "drug_id long, indications_and_usage string, warnings_and_cautions string")
    with caplog.at_level("INFO", "lamina.llm.similar"):
        similar.similar_pairs(df).count()
    visited, left = map(int, re.findall(r"\d+", caplog.messages[-1]))
    assert visited > 400 and left > 0


def test_forest_equals_comparing_all():
    r = np.random.default_rng(1)
    codes = r.integers(0, 2**63, (700, 8), dtype=np.uint64)
    codes[100:] = codes[r.integers(0, 100, 600)] ^ (np.uint64(1) << r.integers(0, 63, (600, 8), dtype=np.uint64))
    sizes, cells = r.integers(60, 90, 700), np.sort(np.r_[r.integers(0, 30, 300), np.full(400, 40)])
    rooms = similar.room(sizes.astype(float), sizes, 0.7)
    bits = np.unpackbits(codes.view(np.uint8).reshape(700, -1), axis=1)
    order = np.lexsort([*np.packbits(similar.gray_rank(similar.telling_first(bits, cells)), axis=1).T[::-1], cells])
    codes, sizes, rooms, cells = codes[order], sizes[order], rooms[order], cells[order]
    forest = similar.GrayForest(cells, codes, sizes, rooms, 0.7)
    got = {p for i, j in forest.pairs() for p in zip(i.tolist(), j.tolist())}
    distance = np.bitwise_count(codes[:, None] ^ codes[None]).sum(-1, dtype=np.int64)
    a, b = sizes[:, None], sizes[None]
    want = (distance <= (a + b) * 0.3 / 1.7 + 1e-6) & (b >= 0.7 * a - 1e-9) & (0.7 * b <= a + 1e-9) & (cells[:, None] == cells[None])
    assert got == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(want))) if i < j}
    assert forest.pruned > 0
    none = similar.GrayForest(np.zeros(0, int), np.zeros((0, 8), np.uint64), np.zeros(0, int), np.zeros(0), 0.7)
    assert list(none.pairs()) == []


def test_gray_rank_steps_change_one_bit():
    ranks = np.array([[int(b) for b in f"{i:06b}"] for i in range(64)], np.uint8)
    codes = ranks.copy()
    codes[:, 1:] ^= ranks[:, :-1]
    assert (np.abs(np.diff(codes.astype(int), axis=0)).sum(axis=1) == 1).all() and (similar.gray_rank(codes) == ranks).all()


def test_empty_tables(empty):
    ddl = "drug_id long, indications_and_usage string, warnings_and_cautions string"
    assert similar.similar_pairs(empty(ddl)).count() == 0 and similar.similar_groups(empty(ddl)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (7, 7), *((100, i) for i in range(101, 140))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, **{i: 10 for i in (10, 11, 12)}, **{i: 100 for i in range(100, 140)}}
