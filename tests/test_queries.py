import glob
import importlib
import os

import duckdb
import pytest

from lamina.plans import registry

ENTRY = importlib.import_module("__spark_entry__")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, oracle, name):
    df = registry.QUERIES[name](spark, data)
    got = df.collect()
    want = oracle.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, want.fetchall())


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_second_ingest_adds_nothing(spark, data):
    got = registry.QUERIES["ingest_incremental"](spark, data)
    assert got.filter("run = 2").agg({"fetched": "sum"}).first()[0] == 0
    assert got.filter("run = 1").agg({"fetched": "sum"}).first()[0] > 0


def test_entry(spark):
    assert ENTRY.entry(spark).count() > 0


def test_nothing_outside_imports_the_training_data_operators():
    root = os.path.dirname(registry.__file__) + "/.."
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "lamina.llm" not in open(path).read(), path


def test_keys_match():
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())
