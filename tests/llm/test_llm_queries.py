import glob
import os

import duckdb
import pytest

from lamina.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, data)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r[n] for n in sorted(names))) for r in df.collect()) == sorted(str(tuple(dict(zip(names, r))[n] for n in sorted(names))) for r in want.fetchall())


COLUMNS = {
    "p1_found": [("drug_id_a", "bigint"), ("drug_id_b", "bigint")],
    "p3_found": [("first_id", "bigint"), ("copy_id", "bigint")],
    "p4_found": [("guideline_id", "bigint"), ("item_field", "string"), ("line_no", "int"), ("kind", "string")],
    "p5_found": [("item_field", "string"), ("item_id", "bigint")],
    "p6_found": [("item_field", "string"), ("item_key", "string"), ("end_pos", "int")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("source", "string")],
    "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name] and df.count() == df.distinct().count()
