"""The registered queries: they run, and equal their SQL on the small tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from lorekeep.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(row):
    return repr([round(x, 6) if isinstance(x, float) else x for x in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(plain(r) for r in df.select(columns).collect())
    if name in ORACLE_SQL:
        want = Counter(plain(r) for r in duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())
        assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "rowid", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_upsert_reaches_every_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {str(r.doc_id) for r in docs.select("doc_id").collect()}
    blank = {str(r.doc_id) for r in docs.where(r"text is null or not text rlike '\\S'").select("doc_id").collect()}
    got = {r.id: r.title for r in QUERIES["import_upsert"](spark, DATA).collect()}
    assert set(got) == ids | {f"new-{i}" for i in ids - blank}
    assert {i for i, title in got.items() if title == "changed"} == ids - blank
