"""Every query with a SQL twin against DuckDB on the smallest tables, and rows and columns of the others."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry._catalog()


def rows_of(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].copy()
    for c in columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6) + 0.0
    texts = frame.astype(object).where(frame.notna(), None).astype(str)
    return columns, sorted(map(tuple, texts.itertuples(index=False)))


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows_of(got) == rows_of(tables.sql(SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_names():
    assert set(SQL) <= set(QUERIES)
