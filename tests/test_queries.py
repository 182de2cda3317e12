"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodestone.jobs.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events supplier".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    if name in ORACLE_SQL:
        made = duck.sql(ORACLE_SQL[name])
        order = [made.columns.index(c) for c in sorted(df.columns)]
        assert sorted(made.columns) == sorted(df.columns)
        assert rows == sorted((tuple(plain(r[i]) for i in order) for r in made.fetchall()), key=repr)
    else:
        assert rows


def test_entry_holds_the_library(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
