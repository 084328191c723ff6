"""Every registered query against its SQL, at the smallest scale; the others must run and name their columns."""

import duckdb
import pytest

import __spark_entry__ as entry
import verify

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in verify.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_sql_names_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_is_its_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cur = db.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted("|".join(verify.canon(r[c]) for c in sorted(cols)) for r in df.collect())
    want = sorted("|".join(verify.canon(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_other_queries_run_and_name_their_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns)) > 0
    assert len(df.collect()) > 0
