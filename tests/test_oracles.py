"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

import workload

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_same_rows(name, spark, sf, duck):
    df = workload.QUERIES[name](spark, sf)
    want = duck.sql(workload.ORACLES[name])
    assert normal(df.columns, df.collect()) == normal(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLES)))
def test_rows_only(name, spark, sf):
    assert workload.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
