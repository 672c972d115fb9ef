"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from quirefold.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert got or name in ("repeated_furniture",)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    state = lambda name: {r.job: (r.events, r.done, r.state) for r in catalogue.QUERIES[name](spark, SF).collect()}
    assert state("streaming_job_state") == state("job_state_fold")
