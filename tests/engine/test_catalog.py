import duckdb
import pytest

import __spark_entry__ as entry
from evidentia.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def same(x):
    return None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(same, r)) for r in df.select(cols).collect()), key=str)
    want = sorted((tuple(map(same, r)) for r in con.sql(f"select {','.join(cols)} from ({catalog.ORACLES[name]})").fetchall()), key=str)
    assert got == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
