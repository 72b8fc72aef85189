import duckdb
import pytest

import __spark_entry__ as entry
from evidentia.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def same(x):
    return None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(same, r)) for r in df.select(cols).collect()), key=str)
    want = sorted((tuple(map(same, r)) for r in con.sql(f"select {','.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()), key=str)
    assert got and got == want
