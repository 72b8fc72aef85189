import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.functions.exprs import half_even, half_up

# sums of decimals whose doubles lie just off the tie that they are, and values at the ends of the range
VALUES = [0.5 * a + 0.3 * b + 0.2 * c for a in (0.15, 0.176471, 0.291667) for b in (0.1, 0.333333, 0.25) for c in (0.2, 0.083333, 0.1875)]
VALUES += [0.20375 * 0.9 * 0.7, 0.06172849999999999, 1.0000005, -0.06172849999999999, 1.005, 2.675, 1e305, -1e305, 0.0, None]


@pytest.mark.parametrize("digits", [2, 6, 9])
def test_rounding_equals_sql(spark, digits):
    got = spark.createDataFrame(list(enumerate(VALUES)), "i int, x double").select("i", half_even(F.col("x"), digits).alias("e"), half_up(F.col("x"), digits).alias("u")).orderBy("i").collect()
    con = duckdb.connect()
    want = [con.execute(f"select round_even(?::double, {digits}), round(?::double, {digits})", [x, x]).fetchall()[0] for x in VALUES]
    assert [(r.e, r.u) for r in got] == want
