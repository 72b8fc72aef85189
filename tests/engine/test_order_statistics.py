"""Exact order statistics and median slopes against plain sorting and all pairs."""

import random
import statistics
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import order_statistics, signals, slopes


@pytest.mark.parametrize("kind", ["normal", "ties", "spread", "few", "nan"])
def test_quantiles_equal_sorting(spark, kind):
    """One group holds most rows and is narrowed many times; the others are left to Spark."""
    r = random.Random(len(kind))
    value = {
        "normal": lambda: r.gauss(0, 1), "ties": lambda: r.choice([0.0, 0.0, 0.0, 1.5, -2.0, 7.0]), "spread": lambda: r.choice([-1, 1]) * 10.0 ** r.uniform(-200, 200), "few": lambda: float(r.randrange(40)),
        "nan": lambda: float("nan") if r.random() < 0.6 else r.random(),
    }[kind]
    rows = [("hot" if i % 10 else None if i % 20 else "cold", value() if i % 31 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {"a": 0.0, "b": 0.25, "m": 0.5, "p": 0.987, "z": 1.0}
    got = {r.k: r for r in order_statistics.exact_quantiles(df, ["k"], "v", want, limit=50).collect()}
    key = lambda x: (x != x, x)
    for k in ("hot", "cold", None):
        values = sorted((v for kk, v in rows if kk == k and v is not None), key=key)
        for name, p in want.items():
            at = p * (len(values) - 1)
            a, b = values[int(at)], values[-int(-at // 1)]
            expected = a if int(at) == at else (1 - (at - int(at))) * a + (at - int(at)) * b
            assert got[k][name] == pytest.approx(expected, rel=1e-12, nan_ok=True), (k, name)


def test_one_group_of_all_rows_without_keys(spark):
    df = spark.range(10_001).selectExpr("cast(id * 7919 % 10007 as double) as v")
    values = sorted(i * 7919 % 10007 for i in range(10_001))
    assert order_statistics.exact_median(df, [], "v", "m", limit=100).first().m == values[5000]
    assert order_statistics.exact_median(df.where("v < 0"), [], "v", "m").first().m is None


def all_slopes(us, v):
    return sorted((v[j] - v[i]) / ((us[j] - us[i]) / slopes.DAY) for i in range(len(us)) for j in range(len(us)) if us[i] < us[j])


@pytest.mark.parametrize("seed", range(12))
def test_median_slope_equals_all_pairs(monkeypatch, seed):
    """Noise, ties, equal times, flat stretches, whole numbers and large values; also with almost no pair listed at once."""
    monkeypatch.setattr(slopes, "FEW", [4000, 3, 40][seed % 3])
    r = random.Random(seed)
    n = r.choice([2, 3, 5, 17, 60, 150])
    us = [r.randrange(0, n if seed % 4 == 0 else 10**6) * slopes.DAY // r.choice([1, 24]) for _ in range(n)]
    v = [[r.gauss(0, 1), float(r.randrange(3)), 1e9 + r.random(), 0.3 * u / slopes.DAY + r.choice([0.0, 0.0, 5.0]), 1.0, r.random() * 1e-9][seed % 6] for u in us]
    want = all_slopes(us, v)
    got = slopes.Slopes(np.array(us), np.array(v)).median()
    if not want:
        assert got is None
    else:
        assert got == pytest.approx(statistics.median(want), rel=1e-9, abs=1e-15)


def test_inversions():
    r = random.Random(4)
    for n in (0, 1, 2, 31, 32, 33, 200, 1000):
        a = [r.randrange(max(1, n // 2)) for _ in range(n)]
        assert slopes.inversions(a) == sum(a[i] > a[j] for i in range(n) for j in range(i + 1, n))


def test_long_series_in_little_time_and_memory():
    """A million points have half a billion thousand pairs; the known slope comes out, in memory for a few copies of the series."""
    import tracemalloc

    n = 1_000_000
    us = np.arange(n, dtype=np.int64) * slopes.DAY
    v = 0.25 * np.arange(n) + np.random.default_rng(1).normal(0, 3, n)
    tracemalloc.start()
    start = time.monotonic()
    got = slopes.Slopes(us, v).median()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == pytest.approx(0.25, abs=1e-6)
    assert time.monotonic() - start < 240 and peak < 40 * 8 * n


def test_trend_equals_all_pairs(spark):
    r = random.Random(9)
    start = datetime(2026, 1, 1)
    rows = [(k, start + timedelta(hours=i * 7 + r.randrange(3)), r.gauss(0, 1) + 0.1 * i) for k in ("a", "b") for i in range(70)] + [("short", start, 1.0)]
    got = {r.k: r for r in signals.trend(spark.createDataFrame(rows, "k string, at timestamp, v double"), ["k"], "at", "v").collect()}
    for k in ("a", "b"):
        own = [(int((t - start) / timedelta(microseconds=1)), v) for kk, t, v in rows if kk == k]
        assert got[k].slope == round(statistics.median(all_slopes(*zip(*own, strict=True))), 9)
    assert got["short"].status == "insufficient_history" and got["short"].slope is None


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rows_stay_where_they_are_read(spark, keys):
    """Brackets go to the rows, however large Spark takes them to be: no join deals rows out by group."""
    rows = spark.range(1000).selectExpr("id % 2 as k", "cast(id as double) as v").select(*keys, "v")
    state = rows.groupBy(*keys).agg(F.lit(1).alias("rank"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("inside"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = order_statistics._inside(rows, state, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_short_series_share_a_task(spark):
    """Many short series by their pairs, none with a call of its own, give what the counted inversions give."""
    r = random.Random(5)
    rows = [(k, r.randrange(20) * 1000, float(r.randrange(9))) for k in range(60) for _ in range(k % 7 + 1)]
    want = {k: slopes.Slopes([t for i, t, _ in rows if i == k], [v for i, _, v in rows if i == k]).median() for k in range(60)}
    df = spark.createDataFrame(rows, "k long, us long, v double").repartition(2, "k").sortWithinPartitions("k")
    got = {x.k: x.slope for x in df.mapInArrow(slopes.medians(1), "k long, slope double").collect()}
    assert got == want
    points = df.select("k", F.timestamp_micros("us").alias("at"), "v")
    assert "FlatMapGroupsInPandas" not in signals.trend(points, ["k"], "at", "v")._jdf.queryExecution().optimizedPlan().toString()
