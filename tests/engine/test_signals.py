from datetime import datetime, timedelta

from evidentia.operators import metrics, signals
from evidentia.operators.metrics import MetricSpec


def series(spark, values):
    start = datetime(2026, 1, 1)
    return spark.createDataFrame([("s", start + timedelta(days=i), float(v)) for i, v in enumerate(values)], "k string, at timestamp, v double")


def test_trend(spark):
    assert signals.trend(series(spark, [0.1, 0.2, 0.3]), ["k"], "at", "v").first().status == "insufficient_history"
    r = signals.trend(series(spark, [0.10, 0.12, 0.14, 0.16]), ["k"], "at", "v").first()
    assert (r.status, r.direction, r.slope) == ("measured", "rising", 0.02)


def test_anomaly(spark):
    r = signals.anomaly(series(spark, [0.1] * 5 + [0.9]), ["k"], "at", "v").first()
    assert (r.status, r.score) == ("anomaly", 9.999999)
    assert signals.anomaly(series(spark, [0.1] * 6), ["k"], "at", "v").first().status == "normal"


def test_seasonality(spark):
    r = signals.seasonality(series(spark, [1, 2, 3, 4, 3, 2, 1] * 4), ["k"], "at", "v").first()
    assert (r.status, r.period_days, r.strength) == ("detected", 7, 1.0)
    assert signals.seasonality(series(spark, [1.0] * 6), ["k"], "at", "v").first().status == "insufficient_history"
    r = signals.autocorrelation(series(spark, [1, 2] * 8), ["k"], "at", "v", 2).first()
    assert r.strength == 1.0


def test_unknown_is_not_zero(spark):
    wide = spark.createDataFrame([("a", 5, 5), ("b", 10, 20), ("c", 0, 0)], "e string, k long, n long")
    got = {r.entity: r for r in metrics.tidy(wide, "e", [MetricSpec("bug_ratio", "k", "n", "n", 20, True)]).collect()}
    assert got["a"].status == "insufficient_sample" and got["a"].value is None and got["a"].numerator == 5
    assert got["b"].value == 0.5 and 0 < got["b"].ci_low < 0.5 < got["b"].ci_high < 1
    assert got["c"].value is None


def test_same_data_twice_is_flat(spark):
    df = spark.createDataFrame([("m", 1, 0.5, "measured"), ("m", 2, None, "insufficient_sample"), ("m", 3, 0.5, "measured")], "k string, at int, v double, status string")
    rows = metrics.period_change(df, ["k"], "at", "v", "status").orderBy("at").collect()
    assert [r.signal_status for r in rows] == ["insufficient_history", "insufficient_sample", "measured"]
    assert rows[2].direction == "flat" and rows[2].absolute_change == 0
