"""Signals of a time series: robust trend, anomaly of the last point, seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.exprs import days_between, half_up, micros
from evidentia.operators import slopes
from evidentia.operators.order_statistics import exact_median

PERIODS = (7, 30, 90)


def _series(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """One row for each key with its points in order of time."""
    grouped = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v")))).alias("p"))
    return grouped.withColumn("n", F.size("p").cast("long"))


def trend(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Median of all pairwise slopes per day and its share of the median value over 30 days.

    A series goes to one task, sixteen bytes a point; only short ones form their pairs, and a task takes series after series.
    """
    p = points.select(*keys, micros(F.col(at)).alias("us"), F.col(value).cast("double").alias("v")).where("us is not null and v is not null")
    schema = T.StructType([*[points.schema[k] for k in keys], T.StructField("slope", T.DoubleType())])
    slopes_of = p.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "us", "v").mapInArrow(slopes.medians(len(keys)), schema)
    base = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    j = base.join(exact_median(points, keys, value, "mid"), keys, "left").join(slopes_of, keys, "left")
    enough = F.col("n") >= 4
    relative = F.when(enough & (F.col("mid") != 0), F.col("slope") * 30 / F.abs("mid"))
    word = F.when(relative > 0.05, "rising").when(relative < -0.05, "falling").otherwise("stable")
    return j.select(
        *keys, "n", F.when(enough, "measured").otherwise("insufficient_history").alias("status"), F.when(enough, half_up(F.col("slope"), 9)).alias("slope"),
        half_up(relative).alias("relative_30d"), F.when(enough, word).alias("direction"),
    )


def anomaly(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Modified z-score of the last point against all before it."""
    last = points.groupBy(*keys).agg(F.max_by(F.col(value).cast("double"), F.col(at)).alias("last"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"))
    history = points.join(last, keys).where(F.col(at) < F.col("last_at")).select(*keys, F.col(value).cast("double").alias("v"))
    mid = exact_median(history, keys, "v", "mid")
    mad = exact_median(history.join(mid, keys), keys, F.abs(F.col("v") - F.col("mid")), "mad")
    j = last.join(mid, keys, "left").join(mad, keys, "left")
    enough, off = F.col("n") >= 6, F.col("last") - F.col("mid")
    score = F.when(F.col("mad") != 0, 0.6745 * off / F.col("mad")).otherwise(F.when(off == 0, F.lit(0.0)).otherwise(F.lit(9.999999)))
    odd = F.when(F.col("mad") != 0, F.abs(score) >= 3.5).otherwise(off != 0)
    return j.select(*keys, "n", F.when(~enough, "insufficient_history").when(odd, "anomaly").otherwise("normal").alias("status"), F.when(enough, half_up(score)).alias("score"))


def autocorrelation(points: DataFrame, keys: list[str], at: str, value: str, lag: int) -> DataFrame:
    """Pearson correlation of a series with itself `lag` points later; null without variance."""
    s = _series(points, keys, at, value)
    pair = s.select(*keys, "n", F.explode_outer(F.when(F.col("n") > lag, F.arrays_zip(F.slice("p", F.lit(1), F.col("n").cast("int") - lag).alias("a"), F.slice("p", F.lit(lag + 1), F.col("n").cast("int") - lag).alias("b")))).alias("z"))
    x, y = F.col("z.a.v"), F.col("z.b.v")
    agg = pair.groupBy(*keys, "n").agg(F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("xy"))
    return agg.select(*keys, "n", F.when((F.col("vx") > 0) & (F.col("vy") > 0), half_up(F.col("xy") / F.sqrt(F.col("vx") * F.col("vy")))).alias("strength"))


def seasonality(points: DataFrame, keys: list[str], at: str, value: str, periods=PERIODS) -> DataFrame:
    """The period, of those given, with the greatest autocorrelation of 0.6 or more; the shortest wins ties."""
    s = _series(points, keys, at, value)
    gaps = F.transform(F.slice("p", F.lit(2), F.greatest(F.col("n").cast("int") - 1, F.lit(0))), lambda x, i: days_between(x["at"], F.get(F.col("p"), i)["at"]))
    s = s.withColumn("gaps", F.array_sort(gaps))
    mid = (F.get(F.col("gaps"), F.floor((F.size("gaps") - 1) / 2).cast("int")) + F.get(F.col("gaps"), F.floor(F.size("gaps") / 2).cast("int"))) / 2
    s = s.withColumn("interval", mid).withColumn("regular", F.forall("gaps", lambda g: F.abs(g - F.col("interval")) <= 0.2 * F.col("interval")))
    s = s.withColumn("lags", F.array(*[F.rint(F.lit(float(p)) / F.col("interval")).cast("int") for p in periods]))

    def corr(lag):
        m = F.col("n").cast("int") - lag
        xs, ys = F.transform(F.slice("p", F.lit(1), m), lambda e: e["v"]), F.transform(F.slice("p", lag + 1, m), lambda e: e["v"])
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / m
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
        mx, my = mean(xs), mean(ys)
        xy = total(F.zip_with(xs, ys, lambda a, b: (a - mx) * (b - my)))
        xx, yy = total(F.transform(xs, lambda a: (a - mx) * (a - mx))), total(F.transform(ys, lambda b: (b - my) * (b - my)))
        return F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))

    found = F.transform(F.filter("lags", lambda g: (g >= 2) & (F.col("n") >= 3 * g)), lambda g: F.struct(corr(g).alias("r"), (-g).alias("order")))
    s = s.withColumn("best", F.when((F.col("n") >= 12) & F.col("regular"), F.array_max(F.filter(found, lambda e: e["r"].isNotNull()))))
    status = (
        F.when(F.col("n") < 12, "insufficient_history").when(~F.col("regular"), "irregular_sampling").when(F.col("best").isNull(), "insufficient_history")
        .when(F.col("best.r") < 0.6, "not_detected").otherwise("detected")
    )
    return s.select(*keys, "n", status.alias("status"), half_up(F.col("best.r")).alias("strength"), F.when(F.col("best.r") >= 0.6, F.rint(-F.col("best.order") * F.col("interval"))).cast("long").alias("period_days"))
