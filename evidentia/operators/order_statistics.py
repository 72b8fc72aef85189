"""Exact order statistics of groups of any size.

Spark's own median keeps every distinct value of a group in one state. Here a group of more than `limit` values is
narrowed instead: a mergeable sketch brackets the wanted ranks, the values below and inside the bracket are counted,
both summed before anything is shuffled, and what lies inside is narrowed again until it is one value or few enough
to sort. The sketch only proposes brackets, the counts decide, so the result is exact whatever the sketch's error. A
round leaves a hundredth or less of the rows in a bracket. Brackets are a few rows for each group of more than `limit`
values and are broadcast, so that the rows stay where they are read and no task gets a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.session import checkpoint

LIMIT = 1 << 16
#: half the width of a bracket as a share of the values in the last one, and the sketch's accuracy
MARGIN = 0.003
ACCURACY = 1000


def _same(keys: list[str]) -> Column:
    """Keys of both sides equal; null is a key like any."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"x.{k}").eqNullSafe(F.col(f"s.{k}"))
    return out


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    joined = rows.alias("x").join(F.broadcast(state).alias("s"), _same(keys))
    return joined.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select(*[F.col(f"x.{k}") for k in keys], "v", "rank", "low", "high", "inside")


def order_values(rows: DataFrame, wanted: DataFrame, keys: list[str], limit: int = LIMIT, margin: float = MARGIN) -> DataFrame:
    """keys, rank, value: the values of the wanted ranks, counted from 0 in order of value.

    rows: keys, v (double, not null); wanted: keys, rank, low, high, inside: the ranks, the range of their groups'
    values and the number of values in it. NaN is greater than any number, as Spark has it.
    """
    found, state = [], wanted.withColumn("first", F.col("rank"))
    name = [*keys, "first"]
    while True:
        state = checkpoint(state)
        narrow = state.where((F.col("inside") <= limit) | (F.col("low") == F.col("high")))
        found.append(narrow)
        state = state.where((F.col("inside") > limit) & (F.col("low") != F.col("high")))
        if state.isEmpty():
            break
        held = _inside(rows, state.withColumn("rank", F.struct("rank", "first")), keys).select(*keys, "v", "rank.rank", "rank.first", "low", "high", "inside")
        # the quantiles of the last bracket between which the wanted rank should lie
        ends = held.groupBy(*name).agg(F.percentile_approx("v", [i / 200 for i in range(201)], ACCURACY).alias("q"), F.first("rank").alias("rank"), F.first("inside").alias("inside"), F.first("low").alias("low"), F.first("high").alias("high"))
        at = F.col("rank") / F.col("inside")
        pick = lambda share: F.get("q", F.least(F.greatest(share * 200, F.lit(0.0)), F.lit(200.0)).cast("int"))
        ends = ends.withColumns({"from": pick(F.floor((at - margin) * 200) / 200), "to": pick(F.ceil((at + margin) * 200) / 200)}).drop("q", "rank", "inside")
        both = held.drop("low", "high", "inside").alias("x").join(F.broadcast(ends).alias("s"), _same(name)).select(*[F.col(f"x.{k}") for k in name], F.col("x.rank").alias("rank"), "v", "low", "high", "from", "to")
        below, within = F.col("v") < F.col("from"), (F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to"))
        sums = both.groupBy(*name).agg(
            F.first("rank").alias("rank"), F.count_if(below).alias("below"), F.count_if(within).alias("within"), F.count(F.lit(1)).alias("all"), F.max(F.when(below, F.col("v"))).alias("under"), F.min(F.when(F.col("v") > F.col("to"), F.col("v"))).alias("over"),
            F.first("low").alias("low"), F.first("high").alias("high"), F.first("from").alias("from"), F.first("to").alias("to"),
        )
        # where the sketch was wrong, the rest on the side where the rank is
        left, middle = F.col("rank") < F.col("below"), F.col("rank") < F.col("below") + F.col("within")
        state = sums.select(
            *name, F.when(left, F.col("rank")).when(middle, F.col("rank") - F.col("below")).otherwise(F.col("rank") - F.col("below") - F.col("within")).alias("rank"),
            F.when(left, F.col("low")).when(middle, F.col("from")).otherwise(F.col("over")).alias("low"), F.when(left, F.col("under")).when(middle, F.col("to")).otherwise(F.col("high")).alias("high"),
            F.when(left, F.col("below")).when(middle, F.col("within")).otherwise(F.col("all") - F.col("below") - F.col("within")).alias("inside"),
        )
    out = None
    for narrow in found:
        one = narrow.where("low = high").select(*keys, F.col("first").alias("rank"), F.col("low").alias("value"))
        few = _inside(rows, narrow.where("low <> high").withColumn("rank", F.struct("rank", "first")), keys).select(*keys, "v", "rank.rank", "rank.first")
        few = few.groupBy(*name).agg(F.get(F.sort_array(F.collect_list("v")), F.first("rank").cast("int")).alias("value")).select(*keys, F.col("first").alias("rank"), "value")
        both = one.unionByName(few)
        out = both if out is None else out.unionByName(both)
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, quantiles: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """keys and a column for each named quantile, interpolated between its two neighbours; null values don't count.

    Groups of up to `limit` values are left to Spark's own percentile, whose state they bound.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count("v").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
    large = checkpoint(sizes.where(F.col("inside") > limit))
    plain = lambda r: r.groupBy(*keys).agg(*[F.percentile("v", p).alias(name) for name, p in quantiles.items()])
    if large.isEmpty():
        return plain(rows)
    filled = rows.where("v is not null")
    ends = large.withColumn("p", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("inside") - 1)).alias("place")) for name, p in quantiles.items()])))
    ends = ends.withColumns({"under": F.floor("p.place").cast("long"), "over": F.ceil("p.place").cast("long")})
    ranks = ends.select(*keys, F.explode(F.array("under", "over")).alias("rank"), "low", "high", "inside").distinct()
    values = checkpoint(order_values(filled, ranks, keys, limit))
    a, b = values.withColumnsRenamed({"rank": "under", "value": "a"}), values.withColumnsRenamed({"rank": "over", "value": "b"})
    for side, by in ((a, "under"), (b, "over")):
        ends = ends.alias("x").join(side.alias("s"), _same([*keys, by])).select("x.*", f"s.{'a' if by == 'under' else 'b'}")
    share = F.col("p.place") - F.col("under")
    mixed = F.when(F.col("under") == F.col("over"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    wide = ends.select(*keys, "p.name", mixed.alias("value")).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles])
    if not keys:
        return wide
    return plain(rows.alias("x").join(F.broadcast(large).alias("s"), _same(keys), "left_anti")).unionByName(wide)


def exact_median(df: DataFrame, keys: list[str], value: str | Column, out: str, limit: int = LIMIT) -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5}, limit)
