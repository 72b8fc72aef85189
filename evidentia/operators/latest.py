"""Latest rows, versions and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns; an aggregate, so that a hot key combines map-side."""
    whole = F.struct(*df.columns)
    top = df.groupBy(*[F.col(k) for k in keys]).agg(F.max_by(whole, F.struct(*order)).alias("_row"))
    return top.select("_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    top = df.groupBy(*[F.col(k) for k in keys]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return top.select("_row.*")


def versions(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Version number from 1, the id it supersedes, and whether it is current."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns(
        {"version_number": F.row_number().over(w).cast("long"), "supersedes": F.lag(id_col).over(w), "is_current": F.lead(id_col).over(w).isNull()}
    )


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """Each left row with the value of the latest right row of its keys at or before (or strictly before) it.

    Both sides are merged in one order and the last value carried on, so no pair of rows is ever formed.
    """
    ts = "_ts"
    lhs = left.select(*left.columns, F.col(left_ts).alias(ts), F.lit(1 if inclusive else 0).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(out), F.lit(None).cast("timestamp").alias(f"{out}_at"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields if f.name not in keys]
    rhs = right.select(*keys, *empty, F.col(right_ts).alias(ts), F.lit(0 if inclusive else 1).alias("_side"), F.col(value).alias(out), F.col(right_ts).cast("timestamp").alias(f"{out}_at"))
    both = lhs.withColumn("_left", F.lit(True)).unionByName(rhs.withColumn("_left", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(ts, "_side", out).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumns({out: F.last(out, ignorenulls=True).over(w), f"{out}_at": F.last(f"{out}_at", ignorenulls=True).over(w)})
    return carried.where("_left").drop(ts, "_side", "_left")


def full_merge_state(existing: DataFrame, desired: DataFrame, key: str, now: Column) -> DataFrame:
    """Alert states by key: opened, refreshed, re-opened (first seen anew) or resolved.

    existing: key, status, first_at, last_at; desired: key, severity.
    """
    e, d = existing.alias("e"), desired.alias("d")
    j = e.join(d, key, "full_outer")
    wanted, known = F.col("d.severity").isNotNull(), F.col("e.status").isNotNull()
    action = (
        F.when(wanted & ~known, "opened").when(wanted & (F.col("e.status") == "resolved"), "reopened").when(wanted, "refreshed")
        .when(F.col("e.status") == "open", "resolved").otherwise("unchanged")
    )
    fresh = action.isin("opened", "reopened")
    return j.select(
        key,
        action.alias("action"),
        F.when(wanted, "open").otherwise("resolved").alias("status"),
        F.when(fresh, now).otherwise(F.col("e.first_at")).alias("first_at"),
        F.when(action == "unchanged", F.col("e.last_at")).otherwise(now).alias("last_at"),
        F.col("d.severity").alias("severity"),
    )
