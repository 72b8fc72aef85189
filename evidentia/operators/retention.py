"""A purge that applies: snapshots stored by the day their retention ends, so that only those days are rewritten."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import materialise

DAY = "retention_day"
NEVER = "9999-12-31"


@dataclass(frozen=True)
class Purge:
    """What a purge looked at and did; `rewritten` names the days whose files are new."""

    considered: int
    purged: int
    missing: int
    errors: int
    rewritten: tuple[str, ...]
    applied: bool


def store(snapshots: DataFrame, path: str) -> None:
    """Append snapshots (retention_until, purged_at, payload and more) under the day of their retention's end."""
    day = F.coalesce(F.date_format("retention_until", "yyyy-MM-dd"), F.lit(NEVER))
    snapshots.withColumn(DAY, day).write.mode("append").partitionBy(DAY).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema.add(DAY, "string") if DAY not in schema.names else schema).parquet(path).withColumn(DAY, F.col(DAY).cast("string"))


def due(snapshots: DataFrame, as_of: datetime) -> DataFrame:
    """Snapshots whose retention ended before a moment and that were not purged; older days only are read."""
    at = F.lit(as_of).cast("timestamp")
    return snapshots.where((F.col(DAY) <= F.date_format(at, "yyyy-MM-dd")) & (F.col("retention_until") < at) & F.col("purged_at").isNull())


def purge(spark: SparkSession, path: str, as_of: datetime, apply: bool = False) -> Purge:
    """Count what is due, and with `apply` take its payload and set purged_at.

    The days that hold something due are read, changed and put back by dynamic overwrite: other days keep their
    files. A snapshot whose payload was gone already is purged and counted as missing; one whose retention can't
    be told from its day (it moved without its row) is left and counted as an error. A second purge of the same
    moment finds nothing.
    """
    at = F.lit(as_of).cast("timestamp")
    found = due(stored(spark, path), as_of)
    moved = F.col(DAY) != F.date_format("retention_until", "yyyy-MM-dd")
    counts = found.groupBy(DAY).agg(F.count(F.lit(1)).alias("n"), F.count_if(~moved & F.col("payload").isNull()).alias("missing"), F.count_if(moved).alias("moved")).orderBy(DAY).collect()
    n, missing, errors = (sum(r[c] for r in counts) for c in ("n", "missing", "moved"))
    days = [r[DAY] for r in counts if r["n"] > r["moved"]]
    if not apply or not days:
        return Purge(n, 0, 0, 0 if not apply else errors, (), apply)
    hit = (F.col("retention_until") < at) & F.col("purged_at").isNull() & ~moved
    rows = stored(spark, path).where(F.col(DAY).isin(days))
    changed = rows.withColumns({"payload": F.when(hit, F.lit(None)).otherwise(F.col("payload")), "purged_at": F.when(hit, at).otherwise(F.col("purged_at"))})
    # a table can't be read and overwritten at once: the changed days are written aside first
    materialise(changed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return Purge(n, n - errors, missing, errors, tuple(days), True)
