"""The registry that query modules fill: a name, a function, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054"
    p, b = f"({k}::double/{n})", f"(1+{z}*{z}/{n})"
    half = f"({z}*sqrt(({p}*(1-{p})+{z}*{z}/(4*{n}))/{n}))"
    mid = f"({p}+{z}*{z}/(2*{n}))"
    return f"round_even(greatest(0.0,({mid}-{half})/{b}),6)", f"round_even(least(1.0,({mid}+{half})/{b}),6)"
