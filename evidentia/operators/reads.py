"""Lists as a reader asks for them: optional filters, sorted and cut, and nested reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(df: DataFrame, equals: dict | None = None, conditions: list[Column] | None = None, order: list | None = None, limit: int = 100) -> DataFrame:
    """Rows that meet every filter that is given, in order; a filter of None is left out. A limit is 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    for name, value in (equals or {}).items():
        df = df if value is None else df.where(F.col(name) == value)
    for condition in conditions or []:
        df = df.where(condition)
    return (df.orderBy(*order) if order else df).limit(limit)


def any_pair(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose columns equal one of the pairs' rows."""
    return df.join(pairs.distinct(), pairs.columns, "left_semi")


def first_values(df: DataFrame, key: str, value: str, top: int = 5) -> DataFrame:
    """The first distinct values of each key in order, joined by commas; no key's values are gathered beyond `top`."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(value))
    kept = df.select(key, value).where(F.col(value).isNotNull()).distinct().withColumn("_nth", nth).where(F.col("_nth") <= top)
    return kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("firsts"))


def directions(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Whether the links of two lists, taken together, support and refute each key."""
    both = first.select(key, "direction").unionByName(second.select(key, "direction"))
    return both.groupBy(key).agg(F.bool_or(F.col("direction") == "supports").alias("supported"), F.bool_or(F.col("direction") == "refutes").alias("refuted"), F.count(F.lit(1)).alias("links"))


def dossier(links: DataFrame, most: int = 50) -> DataFrame:
    """One JSON text for each candidate: its components in order, and of each the claims and the first pieces of evidence.

    links: candidate, component, claim, evidence. A component shows `most` pieces, so no candidate grows without bound.
    """
    per = Window.partitionBy("candidate", "component").orderBy("claim", "evidence")
    shown = links.withColumn("_nth", F.row_number().over(per)).where(F.col("_nth") <= most)
    evidence = shown.groupBy("candidate", "component").agg(F.array_sort(F.collect_list(F.struct("claim", "evidence"))).alias("evidence"))
    n = links.groupBy("candidate", "component").agg(F.count_distinct("claim").alias("claims"))
    parts = n.join(evidence, ["candidate", "component"]).groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("component", "claims", "evidence"))).alias("components"))
    return parts.select("candidate", F.to_json(F.struct("candidate", "components")).alias("dossier"))


def period_report(candidates: DataFrame, clusters: DataFrame, outcomes: DataFrame, alerts: DataFrame, costs: DataFrame, scores: DataFrame, top: int = 10) -> DataFrame:
    """(item, value) of a period, whose rows the first three and the costs are: counts, costs by currency, and the ids of the best scores.

    clusters: cluster; alerts: critical; costs: currency, amount; scores: id, score, of the latest run.
    """
    one = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("item"), "value")
    n = F.count(F.lit(1))
    out = one(candidates, "new_candidates", n).unionByName(one(clusters, "new_clusters", F.count_distinct("cluster"))).unionByName(one(outcomes, "verified_outcomes", n))
    out = out.unionByName(one(alerts, "open_alerts", n)).unionByName(one(alerts, "critical_alerts", F.count_if("critical")))
    spent = costs.groupBy("currency").agg(F.sum(F.col("amount").cast("decimal(18,6)")).cast("double").alias("value")).select(F.concat(F.lit("cost:"), "currency").alias("item"), "value")
    best = scores.orderBy(F.col("score").desc_nulls_last(), "id").limit(top)
    place = F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "id"))  # of no more than `top` rows
    return out.unionByName(spent).unionByName(best.select(F.concat(F.lit("top:"), place.cast("string")).alias("item"), F.col("id").cast("double").alias("value")))


def report_json(df: DataFrame) -> DataFrame:
    """Each row as one line of JSON, keys in order of name; write it with df.write.text."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
