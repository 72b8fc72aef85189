"""Taking in raw records: routing, deduplication with re-observations, schema profiles and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route(items: DataFrame, longest: int = 256) -> DataFrame:
    """reject_reason of each item, null if valid: external_type, external_id and payload (JSON text) are looked at."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    payload = F.try_parse_json("payload")
    reason = (
        F.when(blank("external_type"), "missing_external_type").when(blank("external_id"), "missing_external_id")
        .when((F.length("external_type") > longest) | (F.length("external_id") > longest), "identity_field_too_long")
        .when(F.col("payload").isNull() | F.trim("payload").isin("", "{}", "[]", "null"), "empty_payload").when(payload.isNull(), "non_json_payload")
    )
    return items.withColumn("reject_reason", reason)


def timestamp_flags(created: Column, updated: Column, observed: Column) -> Column:
    day = F.expr("INTERVAL 1 DAY")
    return F.array_compact(F.array(F.when(created > observed + day, "created_in_future"), F.when(updated > observed + day, "updated_in_future"), F.when(updated < created, "updated_before_created")))


def dedup(items: DataFrame, stored: DataFrame, keys=("source", "external_type", "external_id", "content_hash")) -> tuple[DataFrame, DataFrame]:
    """(snapshots to add, observations of all items with is_duplicate).

    The first item of a key by (observed_at, item_id) is new unless the key is stored; the others observe it again.
    """
    keys = list(keys)
    first = items.groupBy(*keys).agg(F.min(F.struct("observed_at", "item_id")).alias("_first"))
    known = stored.select(*keys).distinct().withColumn("_stored", F.lit(True))
    marked = items.join(first, keys).join(known, keys, "left")
    dup = F.col("_stored").isNotNull() | (F.struct("observed_at", "item_id") != F.col("_first"))
    observed = marked.withColumn("is_duplicate", dup).drop("_first", "_stored")
    return observed.where(~F.col("is_duplicate")).drop("is_duplicate"), observed


def duplicate_ratio(observations: DataFrame, run: str, least: int = 10, most: float = 0.8) -> DataFrame:
    n = observations.groupBy(run).agg(F.count(F.lit(1)).alias("items"), F.count_if("is_duplicate").alias("duplicates"))
    return n.withColumn("flagged", (F.col("items") >= least) & (F.col("duplicates") >= most * F.col("items")))


def json_types(payload: Column) -> Column:
    """Map from each top-level key of a JSON object to its type's name."""
    names = F.json_object_keys(payload)
    one = lambda v: (
        F.when(v.isNull() | (v == "null"), "null").when(v.rlike(r"^\s*\{"), "object").when(v.rlike(r"^\s*\["), "array").when(v.isin("true", "false"), "boolean")
        .when(v.rlike(r"^-?[0-9]"), "number").otherwise("string")
    )
    values = F.from_json(payload, "map<string,string>")
    return F.map_from_arrays(names, F.transform(names, lambda k: one(F.try_element_at(values, k))))


def schema_profiles(items: DataFrame, keys: list[str], payload: str, at: str) -> DataFrame:
    """Distinct top-level schemas by key: fields as sorted name:type text, first and last seen, count."""
    fields = F.array_join(F.array_sort(F.transform(F.map_entries(json_types(F.col(payload))), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",")
    return items.withColumn("fields", fields).groupBy(*keys, "fields").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("items"))


def schema_drift(items: DataFrame, keys: list[str], payload: str, at: str, tie: str) -> DataFrame:
    """Fields added, removed or of another type against the item before; null fits any type; warning on a type."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    t = items.select(*keys, at, tie, json_types(F.col(payload)).alias("now")).withColumn("was", F.lag("now").over(w)).where("was is not null")
    now, was = F.map_keys("now"), F.map_keys("was")
    changed = F.filter(F.array_intersect(now, was), lambda k: (F.col("now")[k] != F.col("was")[k]) & (F.col("now")[k] != "null") & (F.col("was")[k] != "null"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    out = t.select(*keys, at, tie, text(F.array_except(now, was)).alias("added"), text(F.array_except(was, now)).alias("removed"), text(changed).alias("changed"))
    return out.where("added <> '' or removed <> '' or changed <> ''").withColumn("severity", F.when(F.col("changed") != "", "warning").otherwise("info"))


def verified_payload(items: DataFrame) -> DataFrame:
    """error_class of stored payloads: content_hash_mismatch, invalid_json, payload_not_object, or null."""
    parsed = F.try_parse_json("payload")
    error = (
        F.when(F.sha2(F.col("payload").cast("binary"), 256) != F.col("content_hash"), "content_hash_mismatch").when(parsed.isNull(), "invalid_json")
        .when(~F.trim("payload").startswith("{"), "payload_not_object")
    )
    return items.withColumn("error_class", error)


def http_outcome(status: Column) -> Column:
    return F.when(status.isin(403, 429), "rate_limited").when((status >= 500) | status.isNull(), "transient").when(status >= 400, "permanent").otherwise("ok")


def permitted(df: DataFrame, sources: DataFrame, permission: str) -> DataFrame:
    """Rows whose source is enabled, approved under a versioned policy and has the permission."""
    ok = sources.where(F.col("enabled") & (F.col("policy_status") == "approved") & F.col("policy_version").isNotNull() & F.col(permission).isin("allowed", "approved"))
    return df.join(ok.select("source"), "source", "left_semi")
