"""What a write does to stored rows: new rows, conflicts, reviews and state changes, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def put_if_absent(stored: DataFrame, incoming: DataFrame, key: str = "content_hash") -> DataFrame:
    """The incoming rows whose content is not stored yet, one for each content; append them to the store."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(incoming.columns)


def entity_map(observed: DataFrame, keys: list[str], stored: DataFrame) -> DataFrame:
    """External ids to entities: a known id keeps its entity, a new one makes one; the last sighting moves on.

    observed: keys, entity_type, observed_at, url; stored: keys, entity_id, entity_type, first_seen. A new
    entity is named by its key. An id whose stored entity is of another type is an error.
    """
    last = observed.groupBy(*keys).agg(F.min("observed_at").alias("seen_from"), F.max("observed_at").alias("last_seen"), F.max_by(F.struct("entity_type", "url"), "observed_at").alias("o"))
    known = stored.select(*keys, F.col("entity_id").alias("_id"), F.col("entity_type").alias("_type"), F.col("first_seen").alias("_first"))
    j = last.join(known, keys, "left")
    return j.select(
        *keys, F.coalesce("_id", F.concat_ws(":", *[F.col(k).cast("string") for k in keys])).alias("entity_id"), F.coalesce("_first", "seen_from").alias("first_seen"), "last_seen",
        F.col("o.url").alias("url"), F.when(F.col("_type") != F.col("o.entity_type"), "entity_mapping_type_mismatch").alias("error"), F.col("_id").isNull().alias("created"),
    )


def supersede_candidates(links: DataFrame, key: str, target: str, at: list[str]) -> DataFrame:
    """Links of each key with their status: those to another target than the newest one's are superseded, if only candidates."""
    newest = links.groupBy(key).agg(F.max_by(target, F.struct(*at)).alias("_target"))
    j = links.join(newest, key)
    old = (F.col("status") == "candidate") & (F.col(target) != F.col("_target"))
    return j.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("_target")


def reviewed(rows: DataFrame, allowed=("verified", "rejected")) -> DataFrame:
    """What a review by a second person does: rows have status, created_by, reviewer and new_status; adds `action` and `after`."""
    action = (
        F.when(~F.col("new_status").isin(*allowed), "invalid_status").when(F.lower("reviewer") == F.lower("created_by"), "reviewer_is_creator")
        .when(F.col("status") == F.col("new_status"), "unchanged").when(F.col("status") != "pending", "already_final").otherwise("applied")
    )
    return rows.withColumn("action", action).withColumn("after", F.when(F.col("action") == "applied", F.col("new_status")).otherwise(F.col("status")))


def closed(rows: DataFrame, now: Column) -> DataFrame:
    """What closing an experiment does: rows have status, started_at, ended_at, new_status and new_end; adds `action`."""
    final = F.col("status").isin("completed", "cancelled")
    same = (F.col("status") == F.col("new_status")) & (F.col("ended_at") == F.col("new_end"))
    action = (
        F.when(~F.col("new_status").isin("completed", "cancelled"), "invalid_status").when(F.col("new_end") < F.col("started_at"), "ends_before_start")
        .when(F.col("new_end") > now + F.expr("INTERVAL 5 MINUTES"), "ends_in_future").when(final & F.coalesce(same, F.lit(False)), "unchanged").when(final, "already_closed").otherwise("closed")
    )
    return rows.withColumn("action", action)


def unordered_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of pairs under one key whichever way round they are declared; the first of each stays, a pair with itself goes."""
    pair = rows.where(F.col(a) != F.col(b)).withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})
    return pair.dropDuplicates(["low", "high"])


def link_review(rows: DataFrame) -> DataFrame:
    """A link may be confirmed only if its repository is resolved: rows have repository_id and decision; adds `action`."""
    return rows.withColumn("action", F.when((F.col("decision") == "confirmed") & F.col("repository_id").isNull(), "repository_not_resolved").otherwise(F.col("decision")))


def backfill_retention(rows: DataFrame, policies: DataFrame, key: str, at: str) -> DataFrame:
    """Rows without a retention date get the one of their policy's days; an update from a join."""
    due = F.col(at) + F.make_dt_interval(F.col("retention_days"))
    return rows.join(policies.select(key, "retention_days"), key, "left").withColumn("retention_until", F.coalesce("retention_until", due)).drop("retention_days")


def append_unique(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Observations of snapshots that have none yet, one for each: the first by observed_at."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "observed_at").alias("_r")).select("_r.*")
    return first.join(stored.select(key), key, "left_anti").select(rows.columns)


def page_outcome(pages: DataFrame, cap: int = 1000) -> DataFrame:
    """Status, reason and next page of each page of a search: page, per_page, items, expected_total, incomplete."""
    reach = F.least(F.col("expected_total"), F.lit(cap))
    done = (F.col("page") - 1) * F.col("per_page") + F.col("items") >= reach
    capped = F.col("expected_total") > cap
    reason = F.when(F.col("incomplete"), "incomplete_search_results").when(capped & done, "search_result_cap").when((F.col("items") == 0) & ~done, "unexpected_empty_page")
    follow = F.when(F.col("incomplete"), F.col("page")).when(~done & reason.isNull(), F.col("page") + 1)
    return pages.withColumns(
        {"status": F.when(reason.isNull(), "succeeded").otherwise("partial"), "reason": reason, "next_page": follow, "is_complete": done & ~capped & ~F.col("incomplete"),
         "resume_available": F.col("incomplete") | reason.isNull()}
    )


def total_changes(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Pages whose expected total differs from the last known one of their collection."""
    before = F.last("expected_total", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("previous_total", before).where(F.col("expected_total").isNotNull() & F.col("previous_total").isNotNull() & (F.col("expected_total") != F.col("previous_total")))


OPPORTUNITY_DECISIONS = ("investigate", "validate", "watch", "reject", "archive")


def opportunity_reviews(requests: DataFrame, versions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(reviews to append, audit rows of all requests).

    requests: request_id, key, decision, reviewer, notes, at; a version may be reviewed again and again. An audit row
    tells what was asked for and how it ended, also where nothing was written.
    """
    known = versions.select(key).distinct().withColumn("_known", F.lit(True))
    outcome = F.when(F.col("_known").isNull(), "version_not_found").when(~F.coalesce(F.col("decision").isin(*OPPORTUNITY_DECISIONS), F.lit(False)), "unsupported_decision").otherwise("created")
    judged = requests.join(known, key, "left").withColumn("outcome", outcome).drop("_known")
    reviews = judged.where("outcome = 'created'").select("request_id", key, "decision", F.trim("reviewer").alias("reviewer"), F.trim("notes").alias("notes"), F.col("at").alias("created_at"))
    audit = judged.select("request_id", F.lit("opportunity_review").alias("action"), F.col(key).cast("string").alias("target"), F.trim("reviewer").alias("actor"), "outcome", F.col("at").alias("occurred_at"))
    return reviews, audit
