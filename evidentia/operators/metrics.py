"""Tidy metrics with gates: a value only where the sample carries it, numerator and denominator always."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.exprs import days_between, half_even, ratio, wilson


@dataclass(frozen=True)
class MetricSpec:
    """One metric of a wide row: columns of its numerator, denominator and sample, and the least sample.

    The value is their ratio, or the numerator itself where `plain` says so; `gate` names a column with a
    reason of the metric's own, which comes after the sample's size.
    """

    key: str
    numerator: str
    denominator: str | None
    sample: str
    least: int
    interval: bool = False
    plain: bool = False
    gate: str | None = None


def tidy(wide: DataFrame, entity: str, specs: list[MetricSpec], blocked: Column | None = None) -> DataFrame:
    """A row for each entity and metric: numerator, denominator, sample, status, and value and interval if measured.

    `blocked` names a reason that holds for the whole row, or is null; it comes before the sample's size.
    """
    cells = [
        F.struct(
            F.lit(s.key).alias("metric"), F.col(s.numerator).cast("double").alias("numerator"), (F.col(s.denominator) if s.denominator else F.lit(None)).cast("double").alias("denominator"),
            F.col(s.sample).cast("long").alias("sample_size"), F.lit(s.least).alias("least"), F.lit(s.interval).alias("interval"), F.lit(s.plain).alias("plain"),
            (F.col(s.gate) if s.gate else F.lit(None)).cast("string").alias("gate"),
        )
        for s in specs
    ]
    rows = wide.select(F.col(entity).alias("entity"), (F.lit(None).cast("string") if blocked is None else blocked).alias("reason"), F.explode(F.array(*cells)).alias("c")).select("entity", "reason", "c.*")
    status = F.coalesce("reason", F.when(F.coalesce(F.col("sample_size"), F.lit(0)) < F.col("least"), "insufficient_sample"), "gate", F.lit("measured"))
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "measured"
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    return rows.select(
        "entity", "metric", "numerator", "denominator", "sample_size", "status",
        F.when(ok, half_even(F.when(F.col("plain"), F.col("numerator")).otherwise(ratio(F.col("numerator"), F.col("denominator"))))).alias("value"),
        F.when(ok & F.col("interval"), low).alias("ci_low"), F.when(ok & F.col("interval"), high).alias("ci_high"),
    )


# Labels of a bug, kinds of evidence and outcomes that pay.
BUG_LABELS = ("bug", "crash", "defect", "error", "regression")
ISSUE_EVIDENCE = ("severe_impact", "workaround", "missing_capability", "payment_intent", "abandonment_intent", "time_impact", "money_impact")
ECONOMIC = ("money_impact", "time_impact", "severe_impact")
DIRECT_PAYMENT = ("prepayment", "contract", "sale", "renewal")

REPOSITORY_SPECS = [
    MetricSpec("eligible_issue_count", "n_issues", None, "n_issues", 1, plain=True),
    MetricSpec("pull_request_share", "n_pulls", "n_items", "n_items", 20, True),
    MetricSpec("bug_label_ratio", "n_bugs", "n_issues", "n_issues", 20, True),
    MetricSpec("open_issue_ratio", "n_open", "n_issues", "n_issues", 20, True),
    MetricSpec("mean_issue_comments", "n_comments", "n_issues", "n_issues", 20),
    MetricSpec("issue_creation_rate_30d", "n_recent", "days", "n_issues", 10),
    MetricSpec("median_resolution_days", "median_days", "n_resolved", "n_resolved", 10, plain=True),
    *[MetricSpec(f"{kind}_issue_ratio", f"n_{kind}", "n_issues", "n_issues", 20, True) for kind in ISSUE_EVIDENCE],
]

CLUSTER_SPECS = [
    MetricSpec("problem_mention_rate", "n_documents", "all_documents", "all_documents", 20, True),
    MetricSpec("problem_entity_spread", "n_entities", "all_entities", "all_entities", 5, True),
    MetricSpec("workaround_rate", "n_workaround", "n_documents", "n_documents", 5, True),
    MetricSpec("switching_intent_rate", "n_switching", "n_documents", "n_documents", 5, True),
    MetricSpec("economic_impact_rate", "n_economic", "n_documents", "n_documents", 5, True),
    MetricSpec("payment_intent_rate", "n_payment", "n_documents", "n_documents", 5, True),
    MetricSpec("independent_demand_signal_rate", "n_demand", "n_documents", "n_documents", 5, True, gate="independence"),
    MetricSpec("direct_payment_evidence_rate", "n_paying", "n_verified", "n_verified", 1, True),
    MetricSpec("unresolved_problem_median_age_days", "median_age", "n_unresolved", "n_unresolved", 5, plain=True),
]


def evidence_types(evidence: DataFrame, key: str = "document_id") -> DataFrame:
    """The set of evidence types of each document; there are no more than a few types."""
    return evidence.groupBy(key).agg(F.sort_array(F.collect_set("evidence_type")).alias("types"))


def repository_metrics(documents: DataFrame, types: DataFrame, as_of: Column, blocked: Column | None = None) -> DataFrame:
    """The fourteen metrics of each entity, in one pass over its documents.

    documents: document_id, entity_id, item_type, state, labels, comments, created_at, closed_at, is_bot;
    types: document_id, types.
    """
    d = documents.where(~F.coalesce(F.col("is_bot"), F.lit(False)) & F.col("entity_id").isNotNull() & (F.col("created_at") <= as_of)).join(types, "document_id", "left")
    issue = F.col("item_type") == "issue"
    low = F.transform("labels", F.lower)
    bug = F.coalesce(F.arrays_overlap(low, F.array(*map(F.lit, BUG_LABELS))), F.lit(False))
    age = days_between(F.col("closed_at"), F.col("created_at"))
    recent = F.col("created_at") >= as_of - F.expr("INTERVAL 30 DAYS")
    has = lambda kind: F.coalesce(F.array_contains("types", kind), F.lit(False))
    resolved = issue & (age >= 0)
    wide = d.groupBy("entity_id").agg(
        F.count_if(issue).alias("n_issues"), F.count_if(F.col("item_type") == "pull_request").alias("n_pulls"), F.count_if(issue & bug).alias("n_bugs"),
        F.count_if(issue & (F.col("state") == "open")).alias("n_open"), F.coalesce(F.sum(F.when(issue, F.greatest(F.coalesce("comments", F.lit(0)), F.lit(0)))), F.lit(0)).alias("n_comments"),
        F.count_if(issue & recent).alias("n_recent"), F.median(F.when(resolved, age)).alias("median_days"), F.count(F.when(resolved, age)).alias("n_resolved"),
        *[F.count_if(issue & has(kind)).alias(f"n_{kind}") for kind in ISSUE_EVIDENCE],
    ).withColumns({"n_items": F.col("n_issues") + F.col("n_pulls"), "days": F.lit(30)})
    return tidy(wide, "entity_id", REPOSITORY_SPECS, blocked)


def cluster_metrics(members: DataFrame, documents: DataFrame, types: DataFrame, demand_sources: DataFrame, outcomes: DataFrame, levels: DataFrame, run_at: Column) -> DataFrame:
    """The nine metrics of each cluster of problems.

    members: cluster, document_id, entity_id, source; documents: document_id, state, created_at; types:
    document_id, types; demand_sources: source; outcomes: cluster, participant, outcome_type, direction,
    verified_at (null if not verified); levels: cluster, level. The time of the metrics is that of the last
    verified outcome, else of the run.
    """
    verified = outcomes.where("verified_at is not null")
    as_of = verified.agg(F.coalesce(F.max("verified_at"), run_at).alias("as_of"))
    demand = demand_sources.select("source").distinct().withColumn("demand", F.lit(True))
    m = members.join(documents, "document_id").join(types, "document_id", "left").join(demand, "source", "left")
    totals = members.agg(F.count_distinct("document_id").alias("all_documents"), F.count_distinct("entity_id").alias("all_entities"))
    m = m.join(F.broadcast(as_of)).join(F.broadcast(totals))  # one row each
    has = lambda *kinds: F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, kinds))), F.lit(False))
    age = F.when(F.col("state").isin("open", "unresolved"), F.greatest(F.lit(0.0), days_between(F.col("as_of"), F.col("created_at"))))
    wide = m.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_distinct("entity_id").alias("n_entities"), F.max("all_documents").alias("all_documents"), F.max("all_entities").alias("all_entities"),
        F.count_if(has("workaround")).alias("n_workaround"), F.count_if(has("abandonment_intent")).alias("n_switching"), F.count_if(has(*ECONOMIC)).alias("n_economic"),
        F.count_if(has("payment_intent")).alias("n_payment"), F.count_if(F.coalesce("demand", F.lit(False))).alias("n_demand"), F.median(age).alias("median_age"), F.count(age).alias("n_unresolved"),
    )
    pays = (F.col("direction") == "supports") & F.col("outcome_type").isin(*DIRECT_PAYMENT)
    paid = verified.groupBy("cluster").agg(F.count_distinct("participant").alias("n_verified"), F.count_distinct(F.when(pays, F.col("participant"))).alias("n_paying"))
    wide = wide.join(paid, "cluster", "left").na.fill(0, ["n_verified", "n_paying"]).join(levels.select("cluster", "level"), "cluster", "left")
    wide = wide.withColumn("independence", F.when(F.coalesce("level", F.lit("unknown")) != "E2", "unverified_source_independence"))
    structure = F.when(F.col("n_documents") <= 1, "insufficient_repetition").when(F.col("n_entities") <= 1, "insufficient_entity_spread")
    return tidy(wide, "cluster", CLUSTER_SPECS, structure)


def evidence_level(levels: Column) -> Column:
    """The strongest of an array of levels: E2, then unverified_cross_source, then E1, else unknown."""
    rank = F.lit("unknown")
    for name in ("E1", "unverified_cross_source", "E2"):
        rank = F.when(F.array_contains(levels, name), F.lit(name)).otherwise(rank)
    return rank


def last_per_metric(observations: DataFrame, keys: list[str]) -> DataFrame:
    """The observation of the latest finished run for each key, metric and as_of."""
    w = Window.partitionBy(*keys, "metric", "as_of").orderBy(F.col("finished_at").desc(), F.col("run_id").desc())
    return observations.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def period_change(series: DataFrame, keys: list[str], at: str, value: str, status: str) -> DataFrame:
    """Change against the last measured value before: absolute, relative, direction or the reason for none."""
    w = Window.partitionBy(*keys).orderBy(at)
    measured = F.col(status) == "measured"
    out = series.withColumn("baseline", F.last(F.when(measured, F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    known = measured & F.col("baseline").isNotNull()
    change = F.col(value) - F.col("baseline")
    return out.withColumns(
        {
            "signal_status": F.when(~measured, F.col(status)).when(F.col("baseline").isNull(), F.lit("insufficient_history")).otherwise("measured"),
            "absolute_change": F.when(known, half_even(change)),
            "relative_change": F.when(known, half_even(ratio(change, F.abs("baseline")))),
            "direction": F.when(known, F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")),
        }
    )


def coverage_status(n_done: Column, n_expected: Column, complete: Column, least: float, reason: str) -> Column:
    """incomplete_collection, or the given reason where too few of what is expected is done; null if neither."""
    share = F.when(n_expected == 0, F.lit(1.0)).otherwise(n_done / n_expected)
    return F.when(~complete, F.lit("incomplete_collection")).when(share < least, F.lit(reason))
