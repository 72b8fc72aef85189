"""Operations: costs, retention, alerts, source health, period reports, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.exprs import half_even, micros, ratio


def cost_by(costs: DataFrame, keys: list[str], at: str, amount: str, start: Column, end: Column) -> DataFrame:
    """Sum of decimal amounts within [start, end) by key."""
    inside = costs.where((F.col(at) >= start) & (F.col(at) < end))
    return inside.groupBy(*keys).agg(F.coalesce(F.sum(F.col(amount).cast("decimal(18,6)")), F.lit(0)).cast("double").alias("total"), F.count(F.lit(1)).alias("entries"))


def budget_guard(spent: Column, estimate: Column, budget: Column) -> Column:
    return F.when(spent + estimate > budget, "rejected").otherwise("allowed")


def retention(snapshots: DataFrame, as_of: Column, apply: bool = False) -> DataFrame:
    """What a purge would take (dry run), or the snapshots after it with purged_at set and the payload gone."""
    due = (F.col("retention_until") < as_of) & F.col("purged_at").isNull()
    if not apply:
        return snapshots.where(due)
    gone = {"payload": F.when(due, F.lit(None)).otherwise(F.col("payload"))} if "payload" in snapshots.columns else {}
    return snapshots.withColumns({"purged_at": F.when(due, as_of).otherwise(F.col("purged_at")), **gone})


def source_alerts(health: DataFrame, as_of: Column, stale_hours: float = 24.0) -> DataFrame:
    """Alerts wanted for each source: key, kind, severity.

    health: source, last_status, last_success, quota_remaining, quota_limit, open_events, incomplete, expired.
    """
    age = (micros(as_of) - micros(F.col("last_success"))) / F.lit(3_600_000_000)
    cells = [
        ("run_failure", F.when(F.col("last_status") == "failed", "critical").when(F.col("last_status") == "partial", "warning")),
        ("never_succeeded", F.when(F.col("last_success").isNull(), "critical")),
        ("stale", F.when(age > stale_hours, "warning")),
        ("quality", F.when(F.col("open_events") > 0, "warning")),
        ("quota", F.when(F.col("quota_remaining") == 0, "critical").when(F.col("quota_remaining") <= 0.1 * F.col("quota_limit"), "warning")),
        ("incomplete_collections", F.when(F.col("incomplete") > 0, "warning")),
        ("retention_expired", F.when(F.col("expired") > 0, "warning")),
    ]
    alerts = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("severity")) for k, s in cells]), lambda x: x["severity"].isNotNull())
    return health.select("source", F.explode(alerts).alias("a")).select(F.concat_ws(":", "source", "a.kind").alias("alert_key"), "source", "a.kind", "a.severity")


def source_health(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs, successes, last success, error share and open events by source.

    runs: source, status, finished_at, errors, items; events: source, resolved.
    """
    r = runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.max(F.when(F.col("status") == "succeeded", F.col("finished_at"))).alias("last_success"),
        F.sum("errors").alias("errors"), F.sum("items").alias("items"),
    )
    e = events.groupBy("source").agg(F.count_if(~F.col("resolved")).alias("open_events"))
    out = r.join(e, "source", "left").withColumn("open_events", F.coalesce("open_events", F.lit(0)))
    return out.withColumn("error_share", half_even(ratio(F.col("errors"), F.col("items"))))


def run_status(n_ok: Column, n_failed: Column) -> Column:
    return F.when(n_failed == 0, "succeeded").when(n_ok == 0, "failed").otherwise("partial")


def next_fire(current: Column, minutes: int, now: Column) -> Column:
    """The least current + k * minutes after now."""
    step = minutes * 60_000_000
    passed = F.floor((micros(now) - micros(current)) / F.lit(step)) + 1
    return F.timestamp_micros(micros(current) + F.greatest(F.lit(0), passed) * step)


def due_jobs(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    free = F.col("lease_until").isNull() | (F.col("lease_until") < now)
    return jobs.where(F.col("active") & (F.col("next_run_at") <= now) & free).orderBy("next_run_at", "job_id").limit(limit)


def get_or_create(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Action by key: created, existing, or conflict where the stored row differs in any other column."""
    cols = [c for c in incoming.columns if c != key]
    e = existing.select(key, F.struct(*cols).alias("_old"), F.lit(True).alias("_known"))
    j = incoming.select(key, F.struct(*cols).alias("_new")).join(e, key, "left")
    action = F.when(F.col("_known").isNull(), "created").when(F.col("_old").eqNullSafe(F.col("_new")), "existing").otherwise("conflict")
    return j.select(key, action.alias("action"), "_new.*")


def append_if_changed(log: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(at))
    return log.withColumn("_p", prev).where(~F.col("_p").eqNullSafe(F.col(value)) | F.col("_p").isNull() & F.col(value).isNotNull()).drop("_p")


def theme_rollup(docs: DataFrame, theme: str, entity: str, evidence: str, id_col: str, top: int = 5, examples: int = 3) -> DataFrame:
    """Themes by documents, entities and evidence, with their first examples; the first `top`."""
    agg = docs.groupBy(theme).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(entity).alias("entities"), F.sum(evidence).cast("long").alias("evidence"))
    first = Window.partitionBy(theme).orderBy(id_col)
    shown = docs.select(theme, id_col).distinct().withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= examples)
    named = shown.groupBy(theme).agg(F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), ",").alias("examples"))
    agg = agg.join(named, theme)
    strong = (F.col("documents") >= 3) & (F.col("entities") >= 2) & (F.col("evidence") >= 3)
    return agg.withColumn("verdict", F.when(strong, "weak_signal").otherwise("insufficient")).orderBy(F.col("documents").desc(), F.col("entities").desc(), F.col("evidence").desc(), theme).limit(top)


def export_rows(df: DataFrame, key: str) -> DataFrame:
    """Each row as JSON with its digest and an idempotency key; write it with df.write.json."""
    body = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(F.col(key).cast("string").alias("export_key"), body.alias("payload")).withColumn("payload_sha256", F.sha2("payload", 256))


def operations_summary(alerts: DataFrame, costs: DataFrame, now: Column, daily_budget: float, monthly_budget: float, currency: str = "USD") -> DataFrame:
    """One row: open alerts by severity, what the day and the month have cost so far, and whether that blocks more.

    alerts: status, severity; costs: occurred_at, amount, currency. A budget of nought sets no limit; a spent one
    blocks, else an open critical alert asks for attention.
    """
    open_ = alerts.where(F.col("status") == "open").agg(
        F.count(F.lit(1)).alias("open_alert_count"), F.count_if(F.col("severity") == "critical").alias("critical_alert_count"), F.count_if(F.col("severity") == "warning").alias("warning_alert_count")
    )
    spent = lambda unit: F.coalesce(F.sum(F.when(F.col("occurred_at") >= F.date_trunc(unit, now), F.col("amount").cast("decimal(18,6)"))), F.lit(0)).cast("decimal(28,6)")
    sums = costs.where((F.col("currency") == currency) & (F.col("occurred_at") < now)).agg(spent("day").alias("daily_cost"), spent("month").alias("monthly_cost"))
    over = lambda cost, budget: F.lit(budget > 0) & (F.col(cost) >= F.lit(budget))
    status = F.when(over("daily_cost", daily_budget) | over("monthly_cost", monthly_budget), "blocked").when(F.col("critical_alert_count") > 0, "attention").otherwise("ok")
    return open_.join(F.broadcast(sums)).withColumn("budget_status", status)  # one row each
