"""Outcome classes, checked payloads, work queues, permissions, coverage, idempotent writes, reviews, audits and the summary of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import metrics, ops, writes
from evidentia.plans.registry import query, table
from evidentia.sources import ingest, normalize

STATUS = "CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 403 WHEN 4 THEN 429 WHEN 5 THEN 404 WHEN 6 THEN 500 WHEN 7 THEN 503 END"


@query(f"""WITH e AS (SELECT event_id, {STATUS} AS status FROM events)
 SELECT event_id, CASE WHEN status IN (403,429) THEN 'rate_limited' WHEN status>=500 OR status IS NULL THEN 'transient' WHEN status>=400 THEN 'permanent' ELSE 'ok' END AS outcome FROM e""")
def http_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", ingest.http_outcome(F.expr(STATUS)).alias("outcome"))


PAYLOAD = {"payload": "CASE event_id % 11 WHEN 1 THEN '[1]' WHEN 2 THEN '{broken' ELSE props END", "hashed": "CASE event_id % 7 WHEN 3 THEN 'other' ELSE CASE event_id % 11 WHEN 1 THEN '[1]' WHEN 2 THEN '{broken' ELSE props END END"}


@query(f"""WITH p AS (SELECT event_id, {PAYLOAD["payload"]} AS payload, sha256({PAYLOAD["hashed"]}) AS content_hash FROM events)
 SELECT event_id, CASE WHEN sha256(payload)<>content_hash THEN 'content_hash_mismatch' WHEN payload='{{broken' THEN 'invalid_json' WHEN payload='[1]' THEN 'payload_not_object' END AS error_class FROM p""")
def stored_payload_checks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "events").select("event_id", F.expr(PAYLOAD["payload"]).alias("payload"), F.sha2(F.expr(PAYLOAD["hashed"]), 256).alias("content_hash"))
    return ingest.verified_payload(p).select("event_id", "error_class")


SOURCE = {"enabled": "source <> 'error'", "policy_status": "CASE WHEN source = 'view' THEN 'pending' ELSE 'approved' END", "policy_version": "CASE WHEN length(source) > 5 THEN NULL ELSE 'v1' END", "storage": "CASE WHEN source = 'login' THEN 'unclear' ELSE 'allowed' END"}
columns = lambda x: ", ".join(f"{value} AS {name}" for name, value in x.items())


@query(f"""WITH s AS (SELECT source, {columns(SOURCE)} FROM (SELECT DISTINCT event_type AS source FROM events))
 SELECT event_type AS source, count(*)::bigint AS items FROM events WHERE event_type IN (SELECT source FROM s WHERE enabled AND policy_status='approved' AND policy_version IS NOT NULL AND storage='allowed') GROUP BY 1""")
def permitted_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items by source, of the sources whose policy permits to store them."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"))
    sources = e.distinct().selectExpr("source", *[f"{value} AS {name}" for name, value in SOURCE.items()])
    return ingest.permitted(e, sources, "storage").groupBy("source").agg(F.count(F.lit(1)).alias("items"))


JOB = {"job_id": "c_custkey", "active": "c_custkey % 4 <> 0", "due_day": "c_custkey * 37 % 400", "lease_day": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 400 END"}


@query(f"WITH j AS (SELECT {columns(JOB)} FROM customer) SELECT job_id, due_day::bigint AS due_day FROM j WHERE active AND due_day<=200 AND (lease_day IS NULL OR lease_day<200) ORDER BY due_day, job_id LIMIT 50")
def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty jobs that have been due longest and that nobody holds."""
    at = lambda c: F.timestamp_seconds(F.col(c) * 86_400)
    jobs = table(spark, sf, "customer").selectExpr(*[f"{value} AS {name}" for name, value in JOB.items()]).withColumns({"next_run_at": at("due_day"), "lease_until": at("lease_day")})
    return ops.due_jobs(jobs, F.timestamp_seconds(F.lit(200 * 86_400)), 50).select("job_id", F.col("due_day").cast("long").alias("due_day"))


@query(
    """WITH u AS (SELECT user_id, count(*) FILTER (event_type='purchase') AS done, count(*) FILTER (event_type IN ('purchase','click')) AS expected, count(*) FILTER (event_type='error') AS failed, user_id%5<>0 AS complete FROM events GROUP BY 1)
 SELECT user_id, CASE WHEN NOT complete THEN 'incomplete_collection' WHEN CASE WHEN expected=0 THEN 1.0 ELSE done::double/expected END < 0.5 THEN 'low_coverage' END AS coverage, CASE WHEN failed=0 THEN 'succeeded' WHEN done=0 THEN 'failed' ELSE 'partial' END AS status FROM u"""
)
def coverage_and_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    u = table(spark, sf, "events").groupBy("user_id").agg(kind("purchase").alias("done"), kind("purchase", "click").alias("expected"), kind("error").alias("failed"))
    covered = metrics.coverage_status(F.col("done"), F.col("expected"), F.col("user_id") % 5 != 0, 0.5, "low_coverage")
    return u.select("user_id", covered.alias("coverage"), ops.run_status(F.col("done"), F.col("failed")).alias("status"))


@query("SELECT o_orderkey AS external_key, CASE WHEN o_orderkey%3<>0 THEN 'created' WHEN o_orderkey%5=0 THEN 'conflict' ELSE 'existing' END AS action FROM orders")
def idempotent_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Cost entries under external keys: new, already there, or there with other data."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("external_key"), F.col("o_totalprice").cast("decimal(18,6)").alias("amount"), F.lit("USD").alias("currency"))
    incoming = o.withColumn("amount", F.when(F.col("external_key") % 5 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,6)"))
    return ops.get_or_create(o.where("external_key % 3 = 0"), incoming, "external_key").select("external_key", "action")


@query("SELECT DISTINCT 'r'||(event_id%90) AS repository FROM events WHERE event_id%8<>0 AND 'r'||(event_id%90) NOT IN (SELECT 'r'||(c_custkey%70) FROM customer WHERE c_custkey%2=0)")
def repositories_to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories that items name and that nothing is known of yet."""
    items = table(spark, sf, "events").select(F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("r"), F.col("event_id") % 90)).otherwise("").alias("repository"))
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("r"), F.col("c_custkey") % 70).alias("match_name"))
    return normalize.missing_repositories(items, known)


REVIEW = {
    "request_id": "event_id", "version": "event_id % 400", "decision": "CASE event_id % 7 WHEN 0 THEN 'investigate' WHEN 1 THEN 'validate' WHEN 2 THEN 'watch' WHEN 3 THEN 'reject' WHEN 4 THEN 'archive' WHEN 5 THEN 'maybe' END",
    "reviewer": "' user' || (user_id % 9) || ' '",
}


@query(
    f"""WITH q AS (SELECT {columns(REVIEW)}, epoch_us(ts)::bigint AS occurred_us FROM events), j AS (SELECT *, CASE WHEN version NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%4<>0) THEN 'version_not_found' WHEN decision IS NULL OR decision='maybe' THEN 'unsupported_decision' ELSE 'created' END AS outcome FROM q)
 SELECT 'audit' AS part, request_id, version::varchar AS target, trim(reviewer) AS actor, outcome AS said, occurred_us FROM j UNION ALL SELECT 'review', request_id, version::varchar, trim(reviewer), decision, occurred_us FROM j WHERE outcome='created'"""
)
def reviews_and_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of versions, and an audit row for every request."""
    q = table(spark, sf, "events").selectExpr(*[f"{value} AS {name}" for name, value in REVIEW.items()], "'' AS notes", "cast(ts AS timestamp) AS at")
    versions = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("version"))
    reviews, audit = writes.opportunity_reviews(q, versions, "version")
    a = audit.select(F.lit("audit").alias("part"), "request_id", "target", "actor", F.col("outcome").alias("said"), F.unix_micros("occurred_at").alias("occurred_us"))
    return a.unionByName(reviews.select(F.lit("review").alias("part"), "request_id", F.col("version").cast("string").alias("target"), F.col("reviewer").alias("actor"), F.col("decision").alias("said"), F.unix_micros("created_at").alias("occurred_us")))


@query(
    """WITH a AS (SELECT count(*) AS open_alert_count, count(*) FILTER (event_type='error') AS critical_alert_count, count(*) FILTER (event_type='click') AS warning_alert_count FROM events WHERE user_id%3=0),
 c AS (SELECT coalesce(sum(o_totalprice::decimal(18,6)) FILTER (o_orderdate>=DATE '1995-06-17'),0) AS daily, coalesce(sum(o_totalprice::decimal(18,6)) FILTER (o_orderdate>=DATE '1995-06-01'),0) AS monthly FROM orders WHERE o_custkey%7<>0 AND o_orderdate<TIMESTAMP '1995-06-17 12:00:00')
 SELECT open_alert_count::bigint AS open_alert_count, critical_alert_count::bigint AS critical_alert_count, warning_alert_count::bigint AS warning_alert_count, round(daily::double,2) AS daily_cost, round(monthly::double,2) AS monthly_cost,
  CASE WHEN daily>=1e12 OR monthly>=1000 THEN 'blocked' WHEN critical_alert_count>0 THEN 'attention' ELSE 'ok' END AS budget_status FROM a, c"""
)
def operations_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Open alerts, the day's and the month's cost, and whether budgets block more."""
    alerts = table(spark, sf, "events").select(F.when(F.col("user_id") % 3 == 0, "open").otherwise("resolved").alias("status"), F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "warning").otherwise("info").alias("severity"))
    costs = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("occurred_at"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_custkey") % 7 == 0, "EUR").otherwise("USD").alias("currency"))
    out = ops.operations_summary(alerts, costs, F.lit("1995-06-17 12:00:00").cast("timestamp"), 1e12, 1000.0)
    return out.select("open_alert_count", "critical_alert_count", "warning_alert_count", F.round(F.col("daily_cost").cast("double"), 2).alias("daily_cost"), F.round(F.col("monthly_cost").cast("double"), 2).alias("monthly_cost"), "budget_status")
