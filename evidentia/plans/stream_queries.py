"""Flows with state over the driver's events: as streams that run until all is taken, and as batch queries, against the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.plans.registry import query, table
from evidentia.session import fresh_dir
from evidentia.sources import ingest, paged
from evidentia.streaming import incremental, keyed, sink

DAY = 86_400_000_000
HOUR = 3_600_000_000
us = lambda *columns: [F.unix_micros(c).alias(f"{c}_us") for c in columns]


def _streamed(spark: SparkSession, sf: str, flow) -> DataFrame:
    """Events, written as a folder that a stream can read, through a flow, and the table that it leaves."""
    events, out, state = (fresh_dir(spark, name) for name in ("events", "stream", "state"))
    table(spark, sf, "events").write.parquet(events)
    incremental.run_available(flow(incremental.read_stream(spark, events, table(spark, sf, "events"))), out, state)
    return spark.read.parquet(out)


KEYS = ["source", "external_id"]
RETENTION_DAYS = 2


def _items(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("source"), F.col("user_id").alias("external_id"), F.col("event_id").alias("item"), F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("ts").alias("observed_at"))


SNAPSHOTS = f"""WITH e AS (SELECT event_type AS source, user_id AS external_id, event_id AS item, strftime(ts,'%Y-%m-%d') AS run, epoch_us(ts) AS moment FROM events),
 w AS (SELECT *, lag(moment) OVER (PARTITION BY source, external_id ORDER BY moment, item)+{RETENTION_DAYS * DAY} AS before, lead(moment) OVER (PARTITION BY source, external_id ORDER BY moment, item) AS next,
  row_number() OVER (PARTITION BY source, external_id, run ORDER BY moment, item)=1 AS counted, moment+{RETENTION_DAYS * DAY} AS until FROM e), m AS (SELECT (max(moment)-{HOUR})//1000 AS mark FROM e)
 SELECT source, external_id, CASE WHEN before IS NULL THEN 'new' WHEN before<moment THEN 'restored' ELSE 'duplicate' END AS event, item, run, moment::bigint AS at_us, until::bigint AS retention_until_us, counted FROM w
 UNION ALL SELECT source, external_id, 'purged', NULL, NULL, until::bigint, until::bigint, false FROM w, m WHERE next>until OR (next IS NULL AND (until+999)//1000<=mark)"""


@query(SNAPSHOTS)
def snapshot_history(spark: SparkSession, sf: str) -> DataFrame:
    """What each observation did to its snapshot: new, seen again with longer retention, restored; and the purges."""
    return keyed.snapshot_events(_items(table(spark, sf, "events")), KEYS, RETENTION_DAYS).select(*KEYS, "event", "item", "run", *us("at", "retention_until"), "counted")


@query(SNAPSHOTS)
def snapshot_history_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream with a state and a timer for each snapshot."""
    out = _streamed(spark, sf, lambda s: keyed.snapshot_stream(_items(s), KEYS, RETENTION_DAYS))
    return out.select(*KEYS, "event", "item", "run", *us("at", "retention_until"), "counted")


SILENCE_DAYS = 2


def _checks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("alert_key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("wanted"), F.when(F.col("value") >= 50, "critical").otherwise("warning").alias("severity"))


K = "PARTITION BY alert_key ORDER BY moment, seq"
ALERTS = f"""WITH c AS (SELECT user_id AS alert_key, epoch_us(ts) AS moment, event_id AS seq, event_type='error' AS wanted, CASE WHEN value>=50 THEN 'critical' ELSE 'warning' END AS severity FROM events),
 w AS (SELECT *, lag(moment) OVER ({K}) AS last_at, coalesce(lag(wanted) OVER ({K}), false) AS last_wanted, lag(severity) OVER ({K}) AS last_severity, lead(moment) OVER ({K}) AS next, coalesce(bool_or(wanted) OVER (PARTITION BY alert_key ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known
  FROM c),
 a AS (SELECT *, CASE WHEN wanted AND last_wanted AND last_at+{SILENCE_DAYS * DAY}>=moment THEN 'refreshed' WHEN wanted AND known THEN 'reopened' WHEN wanted THEN 'opened' WHEN last_wanted AND last_at+{SILENCE_DAYS * DAY}>=moment THEN 'resolved' END AS action FROM w),
 f AS (SELECT *, last_value(CASE WHEN action IN ('opened','reopened') THEN moment END IGNORE NULLS) OVER (PARTITION BY alert_key ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_at FROM a), m AS (SELECT (max(moment)-{HOUR})//1000 AS mark FROM c)
 SELECT alert_key, action, 'check' AS cause, moment::bigint AS at_us, first_at::bigint AS first_at_us, CASE WHEN wanted THEN severity ELSE last_severity END AS severity FROM f WHERE action IS NOT NULL
 UNION ALL SELECT alert_key, 'resolved', 'silence', (moment+{SILENCE_DAYS * DAY})::bigint, first_at::bigint, severity FROM f, m WHERE wanted AND (next>moment+{SILENCE_DAYS * DAY} OR (next IS NULL AND (moment+{SILENCE_DAYS * DAY}+999)//1000<=mark))"""


@query(ALERTS)
def alert_history(spark: SparkSession, sf: str) -> DataFrame:
    """How alerts open, are refreshed, resolve and open again, by checks and by silence."""
    return keyed.alert_events(_checks(table(spark, sf, "events")), "alert_key", f"{SILENCE_DAYS} days").select("alert_key", "action", "cause", *us("at", "first_at"), "severity")


@query(ALERTS)
def alert_history_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream with a state and a timer for each alert."""
    return _streamed(spark, sf, lambda s: keyed.alert_stream(_checks(s), "alert_key", f"{SILENCE_DAYS} days")).select("alert_key", "action", "cause", *us("at", "first_at"), "severity")


@query(
    """WITH e AS (SELECT strftime(ts,'%Y-%m-%d') AS cursor, event_id FROM events), p AS (SELECT cursor, count(*) AS items, sum(event_id)::bigint AS ids FROM e GROUP BY 1)
 SELECT 'day '||cursor AS cursor, 'day '||lead(cursor) OVER (ORDER BY cursor) AS next_cursor, lead(cursor) OVER (ORDER BY cursor) IS NULL AS is_complete, items::bigint AS items, ids FROM p"""
)
def paged_collection(spark: SparkSession, sf: str) -> DataFrame:
    """All events as stored pages, one a day, read by following the cursors; items as they were read."""
    e = table(spark, sf, "events").select(F.concat(F.lit("day "), F.date_format("ts", "yyyy-MM-dd")).alias("cursor"), F.col("event_id"))
    follow = Window.orderBy("cursor")
    days = e.select("cursor").distinct().withColumns({"next_cursor": F.lead("cursor").over(follow), "first": F.min("cursor").over(follow)})
    named = e.join(days, "cursor").select(
        "cursor", "next_cursor", F.col("next_cursor").isNull().alias("is_complete"), F.lit("succeeded").alias("status"), F.lit(None).cast("long").alias("expected_total"), F.lit(None).cast("int").alias("position"),
        F.to_json(F.struct("event_id")).alias("item"),
    )
    path = fresh_dir(spark, "pages")
    paged.store_pages(named, path)
    paged.register(spark)
    read = spark.read.format("pages").options(path=path, start=days.agg(F.min("first")).first()[0] or paged.START).load()
    items = read.where("kind = 'item'")
    return items.groupBy("cursor", "next_cursor", "is_complete").agg(F.count(F.lit(1)).alias("items"), F.sum(F.get_json_object("item", "$.event_id").cast("long")).alias("ids"))


PAGE_ROWS = {
    "kind": "CASE WHEN event_id % 13 = 0 THEN 'event' ELSE 'page' END", "status": "CASE event_id % 211 WHEN 1 THEN 'failed_permanent' WHEN 2 THEN 'failed_transient' WHEN 3 THEN 'rate_limited' ELSE 'succeeded' END",
    "is_complete": "event_id % 4 = 0", "position": "cast(event_id % 3 as int)", "detail": "CASE WHEN event_id % 299 = 0 THEN 'connector_exception:OSError' WHEN event_id % 169 = 0 THEN 'cursor_not_advancing:x' WHEN event_id % 13 = 0 THEN 'note' END",
}
PAGE_LIMIT = 60


@query(
    f"""WITH r AS (SELECT user_id, {", ".join(f"{x} AS {name}" for name, x in PAGE_ROWS.items())} FROM events),
 s AS (SELECT user_id, count(*) FILTER (kind='page') AS pages, coalesce(sum(position) FILTER (kind='page'),0) AS items, max(status) FILTER (kind='page' AND status<>'succeeded') AS failed,
  count(*) FILTER (kind='page' AND status<>'succeeded')+count(*) FILTER (kind='event' AND (detail LIKE 'cursor_not_advancing%' OR detail LIKE 'connector_exception%')) AS errors,
  count(*) FILTER (kind='page' AND status='succeeded' AND is_complete)>0 AS done, count(*) FILTER (kind='event' AND detail LIKE 'connector_exception%')>0 AS broken, count(*) FILTER (kind='event' AND detail LIKE 'cursor_not_advancing%')>0 AS stuck FROM r GROUP BY 1),
 t AS (SELECT *, CASE WHEN broken THEN CASE WHEN items>0 THEN 'partial' ELSE 'failed_transient' END WHEN failed IN ('failed_transient','failed_permanent') AND items>0 THEN 'partial' WHEN failed IS NOT NULL THEN failed
  WHEN stuck OR NOT done OR errors>0 THEN 'partial' ELSE 'succeeded' END AS status FROM s)
 SELECT user_id, status, CASE WHEN broken THEN 'connector_exception' WHEN failed IS NOT NULL THEN failed WHEN stuck THEN 'cursor_not_advancing' WHEN done THEN NULL WHEN pages>={PAGE_LIMIT} THEN 'page_limit' ELSE 'open' END AS reason,
  pages::bigint AS pages, items::bigint AS items, errors::bigint AS errors, status<>'succeeded' AND coalesce(failed,'')<>'failed_permanent' AS resume_available FROM t"""
)
def collection_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """How collections end, with every terminal reason."""
    rows = table(spark, sf, "events").selectExpr("user_id", *[f"{x} AS {name}" for name, x in PAGE_ROWS.items()])
    return paged.collection_outcome(rows, ["user_id"], PAGE_LIMIT)


ITEMS = {
    "external_type": "CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type END", "external_id": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(user_id as varchar(20)) END",
    "payload": "CASE WHEN event_id % 7 = 0 THEN '{}' WHEN event_id % 17 = 0 THEN '{broken' ELSE props END",
}


@query(
    f"""WITH i AS (SELECT event_id, {", ".join(f"{x} AS {name}" for name, x in ITEMS.items())} FROM events),
 o AS (SELECT event_id, CASE WHEN trim(external_type)='' THEN 'missing_external_type' WHEN external_id IS NULL THEN 'missing_external_id' WHEN payload IS NULL OR trim(payload) IN ('','{{}}','[]','null') THEN 'empty_payload'
  WHEN payload='{{broken' THEN 'non_json_payload' END AS error_class FROM i)
 SELECT 'item' AS part, event_id AS id, error_class FROM o UNION ALL SELECT 'batch', count(*), CASE WHEN count(error_class)=0 THEN 'succeeded' WHEN count(error_class)<count(*) THEN 'partial' ELSE 'failed_permanent' END FROM o"""
)
def exactly_once_items(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of items into the sink that commits rows, rejects and summary together; and the items again, without effect."""
    events, out, state, again = (fresh_dir(spark, name) for name in ("events", "sink", "state", "state"))
    table(spark, sf, "events").write.parquet(events)
    items = incremental.read_stream(spark, events, table(spark, sf, "events"), 1_000_000).selectExpr("event_id", *[f"{x} AS {name}" for name, x in ITEMS.items()])
    normalise = lambda rows: ingest.route(rows).withColumnRenamed("reject_reason", "error_class")
    for checkpoint in (state, again):
        sink.run_batches(items, normalise, out, checkpoint)
    done = sink.Commits(spark, out)
    kept = done.read(sink.ROWS).select(F.lit("item").alias("part"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("error_class"))
    failed = done.read(sink.REJECTS).select(F.lit("item").alias("part"), F.col("event_id").alias("id"), "error_class")
    return kept.unionByName(failed).unionByName(done.read(sink.SUMMARY).select(F.lit("batch").alias("part"), F.col("input_count").alias("id"), F.col("status").alias("error_class")))
