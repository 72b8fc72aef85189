"""Writes, reviews, collections and checked values over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import values
from evidentia.operators import claims, decisions, metrics, writes
from evidentia.plans.registry import query, table

us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
I = "event_id"


def events(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    """Events with columns given as expressions that Spark and SQL share."""
    return table(spark, sf, "events").selectExpr("*", *[f"{x} AS {name}" for name, x in columns.items()])


def sql(**columns: str) -> str:
    return "SELECT *, " + ", ".join(f"{x} AS {name}" for name, x in columns.items()) + " FROM events"


PAGE = {
    "page": f"{I} % 12 + 1", "per_page": "100", "items": f"CASE WHEN {I} % 9 = 0 THEN 0 ELSE {I} % 101 END",
    "expected_total": f"CASE {I} % 5 WHEN 0 THEN 150 WHEN 1 THEN 1500 WHEN 2 THEN 900 WHEN 3 THEN 0 END", "incomplete": f"{I} % 17 = 0",
}


@query(
    f"""WITH p AS ({sql(**PAGE)}), q AS (SELECT event_id, page, items, expected_total, incomplete, (page-1)*100+items >= least(expected_total,1000) AS done FROM p WHERE expected_total IS NOT NULL),
 r AS (SELECT *, CASE WHEN incomplete THEN 'incomplete_search_results' WHEN expected_total>1000 AND done THEN 'search_result_cap' WHEN items=0 AND NOT done THEN 'unexpected_empty_page' END AS reason FROM q)
 SELECT event_id, CASE WHEN reason IS NULL THEN 'succeeded' ELSE 'partial' END AS status, reason, CASE WHEN incomplete THEN page WHEN NOT done AND reason IS NULL THEN page+1 END::bigint AS next_page,
  done AND expected_total<=1000 AND NOT incomplete AS is_complete, incomplete OR reason IS NULL AS resume_available FROM r"""
)
def collection_pages(spark: SparkSession, sf: str) -> DataFrame:
    """How each page of a search ends, and why a collection is not complete."""
    out = writes.page_outcome(events(spark, sf, **PAGE).where("expected_total is not null"))
    return out.select("event_id", "status", "reason", F.col("next_page").cast("long").alias("next_page"), "is_complete", "resume_available")


@query(f"""WITH p AS ({sql(**PAGE)}), l AS (SELECT event_id, user_id, expected_total, last_value(expected_total IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_total FROM p)
 SELECT event_id, previous_total::bigint AS previous_total, expected_total::bigint AS expected_total FROM l WHERE expected_total IS NOT NULL AND previous_total IS NOT NULL AND expected_total<>previous_total""")
def expected_total_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = writes.total_changes(events(spark, sf, **PAGE), ["user_id"], ["ts", I])
    return c.select("event_id", F.col("previous_total").cast("long").alias("previous_total"), F.col("expected_total").cast("long").alias("expected_total"))


@query("""WITH s AS (SELECT user_id AS external_id, 'e'||user_id AS entity_id, CASE WHEN user_id%9=0 THEN 'package' ELSE 'repository' END AS entity_type, min(ts) AS first_seen FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1),
 o AS (SELECT user_id%3 AS source, user_id AS external_id, min(ts) AS f, max(ts) AS l, arg_max(event_id, ts) AS u FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY 1,2)
 SELECT o.source, o.external_id, coalesce(s.entity_id, o.source||':'||o.external_id) AS entity_id, epoch_us(coalesce(first_seen,f))::bigint AS first_us, epoch_us(l)::bigint AS last_us, 'u'||u AS url,
  CASE WHEN s.entity_type<>'repository' THEN 'entity_mapping_type_mismatch' END AS error, s.entity_id IS NULL AS created FROM o LEFT JOIN s ON s.external_id=o.external_id""")
def entity_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Sightings of external ids against the entities known before."""
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("source"), F.col("user_id").alias("external_id"), F.lit("repository").alias("entity_type"), F.col("ts").alias("observed_at"), F.concat(F.lit("u"), I).alias("url"))
    cut = F.lit("2024-01-03").cast("timestamp")
    old = e.where(F.col("observed_at") < cut).groupBy("source", "external_id").agg(F.min("observed_at").alias("first_seen"))
    old = old.select("*", F.concat(F.lit("e"), "external_id").alias("entity_id"), F.when(F.col("external_id") % 9 == 0, "package").otherwise("repository").alias("entity_type"))
    m = writes.entity_map(e.where(F.col("observed_at") >= cut), ["source", "external_id"], old)
    return m.select("source", "external_id", "entity_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "url", "error", "created")


LINK = {"target": f"'r' || ({I} % 3)", "status": f"CASE WHEN {I} % 4 = 0 THEN 'confirmed' ELSE 'candidate' END"}


@query(f"""WITH l AS ({sql(**LINK)}), n AS (SELECT user_id, arg_max(target, struct_pack(t:=ts,e:=event_id)) AS t FROM l GROUP BY 1)
 SELECT event_id, l.user_id, target, CASE WHEN status='candidate' AND target<>n.t THEN 'superseded' ELSE status END AS status FROM l JOIN n ON n.user_id=l.user_id""")
def candidate_links(spark: SparkSession, sf: str) -> DataFrame:
    return writes.supersede_candidates(events(spark, sf, **LINK), "user_id", "target", ["ts", I]).select("event_id", "user_id", "target", "status")


REVIEW = {
    "status": f"CASE {I} % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' ELSE 'pending' END", "new_status": f"CASE {I} % 7 WHEN 0 THEN 'maybe' WHEN 1 THEN 'rejected' WHEN 2 THEN 'rejected' ELSE 'verified' END",
    "created_by": "'User' || (user_id % 10)", "reviewer": f"'USER' || ({I} % 10)",
}


@query(f"""WITH r AS ({sql(**REVIEW)}), a AS (SELECT *, CASE WHEN new_status NOT IN ('verified','rejected') THEN 'invalid_status' WHEN lower(reviewer)=lower(created_by) THEN 'reviewer_is_creator' WHEN status=new_status THEN 'unchanged' WHEN status<>'pending' THEN 'already_final' ELSE 'applied' END AS action FROM r)
 SELECT event_id, action, CASE WHEN action='applied' THEN new_status ELSE status END AS after FROM a""")
def outcome_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return writes.reviewed(events(spark, sf, **REVIEW)).select("event_id", "action", "after")


CLOSE = {"status": f"CASE {I} % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'cancelled' END", "new_status": f"CASE {I} % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'cancelled' ELSE 'completed' END", "shift": f"{I} % 4 - 1"}


@query(f"""WITH r AS ({sql(**CLOSE)}), t AS (SELECT *, ts AS started_at, CASE WHEN status<>'running' THEN ts + INTERVAL 1 DAY END AS ended_at, ts + to_days(shift::int) AS new_end FROM r)
 SELECT event_id, CASE WHEN new_status NOT IN ('completed','cancelled') THEN 'invalid_status' WHEN new_end<started_at THEN 'ends_before_start' WHEN new_end > TIMESTAMP '2024-01-30 00:05:00' THEN 'ends_in_future'
  WHEN status<>'running' AND status=new_status AND ended_at=new_end THEN 'unchanged' WHEN status<>'running' THEN 'already_closed' ELSE 'closed' END AS action FROM t""")
def experiment_close(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf, **CLOSE).withColumn("started_at", F.col("ts").cast("timestamp"))
    e = e.withColumns({"ended_at": F.when(F.col("status") != "running", F.col("started_at") + F.expr("INTERVAL 1 DAY")), "new_end": F.expr("started_at + make_dt_interval(cast(shift as int))")})
    return writes.closed(e, F.lit("2024-01-30").cast("timestamp")).select("event_id", "action")


@query("SELECT DISTINCT least(o_custkey%50, o_orderkey%50) AS low, greatest(o_custkey%50, o_orderkey%50) AS high FROM orders WHERE o_custkey%50<>o_orderkey%50")
def source_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Declared relations of two sources, whichever way round."""
    return writes.unordered_pairs(table(spark, sf, "orders").selectExpr("o_custkey % 50 AS a", "o_orderkey % 50 AS b"), "a", "b").select("low", "high")


@query("SELECT o_orderkey, CASE WHEN o_orderkey%3=0 AND o_custkey%4=0 THEN 'repository_not_resolved' WHEN o_orderkey%3=0 THEN 'confirmed' ELSE 'rejected' END AS action FROM orders")
def link_reviews(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS repository_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'confirmed' ELSE 'rejected' END AS decision")
    return writes.link_review(o).select("o_orderkey", "action")


@query("WITH i AS (SELECT sha256(props) AS h FROM events WHERE event_id%2=1), s AS (SELECT DISTINCT sha256(props) AS h FROM events WHERE event_id%20=0) SELECT h AS content_hash, count(*)::bigint AS n FROM (SELECT DISTINCT h FROM i WHERE h NOT IN (SELECT h FROM s)) GROUP BY 1")
def put_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that a store does not have yet, each once."""
    e = table(spark, sf, "events").withColumn("content_hash", F.sha2("props", 256))
    return writes.put_if_absent(e.where("event_id % 20 = 0").select("content_hash").distinct(), e.where("event_id % 2 = 1").select("content_hash")).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, epoch_us(CASE WHEN event_id%3=0 THEN TIMESTAMP '2025-01-01' WHEN user_id%5<>4 THEN ts + to_days((10*(user_id%5))::int) END)::bigint AS retention_us FROM events")
def retention_backfill(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 == 0, F.lit("2025-01-01").cast("timestamp")).alias("retention_until"))
    policies = spark.createDataFrame([(s, 10 * s) for s in range(4)], "source long, retention_days int")
    return writes.backfill_retention(e, policies, "source", "ts").select("event_id", us("retention_until").alias("retention_us"))


@query("WITH f AS (SELECT user_id AS snapshot_id, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1) SELECT snapshot_id, event_id FROM f WHERE snapshot_id%6<>0")
def observations_once(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("snapshot_id"), F.col("ts").alias("observed_at"), "event_id")
    return writes.append_unique(e, e.where("snapshot_id % 6 = 0").select("snapshot_id").distinct(), "snapshot_id").select("snapshot_id", "event_id")


@query("""WITH o AS (SELECT user_id AS cluster, event_type AS metric, date_trunc('day', ts) AS as_of, ts AS finished_at, event_id AS run_id, value FROM events)
 SELECT cluster, metric, epoch_us(as_of)::bigint AS as_of_us, arg_max(run_id, struct_pack(t:=finished_at,r:=run_id)) AS run_id FROM o GROUP BY cluster, metric, as_of""")
def last_metric_values(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("cluster"), F.col("event_type").alias("metric"), F.date_trunc("day", "ts").alias("as_of"), F.col("ts").alias("finished_at"), F.col("event_id").alias("run_id"))
    return metrics.last_per_metric(e, ["cluster"]).select("cluster", "metric", us("as_of").alias("as_of_us"), "run_id")


LEVELS_SQL = "CASE event_id%50 WHEN 0 THEN 'E2' WHEN 1 THEN 'unverified_cross_source' WHEN 2 THEN 'E1' ELSE 'unknown' END"


@query(f"""SELECT user_id, CASE WHEN bool_or(l='E2') THEN 'E2' WHEN bool_or(l='unverified_cross_source') THEN 'unverified_cross_source' WHEN bool_or(l='E1') THEN 'E1' ELSE 'unknown' END AS level FROM (SELECT user_id, {LEVELS_SQL} AS l FROM events) GROUP BY 1""")
def evidence_level_of_group(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr("user_id", f"{LEVELS_SQL} AS l")
    return e.groupBy("user_id").agg(F.collect_set("l").alias("ls")).select("user_id", metrics.evidence_level(F.col("ls")).alias("level"))


@query(r"""SELECT c_custkey, epoch_us(TIMESTAMP '2024-01-01' + to_days((c_custkey%400)::int))::bigint//1000000 AS first_s, epoch_us(TIMESTAMP '2024-01-01' + to_days((c_custkey%400)::int))::bigint//1000000+86399 AS last_s,
 '@scope/'||replace(c_name,'#','%23')||'%20x' AS path, CASE WHEN c_custkey%2=0 THEN lower('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11') END AS uuid, CASE WHEN c_custkey%3<>0 THEN round(c_acctbal,2) END::double AS number,
 'say '||c_mktsegment||' now' AS line, CASE WHEN c_acctbal<=0 THEN 'amount_not_positive' WHEN c_custkey%5=0 THEN 'currency_not_iso' END AS money_error, CASE WHEN c_acctbal>0 AND c_custkey%5<>0 THEN 'USD' END AS currency,
 CASE WHEN c_custkey%7=0 THEN 'new' ELSE 'old' END||',kept' AS merged, c_custkey%4=0 AS frame, CASE WHEN c_custkey%6=0 THEN 'invalid_count' END AS count_error FROM customer""")
def checked_values(spark: SparkSession, sf: str) -> DataFrame:
    """Dates, paths, identifiers, numbers, money and merged objects, each checked."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int"))
    cash = values.money(F.col("c_acctbal"), F.when(k % 5 == 0, F.lit("dollars")).otherwise(F.lit(" usd ")), required=True)
    new = F.when(k % 7 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    both = values.merged(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")), new)
    return table(spark, sf, "customer").select(
        "c_custkey", values.day_bounds(day)["first"].alias("first_s"), values.day_bounds(day)["last"].alias("last_s"), values.package_path(F.concat(F.lit("@scope/"), "c_name", F.lit(" x"))).alias("path"),
        values.uuid_or_null(F.when(k % 2 == 0, F.lit("A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11")).otherwise(F.lit("no-uuid"))).alias("uuid"),
        values.decimal_or_null(F.when(k % 3 != 0, F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string")).otherwise(F.lit("n/a"))).cast("double").alias("number"),
        values.one_line(F.concat(F.lit('  say\n"'), "c_mktsegment", F.lit('"\t now '))).alias("line"), cash["error"].alias("money_error"), cash["currency"].alias("currency"),
        F.concat_ws(",", both["a"], both["b"]).alias("merged"), values.sampling_frame(F.when(k % 4 == 0, F.lit(" REPO:a/b ")).otherwise(F.lit("repo:a/b bug"))).alias("frame"),
        values.count_or_error(F.when(k % 6 == 0, F.lit("true")).otherwise(k.cast("string")), "count")["error"].alias("count_error"),
    )


TYPES = (*claims.CLAIM_TYPES, "recurring_problem", "rumour")
CLAIM = {
    "claim": "o_orderkey", "cluster": "o_orderkey % 2", "claim_type": "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END",
    "statement": "CASE WHEN o_orderkey % 29 = 0 THEN '  ' ELSE o_orderpriority END", "created_by": "'user' || (o_custkey % 7)", "status": "CASE WHEN o_orderstatus = 'P' THEN 'approved' ELSE 'pending_review' END",
}
LINKS = {"claim": "l_orderkey", "kind": "CASE WHEN l_linenumber % 3 = 0 THEN 'commercial' ELSE 'evidence' END", "target": "CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey ELSE l_partkey END", "direction": "CASE WHEN l_returnflag = 'R' THEN 'refutes' ELSE 'supports' END"}
OUTCOMES = {"outcome": "s_suppkey", "outcome_type": "CASE s_suppkey % 6 WHEN 0 THEN 'sale' WHEN 1 THEN 'contract' WHEN 2 THEN 'interview' ELSE 'meeting' END", "direction": "CASE WHEN s_suppkey % 5 = 0 THEN 'refutes' ELSE 'supports' END"}
cols = lambda x: ", ".join(f"{v} AS {k}" for k, v in x.items())
PAID = "otype IN (" + ", ".join(f"'{x}'" for x in metrics.DIRECT_PAYMENT) + ") AND odir='supports'"
CLAIM_SQL = f"""c AS (SELECT {cols(CLAIM)} FROM orders), l AS (SELECT {cols(LINKS)} FROM lineitem), m AS (SELECT p_partkey%2 AS cluster, p_partkey AS evidence FROM part UNION SELECT 1-p_partkey%2, p_partkey FROM part WHERE p_partkey%10<8),
 o0 AS (SELECT {cols(OUTCOMES)} FROM supplier), o AS (SELECT outcome, outcome_type AS otype, direction AS odir, k AS cluster FROM o0, (VALUES (0),(1)) t(k) WHERE k=outcome%2 OR outcome%7=0),
 co AS (SELECT x.claim, count(*) AS n_commercial, bool_or({PAID}) AS paid FROM (SELECT DISTINCT claim, target FROM l WHERE kind='commercial') x JOIN c ON c.claim=x.claim JOIN o ON o.outcome=x.target AND o.cluster=c.cluster GROUP BY 1)"""


def _claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pick = lambda name, x: table(spark, sf, name).selectExpr(*[f"{v} AS {k}" for k, v in x.items()])
    part, o = table(spark, sf, "part"), pick("supplier", OUTCOMES)
    members = part.selectExpr("p_partkey % 2 AS cluster", "p_partkey AS evidence").union(part.where("p_partkey % 10 < 8").selectExpr("1 - p_partkey % 2", "p_partkey"))
    both = o.withColumn("cluster", F.explode(F.array(F.lit(0), F.lit(1)))).where("cluster = outcome % 2 or outcome % 7 = 0")
    return pick("orders", CLAIM), pick("lineitem", LINKS), members, both


@query(f"""WITH {CLAIM_SQL}, e AS (SELECT claim, target, bool_or(direction='supports') AS s, bool_or(direction='refutes') AS r FROM l WHERE kind='evidence' GROUP BY 1, 2),
 x AS (SELECT e.claim, bool_or(s AND r) AS both_sides, bool_or(m.evidence IS NULL) AS outside, count(*) FILTER (s) AS n_support FROM e JOIN c ON c.claim=e.claim LEFT JOIN m ON m.cluster=c.cluster AND m.evidence=e.target GROUP BY 1)
 SELECT c.claim, coalesce(n_support,0) AS n_support, coalesce(n_commercial,0) AS n_commercial, CASE WHEN claim_type NOT IN ({", ".join(f"'{t}'" for t in claims.CLAIM_TYPES)}) THEN 'unsupported_claim_type' WHEN trim(statement)='' THEN 'missing_statement' WHEN both_sides THEN 'evidence_on_both_sides'
  WHEN outside THEN 'evidence_outside_cluster' WHEN coalesce(n_support,0)=0 AND coalesce(n_commercial,0)=0 THEN 'no_evidence' WHEN claim_type='payment_reason' AND NOT coalesce(paid,false) THEN 'payment_not_direct' ELSE 'pending_review' END AS action
 FROM c LEFT JOIN x ON x.claim=c.claim LEFT JOIN co ON co.claim=c.claim""")
def claim_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return claims.proposals(*_claims(spark, sf)).drop("fingerprint")


REVIEWS = {"claim": "o_orderkey", "reviewer": "'user' || (o_orderkey % 7)", "decision": "CASE o_orderkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'later' ELSE 'approved' END"}


@query(f"""WITH {CLAIM_SQL}, r AS (SELECT {cols(REVIEWS)} FROM orders), d AS (SELECT claim, bool_or(direction='supports') AS s, bool_or(direction='refutes') AS n FROM l GROUP BY 1)
 SELECT r.claim, CASE WHEN reviewer=created_by THEN 'reviewer_is_creator' WHEN decision NOT IN ('approved','rejected') THEN 'unsupported_decision' WHEN status<>'pending_review' THEN 'not_pending' WHEN decision='approved' AND NOT coalesce(s,false) THEN 'no_support'
  WHEN decision='approved' AND coalesce(n,false) THEN 'counter_evidence' WHEN decision='approved' AND claim_type='payment_reason' AND NOT coalesce(paid,false) THEN 'payment_not_direct' ELSE decision END AS action
 FROM r JOIN c ON c.claim=r.claim LEFT JOIN d ON d.claim=r.claim LEFT JOIN co ON co.claim=r.claim""")
def claim_approvals(spark: SparkSession, sf: str) -> DataFrame:
    c, links, _, outcomes = _claims(spark, sf)
    reviews = table(spark, sf, "orders").selectExpr(*[f"{v} AS {k}" for k, v in REVIEWS.items()])
    return claims.approvals(c, links, outcomes, reviews)


PARTS = {
    "candidate": f"{I} % 40 + 40 * (user_id % 3)", "component": f"CASE {I} % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(decisions.COMPONENTS)) + " END",
    "claim_type": f"CASE {I} % 10 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(decisions.COMPONENTS.values())) + " END", "direction": "CASE WHEN user_id % 29 = 0 AND event_type = 'error' THEN 'refutes' ELSE 'supports' END",
    "is_current": f"{I} % 97 <> 0", "approved": f"{I} % 3 <> 0", "deterministic": f"{I} % 3 = 0",
}


@query(f"""WITH p AS (SELECT {cols(PARTS)} FROM events), g AS (SELECT candidate, component, bool_and(is_current) AS cur, bool_or(direction='supports') AS s, bool_or(direction='refutes') AS r, bool_and(approved OR deterministic) AS ap FROM p GROUP BY 1, 2)
 SELECT candidate, count(*) FILTER (cur AND s AND NOT r AND ap) AS n_valid, count(*) AS n_components, count(*) FILTER (cur AND s AND NOT r AND ap)=10 AND count(*)=10 AS complete FROM g GROUP BY 1""")
def candidate_components(spark: SparkSession, sf: str) -> DataFrame:
    """Which candidates have all ten components, each with a current, supported, unrefuted and approved claim."""
    links = table(spark, sf, "events").selectExpr(*[f"{v} AS {k}" for k, v in PARTS.items()])
    return decisions.materialise_candidates(links, decisions.COMPONENTS).select("candidate", "n_valid", "n_components", "complete")
