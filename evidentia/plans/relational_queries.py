"""Latest rows, as-of and set joins, filters, top-k, costs and operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.exprs import half_up, set_digest
from evidentia.operators import decisions, latest, ops
from evidentia.plans.registry import query, table

us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


@query("SELECT o_custkey, arg_max(o_orderkey, struct_pack(d:=o_orderdate,k:=o_orderkey)) AS o_orderkey, arg_max(o_totalprice, struct_pack(d:=o_orderdate,k:=o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return latest.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT source, arg_min(doc_id, struct_pack(a:=-n_chars,b:=doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1")
def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars", (-F.col("n_chars")).alias("neg"))
    return latest.first_per_key(d, ["source"], ["neg", "doc_id"]).select("source", "doc_id", "n_chars")


@query("""SELECT event_id, user_id, event_type, row_number() OVER w AS version_number, lag(event_id) OVER w AS supersedes, lead(event_id) OVER w IS NULL AS is_current
 FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def supersede_chain(spark: SparkSession, sf: str) -> DataFrame:
    v = latest.versions(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return v.select("event_id", "user_id", "event_type", "version_number", "supersedes", "is_current")


@query("""SELECT p.event_id, p.user_id, (SELECT max(epoch_us(c.ts)) FROM events c WHERE c.event_type='click' AND c.user_id=p.user_id AND c.ts < p.ts)::bigint AS click_us FROM events p WHERE p.event_type='purchase'""")
def as_of_previous_event(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the latest click of its user strictly before it."""
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    j = latest.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "click_ts", "click_id", "click", inclusive=False)
    return j.select("event_id", "user_id", us("click_at").alias("click_us"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)")
def pending_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND toxic=1) AS is_toxic FROM documents d")
def processed_flag_exists(spark: SparkSession, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "documents").join(toxic, "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("is_toxic"))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1) GROUP BY 1")
def semi_filter(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1")
    return table(spark, sf, "documents").join(good, "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(*) AS n, sum(round(l_extendedprice*100)::bigint)::bigint AS cents FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
 WHERE l_returnflag IN ('R','A') GROUP BY 1""")
def multiway_fact_join(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("R", "A")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))


@query("""WITH s AS (SELECT event_id, event_type, CASE WHEN event_id%3<>0 THEN ts + INTERVAL 10 DAY END AS until FROM events)
 SELECT event_type, count(*) AS kept FROM s WHERE until IS NULL OR until >= TIMESTAMP '2024-01-20' GROUP BY 1""")
def null_safe_retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").withColumn("until", F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")))
    return s.where(F.col("until").isNull() | (F.col("until") >= F.lit("2024-01-20").cast("timestamp"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_orderstatus='P' ORDER BY o_totalprice DESC NULLS LAST, c_custkey, o_orderkey LIMIT 25")
def top_k_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    j = table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "c_custkey", "o_orderkey").limit(25)


@query("""WITH p AS (SELECT source, CASE WHEN n_chars>=1000 THEN 0.9 ELSE 0.6 END AS p, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT (sum(y)+1)/(count(*)+2)::double AS b FROM p)
 SELECT source, count(*) AS evaluated, sum(y)::bigint AS positives, round(avg((p-y)*(p-y)::double),6) AS brier, round(avg((b-y)*(b-y)),6) AS baseline_brier,
  round(round(avg((b-y)*(b-y)),6)-round(avg((p-y)*(p-y)::double),6),6) AS improvement, CASE WHEN count(*)<20 THEN 'insufficient_sample' ELSE 'measured' END AS status FROM p, r GROUP BY source""")
def brier_backtest(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = j.select("source", F.when(F.col("n_chars") >= 1000, 0.9).otherwise(0.6).alias("p"), F.col("quality").alias("y"))
    base = p.agg(decisions.smoothed_rate(F.sum("y"), F.count(F.lit(1))).alias("base"))
    return decisions.backtest(p.join(F.broadcast(base)), F.col("base"), ["source"])  # base: one row


@query("""SELECT lang, count(DISTINCT doc_id) AS n, count(DISTINCT CASE WHEN toxic=1 THEN doc_id END) AS positives, round((count(DISTINCT CASE WHEN toxic=1 THEN doc_id END)+1)/(count(DISTINCT doc_id)+2)::double,6) AS rate
 FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def smoothed_base_rate(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("lang")
    g = j.agg(F.count_distinct("doc_id").alias("n"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("positives"))
    return g.withColumn("rate", half_up(decisions.smoothed_rate(F.col("positives"), F.col("n"))))


@query("""SELECT c_mktsegment AS currency, round(sum(l_extendedprice::decimal(18,6)),2)::double AS total, count(*) AS entries FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
 WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1""")
def cost_by_currency_window(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = lambda d: F.lit(d).cast("timestamp")
    out = ops.cost_by(j.withColumnRenamed("c_mktsegment", "currency"), ["currency"], "l_shipdate", "l_extendedprice", day("1995-01-01"), day("1996-01-01"))
    return out.withColumn("total", F.round("total", 2))


@query("""WITH t AS (SELECT max(ts) AS e FROM events) SELECT event_type, count(*) FILTER (ts > e - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (ts > e - INTERVAL 14 DAY AND ts <= e - INTERVAL 7 DAY) AS before_7d,
 count(DISTINCT CASE WHEN ts > e - INTERVAL 7 DAY THEN user_id END) AS users_7d FROM events, t GROUP BY 1""")
def period_report(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    j = e.join(F.broadcast(e.agg(F.max("ts").alias("e"))))  # one row
    week, two = F.col("e") - F.expr("INTERVAL 7 DAYS"), F.col("e") - F.expr("INTERVAL 14 DAYS")
    return j.groupBy("event_type").agg(
        F.count_if(F.col("ts") > week).alias("last_7d"), F.count_if((F.col("ts") > two) & (F.col("ts") <= week)).alias("before_7d"),
        F.count_distinct(F.when(F.col("ts") > week, F.col("user_id"))).alias("users_7d"),
    )


@query("""WITH e AS (SELECT 'u'||user_id AS alert_key, CASE WHEN user_id%3=0 THEN 'resolved' ELSE 'open' END AS status, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type='error' GROUP BY user_id),
 d AS (SELECT 'u'||user_id AS alert_key, CASE WHEN count(*)>=3 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type='error' GROUP BY user_id),
 j AS (SELECT coalesce(e.alert_key,d.alert_key) AS alert_key, e.status AS old, first_at, last_at, severity, CASE WHEN severity IS NOT NULL AND e.status IS NULL THEN 'opened' WHEN severity IS NOT NULL AND e.status='resolved' THEN 'reopened'
  WHEN severity IS NOT NULL THEN 'refreshed' WHEN e.status='open' THEN 'resolved' ELSE 'unchanged' END AS action FROM e FULL JOIN d ON e.alert_key=d.alert_key)
 SELECT alert_key, action, CASE WHEN severity IS NOT NULL THEN 'open' ELSE 'resolved' END AS status, severity,
  epoch_us(CASE WHEN action IN ('opened','reopened') THEN TIMESTAMP '2024-02-01' ELSE first_at END)::bigint AS first_us, epoch_us(CASE WHEN action='unchanged' THEN last_at ELSE TIMESTAMP '2024-02-01' END)::bigint AS last_us FROM j""")
def alert_state_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("alert_key", F.concat(F.lit("u"), "user_id"))
    cut, now = F.lit("2024-01-15").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    old = e.where(F.col("ts") < cut).groupBy("alert_key", "user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    old = old.select("alert_key", F.when(F.col("user_id") % 3 == 0, "resolved").otherwise("open").alias("status"), "first_at", "last_at")
    want = e.where(F.col("ts") >= cut).groupBy("alert_key").agg(F.when(F.count(F.lit(1)) >= 3, "critical").otherwise("warning").alias("severity"))
    m = latest.full_merge_state(old, want, "alert_key", now)
    return m.select("alert_key", "action", "status", "severity", us("first_at").alias("first_us"), us("last_at").alias("last_us"))


RUNS = "SELECT user_id%20 AS source, CASE WHEN event_type='error' THEN 'failed' WHEN event_type='view' THEN 'partial' ELSE 'succeeded' END AS status, ts AS finished_at, (event_type='error')::int AS errors, 1 AS items FROM events"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("succeeded")
    return table(spark, sf, "events").select((F.col("user_id") % 20).alias("source"), status.alias("status"), F.col("ts").alias("finished_at"), (F.col("event_type") == "error").cast("int").alias("errors"), F.lit(1).alias("items"), "event_id")


@query(f"""WITH r AS ({RUNS}), a AS (SELECT source, count(*) AS runs, count(*) FILTER (status='succeeded') AS succeeded, max(CASE WHEN status='succeeded' THEN finished_at END) AS ls, sum(errors)::bigint AS errors, sum(items)::bigint AS items FROM r GROUP BY 1),
 e AS (SELECT user_id%20 AS source, count(*) FILTER (event_id%2=1) AS open_events FROM events WHERE event_type='error' GROUP BY 1)
 SELECT a.source, runs, succeeded, epoch_us(ls)::bigint AS last_success_us, errors, coalesce(open_events,0) AS open_events, round_even(errors::double/items,6) AS error_share FROM a LEFT JOIN e ON a.source=e.source""")
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    r = _runs(spark, sf)
    h = ops.source_health(r, r.where("status = 'failed'").select("source", (F.col("event_id") % 2 == 0).alias("resolved")))
    return h.select("source", "runs", "succeeded", us("last_success").alias("last_success_us"), "errors", "open_events", "error_share")


@query(f"""WITH r AS ({RUNS}), a AS (SELECT source, arg_max(status, finished_at) AS st, max(CASE WHEN status='succeeded' THEN finished_at END) AS ls, count(*) AS n, sum(errors)::bigint AS er FROM r GROUP BY 1),
 k AS (SELECT source, unnest([CASE WHEN st='failed' THEN 'run_failure:critical' WHEN st='partial' THEN 'run_failure:warning' END, CASE WHEN ls IS NULL THEN 'never_succeeded:critical' END,
  CASE WHEN (epoch_us(TIMESTAMP '2024-01-31')-epoch_us(ls))/3600000000.0 > 30 THEN 'stale:warning' END, CASE WHEN er>10 THEN 'quality:warning' END, CASE WHEN n%11=0 THEN 'quota:critical' WHEN n%11<=1 THEN 'quota:warning' END]) AS x FROM a)
 SELECT source||':'||split_part(x,':',1) AS alert_key, source, split_part(x,':',1) AS kind, split_part(x,':',2) AS severity FROM k WHERE x IS NOT NULL""")
def quota_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts wanted for each source from its last run, age, errors and quota."""
    r = _runs(spark, sf).groupBy("source").agg(
        F.max_by("status", "finished_at").alias("last_status"), F.max(F.when(F.col("status") == "succeeded", F.col("finished_at"))).alias("last_success"), F.count(F.lit(1)).alias("n"), F.sum("errors").alias("er"),
    )
    h = r.withColumns({"quota_remaining": F.col("n") % 11, "quota_limit": F.lit(10), "open_events": F.greatest(F.col("er") - 10, F.lit(0)), "incomplete": F.lit(0), "expired": F.lit(0)})
    return ops.source_alerts(h, F.lit("2024-01-31").cast("timestamp"), 30.0)


@query("""WITH b AS (SELECT c_custkey, c_acctbal < 0 AS neg, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey) AS n, c_mktsegment FROM customer)
 SELECT c_custkey, array_to_string(list_filter([CASE WHEN neg THEN 'negative_balance' END, CASE WHEN n<5 THEN 'few_orders' END, CASE WHEN c_mktsegment NOT IN ('BUILDING','MACHINERY') THEN 'segment' END], lambda x: x IS NOT NULL),',') AS blocker_codes,
  NOT neg AND n>=5 AND c_mktsegment IN ('BUILDING','MACHINERY') AS eligible FROM b""")
def blocker_codes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, sf, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    checks = [("negative_balance", F.col("c_acctbal") >= 0), ("few_orders", F.col("n") >= 5), ("segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))]
    return decisions.eligibility(j, checks).select("c_custkey", "blocker_codes", "eligible")


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_size%7<>0 THEN p_retailprice END AS price, CASE WHEN p_size%5<>0 THEN p_size END AS size, CASE WHEN p_size%3<>0 THEN p_brand END AS brand FROM part),
 k AS (SELECT *, 1+(price IS NOT NULL)::int+(size IS NOT NULL)::int+(brand IS NOT NULL)::int AS known, coalesce(price>1500,false) AS bp, coalesce(size>40,false) AS bs, coalesce(brand IN ('Brand#11','Brand#12','Brand#1'),false) AS bb FROM a)
 SELECT p_partkey, round_even(known/4.0::double,6) AS coverage, CASE WHEN bp OR bs OR bb THEN 0.0::double WHEN known>=2 THEN 1.0::double END AS fit,
  array_to_string(list_filter([CASE WHEN bp THEN 'price_above_limit' END, CASE WHEN bs THEN 'size_above_limit' END, CASE WHEN bb THEN 'brand_excluded' END], lambda x: x IS NOT NULL),',') AS blockers FROM k""")
def profile_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    keep = lambda c, m: F.when(F.col("p_size") % m != 0, F.col(c))
    a = p.select("p_partkey", keep("p_retailprice", 7).alias("price"), keep("p_size", 5).alias("size"), keep("p_brand", 3).alias("brand"))
    return decisions.profile_fit(a, {"price": 1500, "size": 40}, {"brand": ["Brand#11", "Brand#12", "Brand#1"]}).select("p_partkey", "coverage", "fit", "blockers")


@query("SELECT o_custkey, sha256(string_agg(o_orderkey::varchar, '|' ORDER BY o_orderkey::varchar)) AS fingerprint, count(*) AS n FROM orders GROUP BY 1")
def fingerprint_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(set_digest(F.col("o_orderkey").cast("string")).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, epoch_us(ts)::bigint AS ts_us, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def append_only_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return ops.append_if_changed(e, ["user_id"], "at", "event_type").select("user_id", "event_id", us("ts").alias("ts_us"), "event_type")
