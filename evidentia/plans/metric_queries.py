"""Metrics, changes and signals over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.exprs import days_between, half_even
from evidentia.operators import decisions, metrics, signals
from evidentia.operators.metrics import MetricSpec
from evidentia.plans.registry import query, table, wilson_sql

LOW, HIGH = wilson_sql("numerator", "denominator")
GATED = f"""
 SELECT entity, metric, numerator::double AS numerator, denominator::double AS denominator, sample_size::bigint AS sample_size, status,
  CASE WHEN status='measured' AND denominator<>0 THEN round_even(numerator::double/denominator,6) END AS value,
  CASE WHEN status='measured' AND ci AND denominator>0 THEN {LOW} END AS ci_low,
  CASE WHEN status='measured' AND ci AND denominator>0 THEN {HIGH} END AS ci_high
 FROM (SELECT *, CASE WHEN coalesce(sample_size,0) < least_n THEN 'insufficient_sample' ELSE 'measured' END AS status FROM tidy)"""

ENTITY_SPECS = [
    MetricSpec("eligible_count", "n", "one", "n", 1),
    MetricSpec("open_ratio", "n_open", "n", "n", 20, True),
    MetricSpec("urgent_ratio", "n_urgent", "n", "n", 20, True),
    MetricSpec("creation_rate_30d", "n_recent", "days", "n", 10),
    MetricSpec("median_resolution_days", "median_days", "one", "n_closed", 10),
]


@query(
    f"""WITH last_day AS (SELECT max(o_orderdate) AS t FROM orders),
 closed AS (SELECT l_orderkey, max(l_shipdate) AS closed_at FROM lineitem GROUP BY 1),
 d AS (SELECT n_name AS entity, o_orderstatus, o_orderpriority, o_orderdate, t,
   CASE WHEN o_orderstatus='F' AND closed_at >= o_orderdate THEN (epoch_us(closed_at)-epoch_us(o_orderdate))/86400000000.0 END AS days_open
   FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey LEFT JOIN closed ON l_orderkey=o_orderkey, last_day),
 w AS (SELECT entity, count(*) AS n, 1 AS one, 30 AS days, count(*) FILTER (o_orderstatus='O') AS n_open, count(*) FILTER (o_orderpriority='1-URGENT') AS n_urgent,
   count(*) FILTER (o_orderdate >= t - INTERVAL 30 DAY AND o_orderdate <= t) AS n_recent, median(days_open::double) AS median_days, count(days_open) AS n_closed FROM d GROUP BY entity),
 tidy AS (SELECT entity, 'eligible_count' AS metric, n::double AS numerator, one::double AS denominator, n AS sample_size, 1 AS least_n, false AS ci FROM w
  UNION ALL SELECT entity,'open_ratio',n_open,n,n,20,true FROM w UNION ALL SELECT entity,'urgent_ratio',n_urgent,n,n,20,true FROM w
  UNION ALL SELECT entity,'creation_rate_30d',n_recent,days,n,10,false FROM w UNION ALL SELECT entity,'median_resolution_days',median_days,one,n_closed,10,false FROM w) {GATED}"""
)
def entity_metrics_tidy(spark: SparkSession, sf: str) -> DataFrame:
    """Gated metrics of each nation's orders, one pass over the joined rows."""
    orders = table(spark, sf, "orders")
    as_of = orders.agg(F.max("o_orderdate").alias("t"))
    closed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed_at"))
    d = orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.join(closed, "o_orderkey", "left").join(F.broadcast(as_of))  # one row
    days = F.when((F.col("o_orderstatus") == "F") & (F.col("closed_at") >= F.col("o_orderdate")), days_between(F.col("closed_at"), F.col("o_orderdate")))
    recent = (F.col("o_orderdate") >= F.col("t") - F.expr("INTERVAL 30 DAYS")) & (F.col("o_orderdate") <= F.col("t"))
    wide = d.withColumn("days_open", days).groupBy(F.col("n_name").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.count_if(recent).alias("n_recent"), F.median("days_open").alias("median_days"), F.count("days_open").alias("n_closed"),
    ).withColumns({"one": F.lit(1), "days": F.lit(30)})
    return metrics.tidy(wide, "entity", ENTITY_SPECS)


EVIDENCE_KINDS = {"contact": r"[a-z0-9._]+@[a-z0-9.]+", "license": r"(?i)license", "number": r"[0-9]{3}"}


@query(
    f"""WITH w AS (SELECT source AS entity, count(*) AS n, count(*) FILTER (regexp_matches(text,'[a-z0-9._]+@[a-z0-9.]+')) AS contact,
  count(*) FILTER (regexp_matches(text,'(?i)license')) AS license, count(*) FILTER (regexp_matches(text,'[0-9]{{3}}')) AS number FROM documents GROUP BY source),
 tidy AS (SELECT entity,'contact_ratio' AS metric,contact AS numerator,n AS denominator,n AS sample_size,20 AS least_n,true AS ci FROM w
  UNION ALL SELECT entity,'license_ratio',license,n,n,20,true FROM w UNION ALL SELECT entity,'number_ratio',number,n,n,20,true FROM w) {GATED}"""
)
def evidence_type_ratio_gated(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    wide = d.groupBy(F.col("source").alias("entity")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in EVIDENCE_KINDS.items()])
    return metrics.tidy(wide, "entity", [MetricSpec(f"{k}_ratio", k, "n", "n", 20, True) for k in EVIDENCE_KINDS])


DAILY = "SELECT event_type, date_trunc('day', ts)::timestamp AS day, count(*) AS n, sum(round(value*100)::bigint)::double AS v FROM events GROUP BY 1,2"


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("v"))


@query(
    f"""WITH s AS (SELECT *, CASE WHEN n >= 60 THEN 'measured' ELSE 'insufficient_sample' END AS status FROM ({DAILY})),
 b AS (SELECT *, last_value(CASE WHEN status='measured' THEN v END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM s)
 SELECT event_type, epoch_us(day)::bigint AS day_us, CASE WHEN status<>'measured' THEN status WHEN baseline IS NULL THEN 'insufficient_history' ELSE 'measured' END AS signal_status,
  CASE WHEN status='measured' AND baseline IS NOT NULL THEN round_even(v-baseline,6) END AS absolute_change,
  CASE WHEN status='measured' AND baseline<>0 THEN round_even((v-baseline)/abs(baseline),6) END AS relative_change,
  CASE WHEN status='measured' AND baseline IS NOT NULL THEN CASE WHEN v>baseline THEN 'up' WHEN v<baseline THEN 'down' ELSE 'flat' END END AS direction FROM b"""
)
def period_change_signal(spark: SparkSession, sf: str) -> DataFrame:
    s = _daily(spark, sf).withColumn("status", F.when(F.col("n") >= 60, "measured").otherwise("insufficient_sample"))
    out = metrics.period_change(s, ["event_type"], "day", "v", "status")
    return out.select("event_type", F.unix_micros(F.col("day").cast("timestamp")).alias("day_us"), "signal_status", "absolute_change", "relative_change", "direction")


@query(
    """WITH d AS (SELECT event_type, date_trunc('day', ts)::date AS day, count(*) AS n FROM events GROUP BY 1,2)
 SELECT event_type, strftime(day,'%Y-%m-%d') AS day, sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)::bigint AS in_30d,
  round_even(sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)/30.0::double,6) AS rate_30d FROM d"""
)
def trailing_30d_rate(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.unix_date("day")).rangeBetween(-29, 0)
    s = F.sum("n").over(w)
    return d.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), s.alias("in_30d"), half_even(s / F.lit(30.0)).alias("rate_30d"))


@query(
    f"""WITH p AS ({DAILY}), sl AS (SELECT a.event_type, median((b.v-a.v)/((epoch_us(b.day)-epoch_us(a.day))/86400000000.0)) AS slope FROM p a JOIN p b ON a.event_type=b.event_type AND a.day<b.day GROUP BY 1),
 m AS (SELECT event_type, count(*) AS n, median(v) AS mid FROM p GROUP BY 1), j AS (SELECT m.*, slope, CASE WHEN n>=4 AND mid<>0 THEN slope*30/abs(mid) END AS rel FROM m LEFT JOIN sl USING (event_type))
 SELECT event_type, n::bigint AS n, CASE WHEN n>=4 THEN 'measured' ELSE 'insufficient_history' END AS status, CASE WHEN n>=4 THEN round(slope,9) END AS slope, round(rel,6) AS relative_30d,
  CASE WHEN n>=4 THEN CASE WHEN rel>0.05 THEN 'rising' WHEN rel<-0.05 THEN 'falling' ELSE 'stable' END END AS direction FROM j"""
)
def theil_sen_trend(spark: SparkSession, sf: str) -> DataFrame:
    return signals.trend(_daily(spark, sf), ["event_type"], "day", "v")


@query(
    f"""WITH p AS ({DAILY}), l AS (SELECT event_type, arg_max(v,day) AS last, max(day) AS last_day, count(*) AS n FROM p GROUP BY 1),
 h AS (SELECT p.event_type, v FROM p JOIN l USING (event_type) WHERE day<last_day), m AS (SELECT event_type, median(v) AS mid FROM h GROUP BY 1),
 d AS (SELECT h.event_type, median(abs(v-mid)) AS mad FROM h JOIN m USING (event_type) GROUP BY 1)
 SELECT event_type, n::bigint AS n, CASE WHEN n<6 THEN 'insufficient_history' WHEN (mad<>0 AND abs(0.6745*(last-mid)/mad)>=3.5) OR (mad=0 AND last<>mid) THEN 'anomaly' ELSE 'normal' END AS status,
  CASE WHEN n>=6 THEN round(CASE WHEN mad<>0 THEN 0.6745*(last-mid)/mad WHEN last=mid THEN 0.0 ELSE 9.999999 END,6) END AS score FROM l LEFT JOIN m USING (event_type) LEFT JOIN d USING (event_type)"""
)
def mad_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return signals.anomaly(_daily(spark, sf), ["event_type"], "day", "v")


@query(
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM ({DAILY})),
 z AS (SELECT a.event_type, a.v AS x, b.v AS y FROM p a JOIN p b ON a.event_type=b.event_type AND b.i=a.i+7), c AS (SELECT event_type, var_pop(x) vx, var_pop(y) vy, covar_pop(x,y) xy FROM z GROUP BY 1),
 n AS (SELECT event_type, count(*) AS n FROM p GROUP BY 1)
 SELECT event_type, n::bigint AS n, CASE WHEN vx>0 AND vy>0 THEN round(xy/sqrt(vx*vy),6) END AS strength FROM n LEFT JOIN c USING (event_type)"""
)
def lag_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return signals.autocorrelation(_daily(spark, sf), ["event_type"], "day", "v", 7)


@query(
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM ({DAILY})), g AS (SELECT event_type, (epoch_us(day)-epoch_us(lag(day) OVER (PARTITION BY event_type ORDER BY day)))/86400000000.0 AS gap FROM p),
 k AS (SELECT event_type, median(gap) AS iv, count(*) AS n FROM g GROUP BY 1), reg AS (SELECT g.event_type, iv, n, bool_and(gap IS NULL OR abs(gap-iv)<=0.2*iv) AS regular FROM g JOIN k ON k.event_type=g.event_type GROUP BY 1,2,3),
 lg AS (SELECT event_type, n, iv, round_even(x/iv,0)::int AS lag FROM reg, (VALUES (7.0::double),(30.0),(90.0)) t(x) WHERE n>=12 AND regular),
 z AS (SELECT lg.event_type, lg.lag, var_pop(a.v) AS vx, var_pop(b.v) AS vy, covar_pop(a.v,b.v) AS xy FROM lg JOIN p a ON a.event_type=lg.event_type JOIN p b ON b.event_type=lg.event_type AND b.i=a.i+lg.lag WHERE lg.lag>=2 AND lg.n>=3*lg.lag GROUP BY 1,2),
 b AS (SELECT event_type, max(struct_pack(r:=xy/sqrt(vx*vy), o:=-lag)) AS best FROM z WHERE vx>0 AND vy>0 GROUP BY 1)
 SELECT reg.event_type, n::bigint AS n, CASE WHEN n<12 THEN 'insufficient_history' WHEN NOT regular THEN 'irregular_sampling' WHEN best IS NULL THEN 'insufficient_history' WHEN best.r<0.6 THEN 'not_detected' ELSE 'detected' END AS status,
  round(best.r,6) AS strength, CASE WHEN best.r>=0.6 THEN round_even(-best.o*iv,0)::bigint END AS period_days FROM reg LEFT JOIN b ON b.event_type=reg.event_type"""
)
def seasonality_of_daily_series(spark: SparkSession, sf: str) -> DataFrame:
    return signals.seasonality(_daily(spark, sf), ["event_type"], "day", "v")


SCORE_SQL = """WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type='click') AS c, count(*) FILTER (event_type='view') AS w, count(*) FILTER (event_type='error') AS e FROM events GROUP BY 1),
 m AS (SELECT *, round_even(c::double/n,6) AS cv, round_even(w::double/n,6) AS wv, CASE WHEN e>0 THEN round_even(e::double/n,6) END AS ev FROM u),
 k AS (SELECT *, (cv IS NOT NULL)::int+(wv IS NOT NULL)::int+(ev IS NOT NULL)::int AS k,
   round(0.5*least(1.0,cv)+0.3*least(1.0,wv)+coalesce(0.2*least(1.0,ev),0.0),6) AS potential FROM m),
 f AS (SELECT *, round(0.35*k/3+0.25*((least(1.0,n/20.0::double)*3)/3)+0.20*((0.5+0.5+CASE WHEN ev IS NULL THEN 0.0 ELSE 0.5 END)/3)+0.20*CASE WHEN user_id%2=0 THEN 1.0 ELSE 0.0 END,6) AS confidence FROM k)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), kind("click").alias("c"), kind("view").alias("w"), kind("error").alias("e"))
    share = lambda x: half_even(F.col(x) / F.col("n"))
    u = u.withColumns({"c_value": share("c"), "w_value": share("w"), "e_value": F.when(F.col("e") > 0, share("e"))})
    none = F.lit(None).cast("double")
    u = u.withColumns({f"{m}_{p}": none for m in "cwe" for p in ("low", "high")} | {f"{m}_n": F.col("n") for m in "cwe"})
    u = u.withColumns({"fit": F.lit(0.5), "level": F.when(F.col("user_id") % 2 == 0, "E2").otherwise("E1"), "blocked": F.when(F.col("user_id") % 10 == 0, F.lit("excluded_profile"))})
    return decisions.score(u, ["c", "w", "e"], (0.5, 0.3, 0.2))


STATUS_SQL = "CASE WHEN user_id%10=0 THEN 'excluded_profile' WHEN k<3 THEN 'incomplete_metrics' WHEN confidence<0.6 THEN 'low_confidence' ELSE 'rankable' END"


@query(
    SCORE_SQL
    + f""" SELECT user_id, potential, round(k/3.0::double,6) AS coverage, confidence, {STATUS_SQL} AS status,
  CASE WHEN {STATUS_SQL}='rankable' THEN round(potential*0.9*confidence,6) END AS total_score FROM f"""
)
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("user_id", "potential", "coverage", "confidence", "status", "total_score")


@query(
    SCORE_SQL
    + f""", g AS (SELECT user_id, {STATUS_SQL} AS status, CASE WHEN {STATUS_SQL}='rankable' THEN round(potential*0.9*confidence,6) END AS total_score FROM f)
 SELECT user_id, status, total_score, CASE WHEN status='rankable' THEN row_number() OVER (PARTITION BY status='rankable' ORDER BY total_score DESC, user_id DESC) END::bigint AS rank,
  CASE WHEN status<>'rankable' THEN status END AS reason FROM g"""
)
def rank_with_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.rank(_scored(spark, sf).select("user_id", "status", "total_score"), "user_id").select("user_id", "status", "total_score", "rank", "reason")
