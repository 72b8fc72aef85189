"""What readers ask for: filtered lists, drill-downs, chains of lookups, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import latest, reads
from evidentia.plans.issue_queries import EVIDENCE_SQL, issue_spans, issues, outcomes, OUTCOME_SQL
from evidentia.plans.registry import query, table

us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang='en' AND n_chars >= 200 ORDER BY n_chars DESC, doc_id LIMIT 100")
def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A list with optional filters, of which one is not given."""
    d = reads.listed(table(spark, sf, "documents"), {"lang": "en", "source": None}, [F.col("n_chars") >= 200], [F.col("n_chars").desc(), "doc_id"], 100)
    return d.select("doc_id", "source", "n_chars")


@query("SELECT doc_id, lang, source FROM documents WHERE (lang='en' AND source='src1') OR (lang='fr' AND source='src2')")
def active_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of any of several pairs of key and version."""
    pairs = spark.createDataFrame([("en", "src1"), ("fr", "src2")], "lang string, source string")
    return reads.any_pair(table(spark, sf, "documents"), pairs).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 12 AND p_brand LIKE 'Brand#1%'")
def between_and_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_size").between(5, 12) & F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_name")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON lower(n_name)=lower(upper(n_name)) AND c_nationkey=n_nationkey WHERE lower(c_mktsegment)='building'")
def case_insensitive_match(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where(F.lower("c_mktsegment") == F.lower(F.lit("Building")))
    return c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("""SELECT o_orderkey, count(*) AS outcomes, count(DISTINCT l_suppkey) AS participants FROM orders JOIN lineitem ON l_orderkey=o_orderkey
 WHERE l_returnflag='R' AND l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY 1""")
def outcomes_of_experiments(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes within the window of their experiment."""
    j = table(spark, sf, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.where((F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")))
    return j.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("outcomes"), F.count_distinct("l_suppkey").alias("participants"))


@query(f"""WITH {EVIDENCE_SQL} SELECT d.cluster, ev.document_id, entity_id, state, min(confidence) AS least_confidence, count(*) AS spans FROM ev JOIN d ON d.document_id=ev.document_id WHERE ev.confidence >= 0.8 GROUP BY 1, 2, 3, 4""")
def cluster_drill_down(spark: SparkSession, sf: str) -> DataFrame:
    """Members of clusters with what speaks for them, from a confidence on."""
    e = issue_spans(spark, sf).where("confidence >= 0.8")
    j = issues(spark, sf).select("cluster", "document_id", "entity_id", "state").join(e, "document_id")
    return j.groupBy("cluster", "document_id", "entity_id", "state").agg(F.min("confidence").alias("least_confidence"), F.count(F.lit(1)).alias("spans"))


@query("""SELECT l_orderkey, l_linenumber, p_brand, CASE WHEN l_returnflag<>'R' THEN l_extendedprice END AS score FROM lineitem JOIN part ON p_partkey=l_partkey JOIN orders ON o_orderkey=l_orderkey WHERE o_orderstatus='O'
 ORDER BY score DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 50""")
def score_history(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with their version and run, best first, unscored last."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "orders").where("o_orderstatus = 'O'"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.withColumn("score", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")))
    return reads.listed(j, order=[F.col("score").desc_nulls_last(), "l_orderkey", "l_linenumber"], limit=50).select("l_orderkey", "l_linenumber", "p_brand", "score")


@query("SELECT c_nationkey, arg_max(o_orderkey, struct_pack(d:=o_orderdate,k:=o_orderkey)) AS o_orderkey FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1")
def latest_request_per_source(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "o_orderkey", "o_orderdate")
    return latest.latest_per_key(j, ["c_nationkey"], ["o_orderdate", "o_orderkey"]).select("c_nationkey", "o_orderkey")


@query("""WITH o AS (SELECT o_custkey, arg_max(o_orderkey, struct_pack(d:=o_orderdate,k:=o_orderkey)) AS o_orderkey FROM orders GROUP BY 1), l AS (SELECT l_orderkey, count(*) AS lines, max(l_partkey) AS part FROM lineitem WHERE l_returnflag='A' GROUP BY 1)
 SELECT c_custkey, o_orderkey, coalesce(lines,0) AS lines, p_brand FROM customer LEFT JOIN o ON o_custkey=c_custkey LEFT JOIN l ON l_orderkey=o_orderkey LEFT JOIN part ON p_partkey=part""")
def version_decision_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Every version with its latest decision, that one's measurements and their definition, if there are any."""
    o = latest.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.max("l_partkey").alias("p_partkey"))
    j = table(spark, sf, "customer").join(o, "c_custkey", "left").join(lines, "o_orderkey", "left").join(table(spark, sf, "part"), "p_partkey", "left")
    return j.select("c_custkey", "o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), "p_brand")


@query("SELECT lang, array_to_string(list_slice(list_sort(list(DISTINCT source)),1,5),', ') AS firsts FROM documents GROUP BY 1")
def observed_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return reads.first_values(table(spark, sf, "documents"), "lang", "source")


@query(f"""WITH oc AS ({OUTCOME_SQL}), u AS (SELECT cluster, direction FROM oc WHERE verified_at IS NOT NULL UNION ALL SELECT user_id%97 AS cluster, CASE WHEN event_type='error' THEN 'refutes' ELSE 'supports' END FROM events)
 SELECT cluster, bool_or(direction='supports') AS supported, bool_or(direction='refutes') AS refuted, count(*) AS links FROM u GROUP BY 1""")
def claim_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence and commercial links of a claim together."""
    links = table(spark, sf, "events").select((F.col("user_id") % 97).alias("cluster"), F.when(F.col("event_type") == "error", "refutes").otherwise("supports").alias("direction"))
    return reads.directions(outcomes(spark, sf).where("verified_at is not null"), links, "cluster")


@query("""WITH l AS (SELECT user_id AS candidate, event_type AS component, event_id%4 AS claim, event_id AS evidence FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY candidate, component ORDER BY claim, evidence) AS nth FROM l),
 e AS (SELECT candidate, component, list(struct_pack(claim:=claim,evidence:=evidence) ORDER BY claim, evidence) AS evidence FROM s WHERE nth<=50 GROUP BY 1,2), n AS (SELECT candidate, component, count(DISTINCT claim) AS claims FROM l GROUP BY 1,2),
 p AS (SELECT candidate, list(struct_pack(component:=component,claims:=claims,evidence:=evidence) ORDER BY component) AS components FROM n JOIN e USING (candidate, component) GROUP BY 1)
 SELECT candidate, to_json(struct_pack(candidate:=candidate,components:=components))::varchar AS dossier FROM p""")
def research_dossier(spark: SparkSession, sf: str) -> DataFrame:
    """Component, claim and evidence of each candidate as one nested text."""
    return reads.dossier(table(spark, sf, "events").select(F.col("user_id").alias("candidate"), F.col("event_type").alias("component"), (F.col("event_id") % 4).alias("claim"), F.col("event_id").alias("evidence")))


REPORT_END = "2001-06-01"
_SPAN = f"{{at}} >= TIMESTAMP '{REPORT_END}' - to_days(days) AND {{at}} <= TIMESTAMP '{REPORT_END}'"


@query(f"""WITH d AS (SELECT * FROM (VALUES ('weekly', 7), ('monthly', 30)) t(period, days)), e AS (SELECT TIMESTAMP '{REPORT_END}' AS t), run AS (SELECT max(o_orderdate) AS r FROM orders, e WHERE o_orderdate <= t),
 top AS (SELECT period, row_number() OVER (PARTITION BY period ORDER BY o_totalprice DESC, o_orderkey) AS k, o_orderkey FROM orders JOIN run ON o_orderdate=r, d WHERE o_orderstatus<>'F')
 SELECT period, 'new_candidates' AS item, count(*)::double AS value FROM orders, d WHERE {_SPAN.format(at="o_orderdate")} GROUP BY 1
 UNION ALL SELECT period, 'new_clusters', count(DISTINCT o_custkey) FROM orders, d WHERE o_orderpriority='1-URGENT' AND {_SPAN.format(at="o_orderdate")} GROUP BY 1
 UNION ALL SELECT period, 'verified_outcomes', count(*) FROM lineitem, d WHERE l_returnflag='A' AND {_SPAN.format(at="l_shipdate")} GROUP BY 1
 UNION ALL SELECT period, 'open_alerts', count(*) FROM orders, d WHERE o_orderstatus='P' GROUP BY 1 UNION ALL SELECT period, 'critical_alerts', count(*) FROM orders, d WHERE o_orderstatus='P' AND o_orderpriority='1-URGENT' GROUP BY 1
 UNION ALL SELECT period, 'cost:'||l_returnflag, sum(l_extendedprice::decimal(18,6))::double FROM lineitem, d WHERE {_SPAN.format(at="l_shipdate")} GROUP BY period, l_returnflag UNION ALL SELECT period, 'top:'||k, o_orderkey FROM top WHERE k<=10""")
def period_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly and the monthly report as rows: counts, costs by currency, and the ten best of the latest run."""
    o, li, end = table(spark, sf, "orders"), table(spark, sf, "lineitem"), F.lit(REPORT_END).cast("timestamp")
    alerts = o.where("o_orderstatus = 'P'").select((F.col("o_orderpriority") == "1-URGENT").alias("critical"))
    latest_run = o.where(F.col("o_orderdate") <= end).agg(F.max("o_orderdate").alias("o_orderdate"))
    scores = o.where("o_orderstatus <> 'F'").join(F.broadcast(latest_run), "o_orderdate")  # one row
    out = None
    for period, days in (("weekly", 7), ("monthly", 30)):
        inside = lambda at, n=days: (F.col(at) >= end - F.expr(f"INTERVAL {n} DAYS")) & (F.col(at) <= end)
        report = reads.period_report(
            o.where(inside("o_orderdate")), o.where(inside("o_orderdate") & (F.col("o_orderpriority") == "1-URGENT")).select(F.col("o_custkey").alias("cluster")),
            li.where(inside("l_shipdate") & (F.col("l_returnflag") == "A")), alerts, li.where(inside("l_shipdate")).select(F.col("l_returnflag").alias("currency"), F.col("l_extendedprice").alias("amount")),
            scores.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")),
        ).select(F.lit(period).alias("period"), "item", "value")
        out = report if out is None else out.unionByName(report)
    return out
