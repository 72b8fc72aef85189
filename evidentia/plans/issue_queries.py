"""The problem-mining chain over work items: evidence, metrics, clusters, lineage, eligibility.

No driver table holds work items, so they are made from all orders by expressions that Spark and SQL share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import decisions, evidence, lineage, metrics, mining, ops
from evidentia.plans.registry import query, table, wilson_sql

TITLES = (
    "Cannot install the package: production down",
    "Export is critical for us, every time it fails",
    "Question about the roadmap",
    "It would be great to have support for themes",
    "Data loss after the upgrade, we lost data twice",
    "",
    "Migrating away, stopped using it; looking for an alternative",
    "Time-consuming: the sync takes days of work",
)
BODIES = (
    None,
    "We do it by a manual process, copy-paste and a spreadsheet. I wish we could pay extra.",
    "There is budget available and we are willing to pay; it costs us lost revenue.",
    " ".join(["filler"] * 40) + " it is BLOCKING us daily " + " ".join(["more"] * 40) + " work around ",
    "A small question.",
    "Corrupted files, constantly. A workaround is expensive and takes hours each time.",
)


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _pick(number: str, pool: tuple) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {_quoted(x)}" for i, x in enumerate(pool)) + " END"


ISSUE = {
    "document_id": "o_orderkey",
    "entity_id": "CASE WHEN o_orderkey % 53 <> 0 THEN o_custkey % 97 END",
    "source": "o_custkey % 5",
    "item_type": "CASE WHEN o_orderkey % 5 = 0 THEN 'pull_request' ELSE 'issue' END",
    "state": "CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END",
    "label": _pick("o_orderkey % 4", ("bug", "needs triage", "Security issue", "")),
    "comments": "o_orderkey % 7 - 1",
    "is_bot": "o_orderkey % 31 = 0",
    "title": _pick("o_orderkey % 8", TITLES),
    "body": _pick("o_orderkey % 6", BODIES),
    "created_at": "o_orderdate",
    "open_days": "o_orderkey % 40 - 3",
    "cluster": "CASE WHEN o_custkey % 5 IN (1, 2) AND o_orderkey % 3 = 0 THEN 200 + o_orderkey % 7 WHEN o_orderkey % 2 = 0 THEN (o_custkey % 5) * 10 + o_orderkey % 7 ELSE 100 + o_orderkey % 11 END",
}
ISSUE_SQL = "SELECT " + ", ".join(f"{x} AS {name}" for name, x in ISSUE.items()) + " FROM orders"
AS_OF = "2001-06-01"


def issues(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").selectExpr(*[f"{x} AS {name}" for name, x in ISSUE.items()])
    closed = F.when(F.col("state") == "closed", F.expr("created_at + make_dt_interval(open_days)"))
    return d.withColumns({"labels": F.array("label"), "closed_at": closed})


RULES_SQL = ", ".join(f"({_quoted(k)}, {_quoted(t)}, {c}, {_quoted('(?i)' + p)})" for k, t, c, p in X.EVIDENCE_RULES)
LABELS_SQL = "[" + ", ".join(map(_quoted, X.PROBLEM_LABELS)) + "]"
EVIDENCE_SQL = f"""d AS ({ISSUE_SQL}), e AS (SELECT * FROM d WHERE entity_id IS NOT NULL AND title <> '' AND NOT is_bot),
 f AS (SELECT document_id, 'title' AS field, title AS t FROM e UNION ALL SELECT document_id, 'body', body FROM e WHERE body IS NOT NULL), r(rule, evidence_type, confidence, p) AS (VALUES {RULES_SQL}),
 m AS (SELECT document_id, rule, evidence_type, confidence, field, t, regexp_extract_all(t, p) AS ms, string_split_regex(t, p) AS gaps FROM f, r WHERE regexp_matches(t, p)), u AS (SELECT *, unnest(range(1, len(ms)+1)) AS i FROM m),
 s AS (SELECT *, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::bigint AS st, ms[i] AS matched FROM u),
 x AS (SELECT document_id, rule, evidence_type, confidence::double AS confidence, field, st AS char_start, st+length(matched) AS char_end, matched,
   left(trim(substring(t, greatest(1, st-119), st+length(matched)+120-greatest(0, st-120)), ' '||chr(9)||chr(10)), 500) AS excerpt FROM s
  UNION ALL SELECT document_id, 'problem_report', 'problem_report', 0.7, 'title', 0, length(title), title, left(title, 500) FROM e WHERE regexp_matches(title, {_quoted('(?i)' + X.PROBLEM_PATTERN)}) OR list_has_any(string_split(lower(label), ' '), {LABELS_SQL})),
 ev AS (SELECT *, sha256(document_id||'|'||rule||'|'||field||'|'||char_start||'|'||char_end||'|'||excerpt) AS evidence_hash FROM x)"""


def issue_spans(spark: SparkSession, sf: str) -> DataFrame:
    return mining.evidence(issues(spark, sf), "document_id")


@query(f"WITH {EVIDENCE_SQL} SELECT document_id, rule, evidence_type, confidence, field, char_start, char_end, matched, evidence_hash FROM ev")
def issue_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every span of the nine rules and every problem report, in titles and bodies."""
    e = issue_spans(spark, sf).withColumnsRenamed({"start": "char_start", "end": "char_end"})
    return e.select("document_id", "rule", "evidence_type", "confidence", "field", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "matched", "evidence_hash")


@query(f"WITH {EVIDENCE_SQL} SELECT document_id, array_to_string(list_sort(list(DISTINCT evidence_type)), ',') AS types FROM ev GROUP BY 1")
def evidence_types_per_document(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evidence_types(issue_spans(spark, sf)).select("document_id", F.array_join("types", ",").alias("types"))


@query(f"WITH {EVIDENCE_SQL} SELECT rule, lower(matched) AS matched, count(*) AS hits, count(DISTINCT document_id) AS documents FROM ev WHERE rule <> 'problem_report' GROUP BY 1, 2")
def rule_hit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule finds what: the classifier's report."""
    e = mining.evidence(issues(spark, sf), "document_id", problems=False)
    return e.groupBy("rule", F.lower("matched").alias("matched")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("document_id").alias("documents"))


LOW, HIGH = wilson_sql("numerator", "denominator")
TIDY_SQL = f"""SELECT entity, metric, numerator::double AS numerator, denominator::double AS denominator, sample_size::bigint AS sample_size, status,
  CASE WHEN status='measured' THEN round_even(CASE WHEN plain THEN numerator::double WHEN denominator<>0 THEN numerator::double/denominator END,6) END AS value,
  CASE WHEN status='measured' AND ci AND denominator>0 THEN {LOW} END AS ci_low, CASE WHEN status='measured' AND ci AND denominator>0 THEN {HIGH} END AS ci_high FROM g"""


def _spec_sql(spec: metrics.MetricSpec) -> str:
    return f"SELECT entity, '{spec.key}' AS metric, {spec.numerator}::double AS numerator, {spec.denominator or 'NULL'}::double AS denominator, {spec.sample} AS sample_size, {spec.least} AS least, {spec.interval} AS ci, {spec.plain} AS plain, {spec.gate or 'NULL'}::varchar AS gate, structure FROM w"


def _tidy_sql(specs: list[metrics.MetricSpec]) -> str:
    union = " UNION ALL ".join(map(_spec_sql, specs))
    return f"k AS ({union}), g AS (SELECT *, coalesce(structure, CASE WHEN coalesce(sample_size,0) < least THEN 'insufficient_sample' END, gate, 'measured') AS status FROM k) {TIDY_SQL}"


BUGS_SQL = "(" + ", ".join(map(_quoted, metrics.BUG_LABELS)) + ")"
KINDS_SQL = ", ".join(f"count(*) FILTER (i AND list_contains(types, '{k}')) AS n_{k}" for k in metrics.ISSUE_EVIDENCE)


@query(
    f"""WITH {EVIDENCE_SQL}, ty AS (SELECT document_id, list(DISTINCT evidence_type) AS types FROM ev GROUP BY 1),
 j AS (SELECT d.*, types, item_type='issue' AS i, CASE WHEN item_type='issue' AND state='closed' AND open_days>=0 THEN open_days::double END AS age FROM d LEFT JOIN ty ON ty.document_id=d.document_id WHERE NOT is_bot AND entity_id IS NOT NULL AND created_at <= TIMESTAMP '{AS_OF}'),
 w0 AS (SELECT entity_id AS entity, count(*) FILTER (i) AS n_issues, count(*) FILTER (NOT i) AS n_pulls, count(*) FILTER (i AND lower(label) IN {BUGS_SQL}) AS n_bugs, count(*) FILTER (i AND state='open') AS n_open, coalesce(sum(greatest(comments,0)) FILTER (i),0) AS n_comments,
  count(*) FILTER (i AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS n_recent, median(age) AS median_days, count(age) AS n_resolved, {KINDS_SQL} FROM j GROUP BY 1),
 w AS (SELECT *, n_issues+n_pulls AS n_items, 30 AS days, NULL::varchar AS structure FROM w0), """
    + _tidy_sql(metrics.REPOSITORY_SPECS)
)
def repository_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The fourteen metrics of every entity."""
    return metrics.repository_metrics(issues(spark, sf), metrics.evidence_types(issue_spans(spark, sf)), F.lit(AS_OF).cast("timestamp"))


# Source 1 and 2 are independent of each other; 3 is affiliated and asks questions; 0 and 1 belong together.
SOURCES = ((0, "a", "independent"), (1, "a", "independent"), (2, "b", "independent"), (3, "c", "affiliated"), (4, "d", "independent"))
LEVEL_SQL = """lv AS (SELECT cluster, CASE WHEN count(DISTINCT source)=1 THEN 'E1' WHEN count(DISTINCT CASE source WHEN 0 THEN 'a' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'd' END)>=2 AND count(*) FILTER (source=3)=0
  AND NOT (count(*) FILTER (source=0)>0 AND count(*) FILTER (source=1)>0) THEN 'E2' ELSE 'unverified_cross_source' END AS level FROM mem GROUP BY 1)"""
MEMBER_SQL = f"d AS ({ISSUE_SQL}), mem AS (SELECT cluster, document_id, entity_id, source, state, created_at FROM d WHERE entity_id IS NOT NULL)"


def _levels(spark: SparkSession, members: DataFrame) -> DataFrame:
    sources = spark.createDataFrame([(str(s), g, st) for s, g, st in SOURCES], "source string, grp string, status string")
    rel = spark.createDataFrame([("0", "1", "owner", "blocks", "global")], "low string, high string, type string, effect string, scope string")
    origins = members.select("cluster", F.col("source").cast("string").alias("source"), F.col("entity_id").alias("entity"), F.col("document_id").alias("content"))
    return evidence.independence(origins, sources, rel)


OUTCOME_SQL = """SELECT event_id, CASE WHEN event_id%3=0 THEN 200+event_id%7 WHEN event_id%3=1 THEN 100+event_id%11 ELSE (event_id%5)*10+event_id%7 END AS cluster, user_id AS participant,
  CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'signup' THEN 'prepayment' WHEN 'click' THEN 'contract' WHEN 'error' THEN 'renewal' ELSE 'interview' END AS outcome_type, CASE WHEN event_id%7<>0 THEN 'supports' ELSE 'refutes' END AS direction, CASE WHEN event_id%4<>0 THEN ts END AS verified_at FROM events"""


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "sale").when(F.col("event_type") == "signup", "prepayment").when(F.col("event_type") == "click", "contract").when(F.col("event_type") == "error", "renewal").otherwise("interview")
    cluster = F.when(i % 3 == 0, 200 + i % 7).when(i % 3 == 1, 100 + i % 11).otherwise((i % 5) * 10 + i % 7)
    return e.select("event_id", cluster.alias("cluster"), F.col("user_id").alias("participant"), kind.alias("outcome_type"), F.when(i % 7 != 0, "supports").otherwise("refutes").alias("direction"), F.when(i % 4 != 0, F.col("ts")).alias("verified_at"))


PAYS_SQL = "direction='supports' AND outcome_type IN (" + ", ".join(map(_quoted, metrics.DIRECT_PAYMENT)) + ")"
ECONOMIC_SQL = "[" + ", ".join(map(_quoted, metrics.ECONOMIC)) + "]"
CLUSTER_SQL = f"""{EVIDENCE_SQL}, ty AS (SELECT document_id, list(DISTINCT evidence_type) AS types FROM ev GROUP BY 1), mem AS (SELECT cluster, document_id, entity_id, source, state, created_at FROM d WHERE entity_id IS NOT NULL), {LEVEL_SQL},
 oc AS ({OUTCOME_SQL}), ao AS (SELECT coalesce(max(verified_at), TIMESTAMP '{AS_OF}') AS t FROM oc), tot AS (SELECT count(DISTINCT document_id) AS all_documents, count(DISTINCT entity_id) AS all_entities FROM mem),
 a AS (SELECT cluster AS entity, count(*) AS n_documents, count(DISTINCT entity_id) AS n_entities, max(all_documents) AS all_documents, max(all_entities) AS all_entities, count(*) FILTER (list_contains(types,'workaround')) AS n_workaround,
  count(*) FILTER (list_contains(types,'abandonment_intent')) AS n_switching, count(*) FILTER (list_has_any(types,{ECONOMIC_SQL})) AS n_economic, count(*) FILTER (list_contains(types,'payment_intent')) AS n_payment, count(*) FILTER (source=3) AS n_demand,
  median(CASE WHEN state='open' THEN greatest(0.0, (epoch_us(t)-epoch_us(created_at))/86400000000.0) END) AS median_age, count(*) FILTER (state='open') AS n_unresolved
  FROM mem LEFT JOIN ty ON ty.document_id=mem.document_id, ao, tot GROUP BY 1),
 pd AS (SELECT cluster, count(DISTINCT participant) AS n_verified, count(DISTINCT CASE WHEN {PAYS_SQL} THEN participant END) AS n_paying FROM oc WHERE verified_at IS NOT NULL GROUP BY 1),
 w AS (SELECT a.*, coalesce(n_verified,0) AS n_verified, coalesce(n_paying,0) AS n_paying, level, CASE WHEN level<>'E2' THEN 'unverified_source_independence' END AS independence,
  CASE WHEN n_documents<=1 THEN 'insufficient_repetition' WHEN n_entities<=1 THEN 'insufficient_entity_spread' END AS structure FROM a LEFT JOIN pd ON pd.cluster=a.entity LEFT JOIN lv ON lv.cluster=a.entity)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    return issues(spark, sf).where("entity_id is not null").select("cluster", "document_id", "entity_id", "source")


def _cluster_metrics(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = members(spark, sf)
    levels = _levels(spark, m)
    demand = spark.createDataFrame([(3,)], "source long")
    docs = issues(spark, sf).select("document_id", "state", "created_at")
    types = metrics.evidence_types(issue_spans(spark, sf))
    return metrics.cluster_metrics(m, docs, types, demand, outcomes(spark, sf), levels, F.lit(AS_OF).cast("timestamp")), levels


@query(f"WITH {CLUSTER_SQL}, " + _tidy_sql(metrics.CLUSTER_SPECS))
def cluster_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The nine metrics of every cluster."""
    return _cluster_metrics(spark, sf)[0]


AUDIT_SQL = "SELECT user_id AS cluster, arg_max(CASE WHEN event_id%3<>0 THEN 'coherent' ELSE 'mixed' END, struct_pack(t:=ts,e:=event_id)) AS verdict FROM events GROUP BY 1"


@query(
    f"""WITH {CLUSTER_SQL}, au AS ({AUDIT_SQL}),
 q AS (SELECT entity AS cluster, level, verdict,
  structure IS NULL AND all_documents>=20 AND all_entities>=5 AND n_documents>=5 AS base, structure IS NULL AND n_documents>=5 AND independence IS NULL AS dm, n_demand, structure IS NULL AND n_verified>=1 AS pm, n_paying FROM w LEFT JOIN au ON au.cluster=w.entity WHERE structure IS NULL),
 b AS (SELECT cluster, level, list_filter([CASE WHEN verdict IS NULL THEN 'missing_cluster_audit' WHEN verdict<>'coherent' THEN 'cluster_audit:'||verdict END, CASE WHEN NOT base THEN 'base_metrics_not_measured' END,
  CASE WHEN level<>'E2' THEN 'independent_source_evidence_required' END, CASE WHEN NOT dm THEN 'independent_demand_evidence_required' WHEN n_demand=0 THEN 'independent_demand_signal_absent' END,
  CASE WHEN NOT pm THEN 'direct_payment_evidence_required' WHEN n_paying=0 THEN 'direct_payment_signal_absent' END], lambda x: x IS NOT NULL) AS bl FROM q)
 SELECT cluster, level AS evidence_level, array_to_string(bl, ',') AS blocker_codes, len(bl)=0 AS eligible FROM b"""
)
def opportunity_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Which clusters may become candidates, and what stands against the others, in order."""
    tidy, levels = _cluster_metrics(spark, sf)
    e = table(spark, sf, "events")
    audits = e.groupBy(F.col("user_id").alias("cluster")).agg(F.max_by(F.when(F.col("event_id") % 3 != 0, "coherent").otherwise("mixed"), F.struct("ts", "event_id")).alias("verdict"))
    return decisions.opportunity_eligibility(tidy, levels, audits)


PREVIOUS = "1999-06-01"
GROUP = "CASE WHEN o_custkey % 60 < 5 THEN 'merged' WHEN o_custkey % 60 < 10 THEN 's' || (o_custkey % 60) || '-' || (o_orderkey % 2) ELSE 'c' || (o_custkey % 60) END"
BEFORE = "'c' || (o_custkey % 60)"
TOKENS = "CASE WHEN o_custkey % 60 < 20 THEN 'k' || (o_custkey % 60) ELSE 'k' || (o_custkey % 60 % 50) END"
RUN_SQL = f"""SELECT p.* FROM (SELECT {{group}} AS cluster, o_orderkey AS member, {TOKENS} AS token, o_custkey FROM orders WHERE {{rows}}) p"""
LINEAGE_SQL = f"""p AS ({RUN_SQL.format(group=BEFORE, rows=f"o_orderdate < TIMESTAMP '{PREVIOUS}'")}), c AS ({RUN_SQL.format(group=GROUP, rows="o_custkey % 60 <> 59")}),
 np AS (SELECT cluster, count(DISTINCT member) AS n FROM p GROUP BY 1), nc AS (SELECT cluster, count(DISTINCT member) AS n FROM c GROUP BY 1),
 tp AS (SELECT cluster, CASE WHEN count(DISTINCT token)=1 THEN min(token) ELSE '' END AS token FROM p GROUP BY 1), tc AS (SELECT cluster, CASE WHEN count(DISTINCT token)=1 THEN min(token) ELSE '' END AS token FROM c GROUP BY 1),
 mj AS (SELECT p.cluster AS previous, c.cluster AS current, count(*) AS s FROM p JOIN c USING (member) GROUP BY 1, 2), m2 AS (SELECT previous, current, round_even(s::double/(np.n+nc.n-s),6) AS member_jaccard FROM mj JOIN np ON np.cluster=previous JOIN nc ON nc.cluster=current),
 sj AS (SELECT tp.cluster AS previous, tc.cluster AS current, 1.0::double AS signature_jaccard FROM tp JOIN tc USING (token)),
 b AS (SELECT coalesce(m2.previous, sj.previous) AS previous, coalesce(m2.current, sj.current) AS current, coalesce(member_jaccard, 0.0::double) AS member_jaccard, coalesce(signature_jaccard, 0.0::double) AS signature_jaccard FROM m2 FULL JOIN sj ON m2.previous=sj.previous AND m2.current=sj.current),
 h AS (SELECT *, count(*) OVER (PARTITION BY previous) AS dp, count(*) OVER (PARTITION BY current) AS dc FROM b WHERE member_jaccard>=0.6 OR signature_jaccard>=0.6),
 rel AS (SELECT previous, current, member_jaccard, signature_jaccard, CASE WHEN dp>1 THEN 'split' WHEN dc>1 THEN 'merged' WHEN member_jaccard>=0.8 THEN 'stable' ELSE 'evolved' END AS relation FROM h
  UNION ALL SELECT NULL, cluster, NULL, NULL, 'new' FROM nc WHERE cluster NOT IN (SELECT current FROM h) UNION ALL SELECT cluster, NULL, NULL, NULL, 'disappeared' FROM np WHERE cluster NOT IN (SELECT previous FROM h))"""


def _run(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Members of the clusters of a run, and the token that all members of a cluster share, if one."""
    r = rows.selectExpr(f"{group} AS cluster", "o_orderkey AS member", f"{TOKENS} AS token")
    return r.select("cluster", "member"), r.groupBy("cluster").agg(F.min("token").alias("token"), F.max("token").alias("last")).where("token = last").select("cluster", "token")


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    (was, was_tokens), (now, now_tokens) = _run(o.where(f"o_orderdate < timestamp '{PREVIOUS}'"), BEFORE), _run(o.where("o_custkey % 60 <> 59"), GROUP)
    return lineage.relations(was, now, was_tokens, now_tokens)


@query(f"WITH {LINEAGE_SQL} SELECT * FROM rel")
def lineage_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of an earlier run against those of a later one, in which some have merged, split, come or gone."""
    return _relations(spark, sf)


@query(
    f"""WITH {LINEAGE_SQL}, best AS (SELECT current, coalesce(max(member_jaccard), 0.0) AS best FROM rel WHERE current IS NOT NULL GROUP BY 1),
 n AS (SELECT count(*) FILTER (relation='stable') AS stable, count(*) FILTER (relation='evolved') AS evolved, count(*) FILTER (relation='split') AS split, count(*) FILTER (relation='merged') AS merged, count(*) FILTER (relation='new') AS new,
  count(*) FILTER (relation='disappeared') AS disappeared, count(DISTINCT previous) AS previous_clusters, count(DISTINCT current) AS current_clusters, count(DISTINCT CASE WHEN member_jaccard IS NOT NULL THEN current END) AS matched_clusters FROM rel),
 x AS (SELECT n.*, (SELECT round_even(round(sum(best),6)/count(*),6) FROM best) AS mean_best_member_jaccard, (SELECT coalesce(sum(k) FILTER (k>1),0)::bigint FROM (SELECT count(*) AS k FROM h GROUP BY previous)) AS split_relations,
  (SELECT coalesce(sum(k) FILTER (k>1),0)::bigint FROM (SELECT count(*) AS k FROM h GROUP BY current)) AS merge_relations, round_even(stable::double/current_clusters,6) AS stability_rate FROM n)
 SELECT *, CASE WHEN least(previous_clusters,current_clusters)<20 THEN 'insufficient_history' WHEN coalesce(stability_rate,0)<0.8 THEN 'below_stability_threshold' ELSE 'passed' END AS status FROM x"""
)
def lineage_stability(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.stability(_relations(spark, sf))


THEME_SQL = "CASE " + " ".join(f"WHEN regexp_matches(tx, {_quoted('(?i)' + p)}) THEN {_quoted(k)}" for k, p in X.THEMES) + " ELSE 'recurring_problem' END"


@query(
    f"""WITH {EVIDENCE_SQL}, n AS (SELECT document_id, count(*) AS ev FROM ev GROUP BY 1), y AS (SELECT d.document_id, entity_id, title||chr(10)||coalesce(body,'') AS tx, coalesce(n.ev,0) AS ev FROM d LEFT JOIN n ON n.document_id=d.document_id),
 z AS (SELECT *, {THEME_SQL} AS theme FROM y), a AS (SELECT theme, count(*) AS documents, count(DISTINCT entity_id) AS entities, sum(ev)::bigint AS evidence, array_to_string(list_slice(list_sort(list(document_id)),1,3),',') AS examples FROM z GROUP BY 1)
 SELECT *, CASE WHEN documents>=3 AND entities>=2 AND evidence>=3 THEN 'weak_signal' ELSE 'insufficient' END AS verdict FROM a ORDER BY documents DESC, entities DESC, evidence DESC, theme LIMIT 5"""
)
def theme_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The five leading of the seven themes, with their first three examples."""
    n = issue_spans(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("ev"))
    d = issues(spark, sf).join(n, "document_id", "left").na.fill(0, ["ev"])
    d = d.withColumn("theme", X.first_theme(F.concat("title", F.lit("\n"), F.coalesce("body", F.lit("")))))
    return ops.theme_rollup(d, "theme", "entity_id", "ev", "document_id")
