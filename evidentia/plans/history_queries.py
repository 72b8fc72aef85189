"""Histories of clusters and their signals, quantiles of large groups, ordered digests, canonical content, purges and stars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.exprs import half_even, half_up
from evidentia.operators import digests, lineage, mining, order_statistics, retention
from evidentia.plans.registry import query, table
from evidentia.session import fresh_dir

us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

FIRST = "CASE event_id % 5 WHEN 0 THEN 'split' WHEN 1 THEN 'evolved' ELSE 'stable' END"
SECOND = "CASE event_id % 3 WHEN 0 THEN 'merged' ELSE 'stable' END"
RELATIONS = f"""r0 AS (SELECT event_id, user_id, event_type, ts, value, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS one, lag(event_id, 2) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS two,
  lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next FROM events),
 r AS (SELECT 2*event_id AS id, epoch_us(ts) AS finished_at, one AS previous, event_id AS current, {FIRST} AS relation FROM r0 UNION ALL SELECT 2*event_id+1, epoch_us(ts)+(event_id%4-1)*1000000, two, event_id, {SECOND} FROM r0),
 e AS (SELECT current AS child, arg_max(previous, struct_pack(t:=finished_at,i:=id)) AS parent FROM r WHERE relation IN ('stable','evolved') AND previous IS NOT NULL GROUP BY 1)"""
WALK = f"""{RELATIONS}, w AS (SELECT event_id AS node, event_id AS ancestor, 0 AS steps FROM r0 WHERE next IS NULL UNION ALL SELECT w.node, e.parent, steps+1 FROM w JOIN e ON e.child=w.ancestor WHERE steps<51)"""


def _relations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Relations of events to the one and the two before of the same user and type, and the events that none follows."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumns({"one": F.lag("event_id").over(w), "two": F.lag("event_id", 2).over(w), "next": F.lead("event_id").over(w)})
    near = e.select((2 * F.col("event_id")).alias("id"), us("ts").alias("finished_at"), F.col("one").alias("previous"), F.col("event_id").alias("current"), F.expr(FIRST).alias("relation"))
    far = e.select((2 * F.col("event_id") + 1).alias("id"), (us("ts") + (F.col("event_id") % 4 - 1) * 1_000_000).alias("finished_at"), F.col("two").alias("previous"), F.col("event_id").alias("current"), F.expr(SECOND).alias("relation"))
    return near.unionByName(far), e.where("next is null").select(F.col("event_id").alias("node"))


@query(f"WITH RECURSIVE {WALK} SELECT node, ancestor, steps::bigint AS steps FROM w")
def stable_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history of every last cluster, along the newest stable or evolved relation of each."""
    return lineage.stable_histories(*_relations(spark, sf))


@query(
    f"""WITH RECURSIVE {WALK}, o AS (SELECT event_id AS cluster, epoch_us(date_trunc('day', ts)) AS as_of, epoch_us(ts) AS finished_at, event_id AS run_id, value FROM events WHERE event_id%17<>0),
 p AS (SELECT node, as_of, arg_max(value, struct_pack(t:=finished_at,r:=run_id)) AS v FROM w JOIN o ON o.cluster=w.ancestor GROUP BY 1, 2),
 s AS (SELECT a.node, median((b.v-a.v)/((b.as_of-a.as_of)/86400000000.0)) AS slope FROM p a JOIN p b ON b.node=a.node AND a.as_of<b.as_of GROUP BY 1),
 m AS (SELECT node, count(*) AS n, min(as_of) AS first_at, max(as_of) AS last_at, median(v) AS mid, arg_max(v, as_of) AS last FROM p GROUP BY 1),
 h AS (SELECT p.node, v FROM p JOIN m ON m.node=p.node WHERE as_of<last_at), hm AS (SELECT node, median(v) AS mid FROM h GROUP BY 1), hd AS (SELECT h.node, median(abs(v-mid)) AS mad FROM h JOIN hm ON hm.node=h.node GROUP BY 1)
 SELECT m.node, n::bigint AS points, first_at::bigint AS first_us, last_at::bigint AS last_us, CASE WHEN n>=4 THEN round(slope,9) END AS slope,
  CASE WHEN n<6 THEN 'insufficient_history' WHEN (mad<>0 AND abs(0.6745*(last-hm.mid)/mad)>=3.5) OR (mad=0 AND last<>hm.mid) THEN 'anomaly' ELSE 'normal' END AS anomaly_status
 FROM m LEFT JOIN s ON s.node=m.node LEFT JOIN hm ON hm.node=m.node LEFT JOIN hd ON hd.node=m.node"""
)
def history_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Trend and anomaly of the values along each stable history."""
    o = table(spark, sf, "events").where("event_id % 17 <> 0").select(F.col("event_id").alias("cluster"), F.lit("value").alias("metric"), F.date_trunc("day", "ts").alias("as_of"), F.col("ts").alias("finished_at"), F.col("event_id").alias("run_id"), F.lit("measured").alias("status"), "value")
    out = lineage.history_signals(lineage.history_points(lineage.stable_histories(*_relations(spark, sf)), o))
    return out.select("node", "points", us("first_at").alias("first_us"), us("last_at").alias("last_us"), "slope", "anomaly_status")


QUARTILES = {"low": 0.25, "mid": 0.5, "high": 0.75}


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice::double, {p}), 6) AS {n}" for n, p in QUARTILES.items()) + " FROM lineitem GROUP BY 1")
def quartiles_of_large_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles of three groups that hold all rows, narrowed from the sketch's brackets; no state holds more than a few values."""
    out = order_statistics.exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_extendedprice").cast("double"), QUARTILES, limit=2000)
    return out.select("l_returnflag", *[half_up(F.col(name)).alias(name) for name in QUARTILES])


@query("SELECT median(abs(l_extendedprice::double - m)) AS spread FROM lineitem, (SELECT median(l_extendedprice::double) AS m FROM lineitem)")
def spread_of_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The median absolute deviation of one group of all rows."""
    price = table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v"))
    mid = order_statistics.exact_median(price, [], "v", "m", limit=2000)
    return order_statistics.exact_median(price.join(F.broadcast(mid)), [], F.abs(F.col("v") - F.col("m")), "spread", limit=2000)


@query("SELECT event_type, sha256(string_agg(event_id::varchar||':'||user_id::varchar, '|' ORDER BY ts, event_id)) AS digest, count(*)::bigint AS parts FROM events GROUP BY 1 UNION ALL SELECT NULL, sha256(string_agg(event_id::varchar, '|' ORDER BY ts, event_id)), count(*) FROM events")
def ordered_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of each type's events in order, and of all events as one group."""
    e = table(spark, sf, "events")
    by = digests.ordered_digest(e, ["event_type"], ["ts", "event_id"], F.concat_ws(":", "event_id", "user_id"))
    return by.unionByName(digests.ordered_digest(e, [], ["ts", "event_id"], F.col("event_id")).withColumn("event_type", F.lit(None).cast("string")))


NESTED = """'{"z": {"b": [3, {"y": "'||c_mktsegment||'", "x": null}], "a": '||c_custkey||'}, "ä": true,  "a": "'||c_name||'"}'"""
CANONICAL = """'{"a":"'||c_name||'","z":{"a":'||c_custkey||',"b":[3,{"x":null,"y":"'||c_mktsegment||'"}]},"ä":true}'"""


@query(f"SELECT c_custkey, sha256({CANONICAL}) AS content_hash FROM customer")
def canonical_content(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of nested JSON whose keys stand in no order, by its canonical form."""
    return table(spark, sf, "customer").select("c_custkey", digests.content_hash(F.expr(NESTED)).alias("content_hash"))


AS_OF = datetime(2024, 1, 20, 12)


@query(
    """WITH s AS (SELECT event_id, CASE WHEN event_id%10<>0 THEN ts + to_days((event_id%9)::int) END AS until, CASE WHEN event_id%13=0 THEN TIMESTAMP '2024-01-02' END AS purged, CASE WHEN event_id%13<>0 AND event_id%11<>0 THEN props END AS payload FROM events),
 d AS (SELECT *, until IS NOT NULL AND until < TIMESTAMP '2024-01-20 12:00:00' AND purged IS NULL AS due FROM s)
 SELECT 'row' AS part, event_id AS n, CASE WHEN due THEN NULL ELSE payload END AS payload, epoch_us(CASE WHEN due THEN TIMESTAMP '2024-01-20 12:00:00' ELSE purged END)::bigint AS purged_us FROM d
 UNION ALL SELECT 'considered', count(*) FILTER (due), NULL, NULL FROM d UNION ALL SELECT 'purged', count(*) FILTER (due), NULL, NULL FROM d UNION ALL SELECT 'missing', count(*) FILTER (due AND payload IS NULL), NULL, NULL FROM d
 UNION ALL SELECT 'days', count(DISTINCT until::date) FILTER (due), NULL, NULL FROM d UNION ALL SELECT 'again', 0, NULL, NULL"""
)
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    """A dry run, a purge and the same purge again over snapshots stored by day: the rows after it, and its counts."""
    e = table(spark, sf, "events")
    until = F.when(F.col("event_id") % 10 != 0, F.expr("cast(ts as timestamp) + make_dt_interval(cast(event_id % 9 as int))"))
    snapshots = e.select("event_id", until.alias("retention_until"), F.when(F.col("event_id") % 13 == 0, F.lit("2024-01-02").cast("timestamp")).alias("purged_at"), F.when((F.col("event_id") % 13 != 0) & (F.col("event_id") % 11 != 0), F.col("props")).alias("payload"))
    path = fresh_dir(spark, "snapshots")
    retention.store(snapshots, path)
    dry, done, again = (retention.purge(spark, path, AS_OF, apply) for apply in (False, True, True))
    counts = [("considered", dry.considered), ("purged", done.purged), ("missing", done.missing), ("days", len(done.rewritten)), ("again", again.considered + again.purged)]
    rows = retention.stored(spark, path).select(F.lit("row").alias("part"), F.col("event_id").alias("n"), "payload", us("purged_at").alias("purged_us"))
    said = spark.createDataFrame(counts, "part string, n long").withColumns({"payload": F.lit(None).cast("string"), "purged_us": F.lit(None).cast("long")})
    return rows.unionByName(said)


@query(
    """WITH i AS (SELECT doc_id, lang AS slice, source, text, list_distinct(list_filter(string_split(text,' '), lambda x: x<>'')) AS s, sha256(doc_id::varchar) AS h FROM documents),
 m AS (SELECT i.*, min(doc_id) OVER (PARTITION BY slice, source)%7 AS representative, round_even((doc_id%100)/100.0::double,2) AS similarity FROM i),
 n AS (SELECT slice, representative, count(*) AS members, count(DISTINCT source) AS entities, count(DISTINCT doc_id) AS documents, min(similarity) AS low, round_even(sum(similarity)/count(*),6) AS mean, min(doc_id) AS first_at, max(doc_id) AS last_at, sha256(string_agg(h,'|' ORDER BY h)) AS fingerprint FROM m GROUP BY 1, 2),
 x AS (SELECT slice, representative, t, count(*) AS c FROM (SELECT slice, representative, unnest(s) AS t FROM m) GROUP BY 1, 2, 3), g AS (SELECT x.slice, x.representative, string_agg(t, ',' ORDER BY t) AS signature FROM x JOIN n ON n.slice=x.slice AND n.representative=x.representative WHERE c=members GROUP BY 1, 2)
 SELECT n.slice, n.representative::varchar AS cluster, members::bigint AS members, entities::bigint AS entities, documents::bigint AS documents, low AS cohesion_min, mean AS cohesion_mean, first_at::bigint AS first_at, last_at::bigint AS last_at, fingerprint, coalesce(signature,'') AS signature,
  CASE WHEN members<=1 THEN 'insufficient_repetition' WHEN entities<=1 THEN 'within_entity_repeated' ELSE 'cross_entity_candidate' END AS status FROM n LEFT JOIN g ON g.slice=n.slice AND g.representative=n.representative"""
)
def cluster_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, cohesion, dates, fingerprint and signature of clusters, whose representatives recur from slice to slice."""
    d = table(spark, sf, "documents")
    items = d.select(F.col("doc_id").alias("id"), "text", F.array_distinct(F.filter(F.split("text", " "), lambda x: x != "")).alias("s"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"), F.col("source").alias("entity"), F.col("doc_id").alias("document"), F.col("doc_id").alias("at"))
    least = F.min("doc_id").over(Window.partitionBy("lang", "source")) % 7
    members = d.select(F.col("lang").alias("slice"), F.col("doc_id").cast("string").alias("id"), least.cast("string").alias("representative"), half_even((F.col("doc_id") % 100) / F.lit(100.0), 2).alias("similarity"))
    return mining.describe_clusters(members, items).drop("label")
