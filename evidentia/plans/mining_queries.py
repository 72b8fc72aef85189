"""Raw records, text evidence, similarity, clusters, lineage and independence over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions.exprs import digest, set_digest
from evidentia.operators import evidence, lineage, mining
from evidentia.plans.issue_queries import ISSUE_SQL, issues
from evidentia.plans.registry import query, table, wilson_sql
from evidentia.sources import ingest, normalize

us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

RAW_SQL = """SELECT event_id AS item_id, user_id%5 AS source, event_type AS external_type, user_id::varchar AS external_id, sha256(coalesce(props,'')) AS content_hash, ts AS observed_at FROM events"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("item_id"), (F.col("user_id") % 5).alias("source"), F.col("event_type").alias("external_type"), F.col("user_id").cast("string").alias("external_id"),
        F.sha2(F.coalesce("props", F.lit("")), 256).alias("content_hash"), F.col("ts").alias("observed_at"), F.col("props").alias("payload"),
    )


@query(f"""WITH r AS ({RAW_SQL}), s AS (SELECT DISTINCT source, external_type, external_id, content_hash FROM r WHERE item_id%10=0)
 SELECT item_id, (row_number() OVER (PARTITION BY source, external_type, external_id, content_hash ORDER BY observed_at, item_id) > 1)
  OR EXISTS (SELECT 1 FROM s WHERE s.source=r.source AND s.external_type=r.external_type AND s.external_id=r.external_id AND s.content_hash=r.content_hash) AS is_duplicate FROM r""")
def dedup_observations(spark: SparkSession, sf: str) -> DataFrame:
    r = _raw(spark, sf)
    return ingest.dedup(r, r.where("item_id % 10 = 0"))[1].select("item_id", "is_duplicate")


@query(f"""WITH r AS ({RAW_SQL}), d AS (SELECT source, row_number() OVER (PARTITION BY source, external_type, external_id, content_hash ORDER BY observed_at, item_id) > 1 AS dup FROM r)
 SELECT source AS run, count(*) AS items, count(*) FILTER (dup) AS duplicates, count(*)>=10 AND count(*) FILTER (dup) >= 0.8*count(*) AS flagged FROM d GROUP BY 1""")
def duplicate_ratio(spark: SparkSession, sf: str) -> DataFrame:
    r = _raw(spark, sf)
    return ingest.duplicate_ratio(ingest.dedup(r, r.limit(0))[1].withColumn("run", F.col("source")), "run")


@query("""SELECT user_id, event_type, arg_max(event_id, struct_pack(t:=CASE WHEN event_id%4<>0 THEN ts ELSE TIMESTAMP '0001-01-01' END, e:=event_id)) AS event_id FROM events GROUP BY 1,2""")
def late_update_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("updated_at"), F.col("event_id").alias("arrival"))
    return normalize.merge_late(e, ["user_id", "event_type"], "updated_at", "arrival").select("user_id", "event_type", "event_id")


MIXED = "CASE event_id%4 WHEN 0 THEN props WHEN 1 THEN '{\"k\": \"x\", \"a\": [1]}' WHEN 2 THEN '{\"k\": null, \"b\": {\"z\": 1}}' ELSE '{\"k\": true}' END"


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 4
    payload = F.when(m == 0, F.col("props")).when(m == 1, '{"k": "x", "a": [1]}').when(m == 2, '{"k": null, "b": {"z": 1}}').otherwise('{"k": true}')
    return table(spark, sf, "events").select("event_id", "event_type", "ts", payload.alias("payload"))


TYPES = "CASE json_type(p, '$.'||k) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END"


@query(f"""WITH e AS (SELECT event_type, ts, {MIXED} AS p FROM events), f AS (SELECT event_type, ts, array_to_string(list_sort(list_transform(json_keys(p), lambda k: k||':'||{TYPES})),',') AS fields FROM e)
 SELECT event_type, fields, epoch_us(min(ts))::bigint AS first_us, epoch_us(max(ts))::bigint AS last_us, count(*) AS items FROM f GROUP BY 1,2""")
def json_schema_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = ingest.schema_profiles(_mixed(spark, sf), ["event_type"], "payload", "ts")
    return p.select("event_type", "fields", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "items")


@query(f"""WITH e AS (SELECT event_id, event_type, ts, {MIXED} AS p FROM events), t AS (SELECT event_id, event_type, ts, json_keys(p) AS ks, list_transform(json_keys(p), lambda k: k||':'||{TYPES}) AS kt FROM e),
 w AS (SELECT *, lag(ks) OVER o AS wks, lag(kt) OVER o AS wkt FROM t WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)),
 d AS (SELECT event_id, event_type, list_filter(ks, lambda k: NOT list_contains(wks,k)) AS a, list_filter(wks, lambda k: NOT list_contains(ks,k)) AS r,
  list_filter(ks, lambda k: list_contains(wks,k) AND len(list_filter(kt, lambda x: split_part(x,':',1)=k AND NOT list_contains(wkt,x) AND x<>k||':null'))>0 AND NOT list_contains(wkt,k||':null')) AS c FROM w WHERE wks IS NOT NULL)
 SELECT event_id, event_type, array_to_string(list_sort(a),',') AS added, array_to_string(list_sort(r),',') AS removed, array_to_string(list_sort(c),',') AS changed, CASE WHEN len(c)>0 THEN 'warning' ELSE 'info' END AS severity
 FROM d WHERE len(a)+len(r)+len(c)>0""")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    d = ingest.schema_drift(_mixed(spark, sf), ["event_type"], "payload", "ts", "event_id")
    return d.select("event_id", "event_type", "added", "removed", "changed", "severity")


@query("""SELECT event_id, CASE WHEN event_id%9=0 THEN 'missing_external_type' WHEN event_id%9=1 THEN 'missing_external_id' WHEN event_id%9=2 THEN 'identity_field_too_long'
  WHEN event_id%9=3 THEN 'empty_payload' WHEN event_id%9=4 THEN 'non_json_payload' END AS reject_reason FROM events""")
def route_items(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 9
    items = table(spark, sf, "events").select(
        "event_id", F.when(m == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("external_type"), F.when(m == 2, F.repeat(F.lit("x"), F.lit(300))).when(m != 1, F.col("user_id").cast("string")).alias("external_id"),
        F.when(m == 3, "{}").when(m == 4, "{oops").otherwise(F.col("props")).alias("payload"),
    )
    return ingest.route(items).select("event_id", "reject_reason")


STEM_SQL = "CASE y " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.ALIASES.items()) + " ELSE y END"
TOKEN_SQL = r"""list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9_.+-]*'), lambda x: regexp_replace(x, '^[._+-]+|[._+-]+$', '', 'g')), lambda y: {stem}),
 lambda x: length(x)>=3 AND NOT regexp_matches(x,'^[0-9]+$') AND x NOT IN ({stop})))""".replace("{stop}", ",".join(f"'{w}'" for w in X.STOP_WORDS)).replace("{stem}", STEM_SQL)


@query(f"""WITH t AS (SELECT source, unnest({TOKEN_SQL.replace("{t}", "text")}) AS token FROM documents) SELECT token, count(*) AS documents, count(DISTINCT source) AS sources FROM t GROUP BY 1 HAVING count(*) >= 5""")
def token_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and sources of every token that at least five documents use."""
    t = table(spark, sf, "documents").select("source", F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources")).where("documents >= 5")


@query(f"""WITH s AS (SELECT item_id AS id, {TOKEN_SQL.replace("{t}", "text")} AS s FROM benchmark UNION ALL SELECT 100000+conv_id*100+turn, {TOKEN_SQL.replace("{t}", "text")} FROM conversations
  UNION ALL SELECT id, {TOKEN_SQL.replace("{t}", "t")} FROM (SELECT 10000000+min(document_id) AS id, t FROM (SELECT document_id, title||' '||coalesce(body,'') AS t FROM ({ISSUE_SQL})) GROUP BY t)), k AS (SELECT id, s, len(s) AS n FROM s WHERE len(s)>0),
 p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s,b.s)) AS shared, a.n AS na, b.n AS nb FROM k a JOIN k b ON a.id<b.id AND least(a.n,b.n) >= 0.6*greatest(a.n,b.n))
 SELECT a, b, shared::bigint AS shared, round_even(shared::double/(na+nb-shared),6) AS similarity FROM p WHERE ((shared=na AND na=nb) OR shared>=2) AND round_even(shared::double/(na+nb-shared),6)>=0.6""")
def token_similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All similar pairs among benchmark items, turns of conversations and texts of work items, by a prefix-filtered join."""
    t = lambda df, i: df.select(i.alias("id"), X.tokens(F.col("text")).alias("s"))
    items = t(table(spark, sf, "benchmark"), F.col("item_id")).unionByName(t(table(spark, sf, "conversations"), 100000 + F.col("conv_id") * 100 + F.col("turn")))
    return mining.similar_pairs(items.unionByName(t(_issue_texts(spark, sf), F.col("id"))), "id", "s")


def _issue_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of a work item once, with the least of its numbers."""
    d = issues(spark, sf).select("document_id", F.concat("title", F.lit(" "), F.coalesce("body", F.lit(""))).alias("text"))
    return d.groupBy("text").agg((10_000_000 + F.min("document_id")).alias("id"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("part")).unionByName(_issue_texts(spark, sf).select("id", "text", F.lit("issues").alias("part")))
    items = both.select(F.col("id").cast("string").alias("id"), X.tokens(F.col("text")).alias("s"), "part")
    return mining.star_clusters(items.withColumn("h", digest(F.col("id"))), "id", "s", "h", "part")


@query()
def star_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)


SIG = "SELECT source AS cluster, lang AS entity, {t} AS s FROM documents"


@query(f"""WITH d AS ({SIG.replace("{t}", TOKEN_SQL.replace("{t}", "text"))}), n AS (SELECT cluster, count(*) AS members, count(DISTINCT entity) AS e FROM d GROUP BY 1),
 x AS (SELECT cluster, token, count(*) AS c FROM (SELECT cluster, unnest(s) AS token FROM d) GROUP BY 1,2), g AS (SELECT x.cluster, string_agg(token, ',' ORDER BY token) AS sig FROM x JOIN n USING (cluster) WHERE c=members GROUP BY 1)
 SELECT cluster, members, coalesce(sig,'') AS signature, CASE WHEN members<=1 THEN 'insufficient_repetition' WHEN e<=1 THEN 'within_entity_repeated' ELSE 'cross_entity_candidate' END AS status FROM n LEFT JOIN g USING (cluster)""")
def cluster_signature(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("entity"), X.tokens(F.col("text")).alias("s"))
    e = d.groupBy("cluster").agg(F.count_distinct("entity").alias("e"))
    return mining.signatures(d, "cluster", "s").join(e, "cluster").select("cluster", "members", "signature", mining.cluster_status(F.col("members"), F.col("e")).alias("status"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS child, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events WHERE event_type='purchase'),
 w AS (SELECT event_id AS node, event_id AS ancestor, 0 AS steps FROM events WHERE event_type='purchase' UNION ALL SELECT w.node, e.parent, steps+1 FROM w JOIN e ON e.child=w.ancestor WHERE e.parent IS NOT NULL AND steps<50)
 SELECT node, ancestor, steps::bigint AS steps FROM w""")
def lineage_history_recursive(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf, "events").where("event_type = 'purchase'")
    edges = p.select(F.col("event_id").alias("child"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("parent")).where("parent is not null")
    return lineage.histories(spark, edges, p.select(F.col("event_id").alias("node")))


# Sources by number: seven groups, every fourth affiliated, and the first two of each ten mirror each other.
SOURCE_SQL = "SELECT source, 'g'||(substr(source,4)::int%7) AS grp, CASE WHEN substr(source,4)::int%4=3 THEN 'affiliated' ELSE 'independent' END AS status, substr(source,4)::int AS k FROM (SELECT DISTINCT source FROM documents)"


@query(f"""WITH o AS (SELECT quality*1000+toxic*100+doc_id%37 AS cluster, source, lang AS entity FROM documents JOIN labels USING (doc_id)), s AS ({SOURCE_SQL}),
 b AS (SELECT cluster, count(DISTINCT o.source) AS n_sources, count(DISTINCT grp) AS g, list_distinct(list('source_status:'||o.source||':'||status) FILTER (status<>'independent')) AS st FROM o JOIN s USING (source) GROUP BY 1),
 r AS (SELECT DISTINCT x.cluster FROM o x JOIN s xs ON xs.source=x.source JOIN o y ON x.cluster=y.cluster AND x.entity=y.entity JOIN s ys ON ys.source=y.source WHERE xs.k%10=0 AND ys.k=xs.k+1),
 q AS (SELECT b.cluster, n_sources, list_sort(list_concat(list_concat(CASE WHEN g<2 THEN ['shared_independence_group'] ELSE [] END, coalesce(st,[])), CASE WHEN r.cluster IS NOT NULL THEN ['relationship:mirror:blocks'] ELSE [] END)) AS bl FROM b LEFT JOIN r ON r.cluster=b.cluster)
 SELECT cluster, n_sources, CASE WHEN n_sources=1 THEN 'E1' WHEN len(bl)=0 THEN 'E2' ELSE 'unverified_cross_source' END AS level, CASE WHEN n_sources=1 THEN 'single_source' ELSE array_to_string(bl,',') END AS blockers FROM q""")
def independence_level(spark: SparkSession, sf: str) -> DataFrame:
    """Level of independence of the sources behind every cluster of labelled documents."""
    o = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    o = o.select((F.col("quality") * 1000 + F.col("toxic") * 100 + F.col("doc_id") % 37).alias("cluster"), "source", F.col("lang").alias("entity"), F.col("doc_id").alias("content"))
    number = F.substring("source", 4, 9).cast("int")
    sources = table(spark, sf, "documents").select("source").distinct().select("source", F.concat(F.lit("g"), (number % 7).cast("string")).alias("grp"), F.when(number % 4 == 3, "affiliated").otherwise("independent").alias("status"), number.alias("k"))
    mirror = sources.where("k % 10 = 0").select(F.col("source").alias("low"), F.concat(F.lit("src"), (F.col("k") + 1).cast("string")).alias("high"))
    rel = mirror.select("low", "high", F.lit("mirror").alias("type"), F.lit("blocks").alias("effect"), F.lit("same_entity").alias("scope"))
    return evidence.independence(o, sources.drop("k"), rel)


@query("""WITH d AS (SELECT doc_id, text, regexp_extract(text, '(?i)license[a-z]*') AS m FROM documents) SELECT doc_id, length(string_split(text, m)[1])::bigint AS start, m AS matched FROM d WHERE m<>''""")
def span_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """First place of a rule in each text, in characters."""
    e = mining.evidence(table(spark, sf, "documents"), fields=("text",), rules=(("license", "license", 0.9, "license[a-z]*"),), problems=False)
    return e.groupBy("doc_id").agg(F.min(F.struct("start", "matched")).alias("m")).select("doc_id", F.col("m.start").cast("long").alias("start"), "m.matched")


@query(r"""SELECT page_id, regexp_extract(url,'^([a-z]+)://',1) AS scheme, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) AS host, regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1) AS path,
 len(list_filter(string_split(regexp_extract(url,'^[a-z]+://[^/?#]+([^?#]*)',1),'/'), lambda x: x<>''))::bigint AS segments FROM pages""")
def url_parse(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.coalesce(F.try_parse_url("url", F.lit(p)), F.lit(""))
    p = table(spark, sf, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"))
    return p.withColumn("segments", F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("long"))


BLOCKS = "|".join(X.BLOCK_TAGS)
STRIP_SQL = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?s)<!--.*?-->','','g'),'(?i)<(?:{BLOCKS})(?:\s[^>]*)?/>',chr(10)||chr(10),'g'),'(?i)</?(?:{BLOCKS})(?:\s[^>]*)?>',chr(10),'g'),'<[/!?]?[A-Za-z][^>]*>','','g')"""


@query(rf"""SELECT page_id, length(trim(regexp_replace({STRIP_SQL},'[ \t\r\f\x0B]+',' ','g'),' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)))::bigint AS n_text, length(html)::bigint AS n_html FROM pages""")
def html_text_profile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.length(X.collapse_blanks(X.strip_tags(F.col("html")))).cast("long").alias("n_text"), F.length("html").cast("long").alias("n_html"))


@query()
def html_text_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


QLOW, QHIGH = wilson_sql("coherent", "sampled")


@query(f"""WITH a AS (SELECT user_id AS cluster, arg_max(event_id%11, struct_pack(t:=ts,e:=event_id)) AS coherent FROM events GROUP BY 1), e AS (SELECT DISTINCT user_id AS cluster FROM events),
 n AS (SELECT count(*) AS eligible, count(coherent) AS audited, coalesce(sum(CASE WHEN coherent IS NOT NULL THEN 10 END),0)::bigint AS sampled, coalesce(sum(least(coherent,10)),0)::bigint AS coherent, count(*) FILTER (least(a.coherent,10)>=8) AS coherent_clusters FROM e LEFT JOIN a USING (cluster)),
 m AS (SELECT *, round_even(audited::double/eligible,6) AS coverage, round_even(coherent::double/sampled,6) AS purity, {QLOW} AS purity_low, {QHIGH} AS purity_high, round_even(coherent_clusters::double/audited,6) AS coherence FROM n)
 SELECT *, CASE WHEN eligible=0 THEN 'insufficient_clusters' WHEN audited<20 OR coverage<0.2 THEN 'insufficient_audits' WHEN purity<0.8 OR coherence<0.8 THEN 'below_quality_threshold' ELSE 'passed' END AS status FROM m""")
def quality_gate_wilson(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    audits = e.select(F.col("user_id").alias("cluster"), F.col("ts").alias("at"), F.col("event_id").alias("audit_id"), F.lit(10).alias("sampled"), F.least(F.col("event_id") % 11, F.lit(10)).alias("coherent"))
    return evidence.quality_gate(audits, e.select(F.col("user_id").alias("cluster")))


@query("""WITH c AS (SELECT source AS claim, sha256(string_agg(doc_id::varchar,'|' ORDER BY doc_id::varchar)) AS fingerprint FROM documents GROUP BY 1), f AS (SELECT source AS claim, sha256(string_agg(doc_id::varchar,'|' ORDER BY doc_id::varchar)) AS fingerprint FROM documents WHERE source<>'src1' AND NOT (source='src2' AND lang='en') GROUP BY 1)
 SELECT c.claim, c.fingerprint, CASE WHEN f.fingerprint IS NULL THEN 'created' WHEN f.fingerprint=c.fingerprint THEN 'reused' ELSE 'superseded' END AS action, CASE WHEN f.fingerprint<>c.fingerprint THEN f.fingerprint END AS supersedes FROM c LEFT JOIN f USING (claim)""")
def claim_supersession(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    mark = lambda df: df.groupBy(F.col("source").alias("claim")).agg(set_digest(F.col("doc_id").cast("string")).alias("fingerprint"))
    return evidence.claims(mark(d), mark(d.where("source <> 'src1' and not (source = 'src2' and lang = 'en')")))
