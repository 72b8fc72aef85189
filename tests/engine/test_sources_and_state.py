import json
from datetime import datetime

from pyspark.sql import functions as F

from evidentia.operators import decisions, evidence, latest, lineage, ops
from evidentia.sources import ingest, normalize
from evidentia.streaming import incremental

T0 = datetime(2026, 1, 1)


def day(n):
    return datetime(2026, 1, n)


def test_same_payload_twice(spark):
    cols = "source string, external_type string, external_id string, content_hash string, observed_at timestamp, item_id long"
    a = spark.createDataFrame([("s", "t", "1", "h", day(1), 1)], cols)
    new, seen = ingest.dedup(a, a.limit(0))
    assert new.count() == 1
    new2, seen2 = ingest.dedup(a.withColumn("item_id", F.lit(2)), new)
    assert new2.count() == 0 and [r.is_duplicate for r in seen.union(seen2).collect()] == [False, True]


def test_schema_drift_and_timestamps(spark):
    rows = [(1, day(1), '{"a": 1, "b": null}'), (2, day(2), '{"a": "x", "b": 2, "c": []}'), (3, day(3), '{"a": "x", "b": 2}')]
    d = ingest.schema_drift(spark.createDataFrame(rows, "id long, at timestamp, p string").withColumn("k", F.lit(1)), ["k"], "p", "at", "id").orderBy("id").collect()
    assert [(r.added, r.removed, r.changed, r.severity) for r in d] == [("c", "", "a", "warning"), ("", "c", "", "info")]
    flags = spark.createDataFrame([(day(9), day(1), day(2))], "c timestamp, u timestamp, o timestamp").select(ingest.timestamp_flags(F.col("c"), F.col("u"), F.col("o")).alias("f")).first().f
    assert flags == ["created_in_future", "updated_before_created"]


def test_normalizers(spark):
    items = [
        {"id": 1, "number": 7, "repository_url": "https://api.github.com/repos/A/B", "title": " Broken ", "labels": [{"name": "Bug"}], "comments": 2, "user": {"login": "dep[bot]", "type": "User"}, "created_at": "2026-01-01T00:00:00Z"},
        {"id": 2, "number": 8, "repository_url": "https://api.github.com/repos/A/B", "title": "", "pull_request": {"url": "x"}, "created_at": "nope"},
    ]
    raw = spark.createDataFrame([(i, T0, json.dumps(x)) for i, x in enumerate(items)], "snapshot_id long, observed_at timestamp, payload string")
    a, b = normalize.work_items(raw).orderBy("snapshot_id").collect()
    assert (a.repository, a.title, a.is_bot, a.is_pull_request, a.labels, a.error_class) == ("a/b", "Broken", True, False, ["bug"], None)
    assert b.is_pull_request and b.error_class == "missing_title"
    pkg = {"name": "p", "repository": {"url": "git+https://github.com/X/Y.git"}, "dist-tags": {"latest": "2.0"}, "time": {"1.0": "2025-01-01T00:00:00Z"}, "versions": {"1.0": {"name": "p", "version": "1.0", "license": "MIT"}, "2.0": {"license": "ISC"}}}
    raw = spark.createDataFrame([(1, T0, json.dumps(pkg)), (2, day(2), json.dumps(pkg | {"versions": {"1.0": {"license": "changed"}}}))], "snapshot_id long, observed_at timestamp, payload string")
    p = normalize.packages(raw).orderBy("snapshot_id").first()
    assert (p.repository, p.match_method, p.latest_version, p.n_versions) == ("x/y", "github_https_url", "2.0", 2)
    assert {r.version: r.license for r in normalize.package_versions(raw).collect()} == {"1.0": "MIT", "2.0": "ISC"}
    q = {"site": "so", "question_id": 5, "title": "A &lt; B", "body": "<p>x</p>", "tags": ["B", "a", "a"], "creation_date": 0, "answer_count": -1}
    r = normalize.questions(spark.createDataFrame([(1, T0, json.dumps(q))], "snapshot_id long, observed_at timestamp, payload string")).first()
    assert (r.external_id, r.title, r.body, r.tags, r.answers, r.error_class) == ("so:5", "A < B", "x", ["a", "b"], 0, None)


def test_late_rows_lose_and_ties_win(spark):
    rows = [("k", day(2), 1, "first"), ("k", day(1), 2, "late"), ("k", None, 3, "unknown"), ("k", day(2), 4, "tie")]
    df = spark.createDataFrame(rows, "k string, updated timestamp, arrival int, v string")
    assert normalize.merge_late(df, ["k"], "updated", "arrival").first().v == "tie"


def test_as_of_is_strict_or_not(spark):
    left = spark.createDataFrame([("a", day(3)), ("b", day(3))], "k string, t timestamp")
    right = spark.createDataFrame([("a", day(3), 2), ("a", day(1), 1)], "k string, u timestamp, v int")
    at = lambda inc: {r.k: r.got for r in latest.as_of_join(left, right, ["k"], "t", "u", "v", "got", inc).collect()}
    assert at(True) == {"a": 2, "b": None} and at(False) == {"a": 1, "b": None}


def test_alert_states(spark):
    old = spark.createDataFrame([("a", "open", day(1), day(1)), ("b", "resolved", day(1), day(1)), ("c", "open", day(1), day(1))], "alert_key string, status string, first_at timestamp, last_at timestamp")
    want = spark.createDataFrame([("a", "warning"), ("b", "critical"), ("d", "warning")], "alert_key string, severity string")
    got = {r.alert_key: (r.action, r.first_at) for r in latest.full_merge_state(old, want, "alert_key", F.lit(day(5))).collect()}
    assert got == {"a": ("refreshed", day(1)), "b": ("reopened", day(5)), "c": ("resolved", day(1)), "d": ("opened", day(5))}


def test_retention_budget_and_schedule(spark):
    s = spark.createDataFrame([(1, day(1), None, "x"), (2, day(9), None, "y")], "id int, retention_until timestamp, purged_at timestamp, payload string")
    assert ops.retention(s, F.lit(day(5))).count() == 1
    done = ops.retention(s, F.lit(day(5)), apply=True).orderBy("id").collect()
    assert done[0].payload is None and done[0].purged_at == day(5) and done[1].payload == "y"
    r = spark.range(1).select(ops.budget_guard(F.lit(4.0), F.lit(2.0), F.lit(5.0)).alias("b"), ops.next_fire(F.lit(day(1)), 1440, F.lit(day(3))).alias("n")).first()
    assert r.b == "rejected" and r.n == day(4)


def test_lineage_and_history(spark):
    c = lambda rows: spark.createDataFrame(rows, "cluster string, member long")
    t = lambda rows: spark.createDataFrame(rows, "cluster string, token string")
    prev, cur = c([("p", i) for i in range(5)] + [("gone", 99), ("alike", 50), ("none", 60)]), c([("q", i) for i in range(6)] + [("new", 77), ("same", 51), ("empty", 61)])
    tokens = t([("p", "a"), ("p", "b"), ("gone", "g"), ("alike", "x"), ("alike", "y")]), t([("q", "a"), ("new", "n"), ("same", "x"), ("same", "y")])
    related = lineage.relations(prev, cur, *tokens)
    got = {(r.previous, r.current): (r.relation, r.member_jaccard, r.signature_jaccard) for r in related.collect()}
    want = {("p", "q"): ("stable", 0.833333, 0.5), ("alike", "same"): ("evolved", 0.0, 1.0), ("none", "empty"): ("evolved", 0.0, 1.0)}
    assert got == want | {(None, "new"): ("new", None, None), ("gone", None): ("disappeared", None, None)}
    n = lineage.stability(related).first()
    assert (n.matched_clusters, n.current_clusters, n.mean_best_member_jaccard, n.split_relations) == (3, 4, 0.208333, 0)
    edges = spark.createDataFrame([(3, 2), (2, 1), (1, 3)], "child long, parent long")
    assert lineage.histories(spark, edges, spark.createDataFrame([(3,)], "node long"), depth=4).count() == 5


def test_independence_levels(spark):
    o = spark.createDataFrame([("x", "a", 1, 1), ("x", "b", 2, 2), ("y", "a", 1, 1), ("z", "a", 1, 1), ("z", "c", 1, 3), ("w", "q", 1, 1)], "cluster string, source string, entity int, content int")
    s = spark.createDataFrame([("a", "g1", "independent"), ("b", "g2", "independent"), ("c", "g3", "independent")], "source string, grp string, status string")
    rel = spark.createDataFrame([("a", "c", "mirror", "blocks", "same_entity")], "low string, high string, type string, effect string, scope string")
    got = {r.cluster: (r.level, r.blockers) for r in evidence.independence(o, s, rel).collect()}
    assert got == {"x": ("E2", ""), "y": ("E1", "single_source"), "z": ("unverified_cross_source", "relationship:mirror:blocks"), "w": ("unknown", "source_registry_incomplete")}


def test_latest_audit_wins(spark):
    audits = spark.createDataFrame([("c", day(1), 1, 2, 2), ("c", day(2), 2, 2, 1)], "cluster string, at timestamp, audit_id int, sampled int, coherent int")
    r = evidence.quality_gate(audits, spark.createDataFrame([("c",)], "cluster string")).first()
    assert (r.purity, r.status) == (0.5, "insufficient_audits")


def test_fit_rank_and_backtest(spark):
    a = spark.createDataFrame([(1, 800.0, None, "crm"), (2, 800.0, None, "game"), (3, None, None, None)], "id int, cost double, weeks double, category string")
    got = {r.id: r for r in decisions.profile_fit(a, {"cost": 1000, "weeks": 10}, {"category": ["game"]}).collect()}
    assert got[1].fit == 1.0 and got[1].unknown == "weeks" and got[2].fit == 0.0 and got[3].fit is None
    rows = [(i, 0.001 * (i % 50), "rankable" if i % 3 else "blocked") for i in range(200)]
    ranked = decisions.rank(spark.createDataFrame(rows, "id int, total_score double, status string"), "id", bins=7).collect()
    want = sorted((r for r in rows if r[2] == "rankable"), key=lambda r: (-r[1], -r[0]))
    assert [r.id for r in sorted((x for x in ranked if x.rank), key=lambda x: x.rank)] == [r[0] for r in want]
    assert all(r.reason == "blocked" and r.rank is None for r in ranked if r.status != "rankable")
    r = decisions.backtest(spark.createDataFrame([(0.9, 1)], "p double, y int"), 0.5).first()
    assert (r.status, r.brier, r.baseline_brier) == ("insufficient_sample", 0.01, 0.25)


def test_streams_take_only_what_is_new(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.createDataFrame([(i % 3, day(1 + i % 2), float(i)) for i in range(6)], "k int, ts timestamp, v double")
    rows.coalesce(1).write.mode("append").parquet(src)
    flow = lambda: incremental.run_available(incremental.dedup_stream(incremental.read_stream(spark, src, rows), ["k"], "ts"), out, ck)
    flow()
    assert spark.read.parquet(out).count() == 3
    rows.coalesce(1).write.mode("append").parquet(src)
    flow()
    assert spark.read.parquet(out).count() == 3
