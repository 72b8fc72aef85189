"""Histories, purges, digests and cluster descriptions in small cases."""

import hashlib
import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from evidentia.operators import digests, lineage, mining, retention


def day(n, hour=0):
    return datetime(2026, 1, n, hour)


def test_one_relation_a_step_newest_run_first(spark):
    """Two candidates, a tie by id, a split that doesn't count, a cycle, and a walk that is cut."""
    rows = [
        (1, day(1), "a", "b", "stable"), (2, day(2), "x", "b", "evolved"), (3, day(3), "y", "b", "split"), (4, day(1), "p", "x", "stable"), (5, day(1), "q", "x", "evolved"), (6, day(1), None, "q", "new"),
        (7, day(1), "d", "c", "stable"), (8, day(1), "c", "d", "stable"),
    ]
    r = spark.createDataFrame(rows, "id int, finished_at timestamp, previous string, current string, relation string")
    start = spark.createDataFrame([("b",), ("c",), ("lone",)], "node string")
    got = sorted((x.node, x.steps, x.ancestor) for x in lineage.stable_histories(r, start).collect())
    assert got == [("b", 0, "b"), ("b", 1, "x"), ("b", 2, "q"), ("c", 0, "c"), ("c", 1, "d"), ("lone", 0, "lone")]
    assert max(x.steps for x in lineage.stable_histories(r, start, depth=1).collect()) == 1


def test_histories_have_no_limit_on_rows_and_take_few_rounds(spark):
    """A chain, and a cycle behind a tail, under a limit on recursion that is lower than the rows."""
    chain = [(i, i - 1) for i in range(1, 130)] + [(1000, 1001), (1001, 1002), (1002, 1001)]
    edges = spark.createDataFrame(chain, "child long, parent long")
    start = spark.createDataFrame([(129,), (60,), (1000,)], "node long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 40)
    try:
        got = sorted((r.node, r.steps, r.ancestor) for r in lineage.histories(spark, edges, start, depth=100).collect())
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    cycle = [1000, *[1001 + i % 2 for i in range(100)]]
    assert got == [*[(60, i, 60 - i) for i in range(61)], *[(129, i, 129 - i) for i in range(101)], *[(1000, i, x) for i, x in enumerate(cycle)]]
    r = edges.selectExpr("child as id", "child as finished_at", "parent as previous", "child as current", "'stable' as relation")
    got = sorted((x.node, x.steps, x.ancestor) for x in lineage.stable_histories(r, start).collect())
    assert got == [*[(60, i, 60 - i) for i in range(52)], *[(129, i, 129 - i) for i in range(52)], (1000, 0, 1000), (1000, 1, 1001), (1000, 2, 1002)]


def test_last_run_of_each_time_counts(spark):
    h = spark.createDataFrame([("n", "n"), ("n", "old")], "node string, ancestor string")
    o = [("n", "m", day(3), day(3), 1, "measured", 3.0), ("n", "m", day(3), day(4), 2, "measured", 4.0), ("old", "m", day(1), day(1), 3, "measured", 1.0), ("old", "m", day(2), day(2), 4, "insufficient_sample", 9.0), ("other", "m", day(5), day(5), 5, "measured", 7.0)]
    points = lineage.history_points(h, spark.createDataFrame(o, "cluster string, metric string, as_of timestamp, finished_at timestamp, run_id int, status string, value double"))
    assert sorted((r.as_of, r.value) for r in points.collect()) == [(day(1), 1.0), (day(3), 4.0)]
    s = lineage.history_signals(points).first()
    assert (s.points, s.first_at, s.last_at, s.anomaly_status, s.season_status, s.slope) == (2, day(1), day(3), "insufficient_history", "insufficient_history", None)


SNAPSHOT = "id int, retention_until timestamp, purged_at timestamp, payload string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_purge_rewrites_only_what_expires(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(1, day(1, 3), None, "x"), (2, day(1, 4), day(1), None), (3, day(5, 1), None, "y"), (4, day(5, 23), None, "z"), (5, day(9), None, "w"), (6, None, None, "v"), (7, day(1, 5), None, None)]
    retention.store(spark.createDataFrame(rows, SNAPSHOT), path)
    before = files(path)
    dry = retention.purge(spark, path, day(5, 12))
    assert (dry.considered, dry.purged, dry.applied) == (3, 0, False) and files(path) == before
    done = retention.purge(spark, path, day(5, 12), apply=True)
    assert (done.considered, done.purged, done.missing, done.errors, done.rewritten) == (3, 3, 1, 0, ("2026-01-01", "2026-01-05"))
    got = {r.id: (r.purged_at, r.payload) for r in retention.stored(spark, path).collect()}
    at = day(5, 12)
    assert got == {1: (at, None), 2: (day(1), None), 3: (at, None), 4: (None, "z"), 5: (None, "w"), 6: (None, "v"), 7: (at, None)}
    kept = {f for f in before if "01-09" in f or "9999" in f}
    after = files(path)
    assert kept and kept <= after
    again = retention.purge(spark, path, day(5, 12), apply=True)
    assert (again.considered, again.purged, again.rewritten) == (0, 0, ()) and files(path) == after


def test_row_under_a_wrong_day_is_an_error(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, day(3), None, "x"), (2, day(1), None, "y")], SNAPSHOT).withColumn(retention.DAY, F.lit("2026-01-01"))
    rows.write.partitionBy(retention.DAY).parquet(path)
    done = retention.purge(spark, path, day(9), apply=True)
    assert (done.considered, done.purged, done.errors) == (2, 1, 1)
    assert {r.id: r.payload for r in retention.stored(spark, path).collect()} == {1: "x", 2: None}


def test_digest_task_sorts_chunks_and_not_rows(spark):
    """Keys that go on over several ranges and chunks, with empty and null parts; the task of a chain gets joined text alone."""
    df = spark.range(30_000).selectExpr("id % 2 as k", "id * 7919 % 30000 as o", "case id % 5 when 0 then '' when 1 then null else cast(id as string) end as v")
    rows = sorted(df.collect(), key=lambda r: r.o)
    for keys in (["k"], []):
        found = digests.ordered_digest(df, keys, ["o"], F.col("v"))
        assert "_o0" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.k if keys else None: (r.digest, r.parts) for r in found.collect()}
        for k in (0, 1) if keys else (None,):
            parts = [r.v for r in rows if r.v is not None and k in (None, r.k)]
            assert got[k] == (hashlib.sha256("|".join(parts).encode()).hexdigest(), len(parts))
        assert len(got) == len(keys) + 1


def test_ordered_digest(spark):
    rows = [("a", 2, "y"), ("a", 1, "x"), ("b", 1, None), ("b", 2, "ä|"), (None, 1, "n"), ("a", 3, "z")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
    got = {r.k: (r.digest, r.parts) for r in digests.ordered_digest(df, ["k"], ["o"], F.col("v")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"a": (sha("x|y|z"), 3), "b": (sha("ä|"), 1), None: (sha("n"), 1)}
    many = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("id"))
    r = digests.ordered_digest(many, [], ["id"], F.col("id")).first()
    assert r.digest == sha("|".join(map(str, sorted(i * 7919 % 50_021 for i in range(50_000))))) and r.parts == 50_000
    assert digests.ordered_digest(df.limit(0), ["k"], ["o"], F.col("v")).count() == 0


def test_canonical_json(spark):
    texts = ['{"b":1,"a":{"d":[{"z":1,"y":2.50}],"c":"é\\u00e9\\ud83d\\ude00"}}', "[1e5, 1.0, -0.0, 12345678901234567890123, 1e-7]", '"plain"', '{"k":1,"k":2}', "{broken", None, "NaN", '{"\\uff5e":1,"😀":2}', "null", '{"a":' * 100 + "1" + "}" * 100]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", digests.canonical_json_text(F.col("t")).alias("c")).orderBy("i").collect()]
    plain = lambda t: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert got == [None if t in (None, "{broken", "NaN") else plain(t) for t in texts]


def test_descriptions_keep_slices_apart(spark):
    """One id in two slices: each slice has its own members and signature."""
    members = spark.createDataFrame([("p", "1", "1", 1.0), ("q", "1", "1", 1.0), ("q", "2", "1", 0.7)], "slice string, id string, representative string, similarity double")
    items = spark.createDataFrame([(1, "one", ["a", "b", "c"], "h1", "e1", "d1", day(1)), (2, "two", ["a", "x"], "h2", "e2", "d2", day(2))], "id int, text string, s array<string>, h string, entity string, document string, at timestamp")
    got = {r.slice: (r.members, r.entities, r.signature, r.label, r.cohesion_min, r.cohesion_mean, r.status) for r in mining.describe_clusters(members, items).collect()}
    assert got == {"p": (1, 1, "a,b,c", "one", 1.0, 1.0, "insufficient_repetition"), "q": (2, 2, "a", "one", 0.7, 0.85, "cross_entity_candidate")}
