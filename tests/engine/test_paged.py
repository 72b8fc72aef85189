"""The data source of stored pages: chains, resumption, refusals and the outcome of collections."""

import json

from pyspark.sql import functions as F

from evidentia.sources import paged
from evidentia.streaming import incremental

COLUMNS = "cursor string, next_cursor string, is_complete boolean, status string, expected_total long, position int, item string"


def page(cursor, follow, n, complete=False, status="succeeded"):
    rows = [(cursor, follow, complete, status, 9, i, json.dumps({"id": f"{cursor}{i}"})) for i in range(n)]
    return rows or [(cursor, follow, complete, status, 9, None, None)]


def stored(spark, path, *pages):
    paged.store_pages(spark.createDataFrame([r for p in pages for r in p], COLUMNS).coalesce(1), path)


def chain(spark, path, n=5):
    names = ["start", *[f"c/{i} é" for i in range(1, n)]]
    stored(spark, path, *[page(c, names[i + 1] if i + 1 < n else None, i % 3, i + 1 == n) for i, c in enumerate(names)])
    return names


def test_batch_reads_a_partition_a_page(spark, tmp_path):
    paged.register(spark)
    names = chain(spark, str(tmp_path / "p"))
    df = spark.read.format("pages").option("path", str(tmp_path / "p")).load()
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    assert [r.cursor for r in rows if r.kind == "page"] == names
    assert sum(r.kind == "item" for r in rows) == 0 + 1 + 2 + 0 + 1
    few = spark.read.format("pages").option("path", str(tmp_path / "p")).option("pages", 2).load()
    assert few.where("kind = 'page'").count() == 2


def run(spark, tmp_path, version="1", pages=2):
    paged.register(spark)
    s = spark.readStream.format("pages").options(path=str(tmp_path / "p"), saved=str(tmp_path / "saved"), pages=pages, version=version).load()
    incremental.run_available(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    return spark.read.parquet(str(tmp_path / "out")).select("kind", "cursor", "detail").collect()


def test_stream_is_bounded_resumes_and_ends(spark, tmp_path):
    names = chain(spark, str(tmp_path / "p"))
    seen = []
    for _ in range(5):
        seen.append([r.cursor for r in run(spark, tmp_path) if r.kind == "page"])
    assert list(map(len, seen)) == [2, 4, 5, 5, 5] and sorted(seen[-1]) == sorted(names)


def test_other_version_begins_anew_and_says_so(spark, tmp_path):
    chain(spark, str(tmp_path / "p"))
    assert len(run(spark, tmp_path)) == 3
    rows = run(spark, tmp_path, version="2")
    assert [r.detail for r in rows if r.kind == "event"] == ["checkpoint_version_mismatch:1->2"]
    assert sorted(r.cursor for r in rows if r.kind == "page").count("start") == 2


def test_cursor_that_does_not_advance_is_refused(spark, tmp_path):
    stored(spark, str(tmp_path / "p"), page("start", "b", 2), page("b", "b", 1))
    for _ in range(2):
        rows = run(spark, tmp_path, pages=10)
        assert [r.detail for r in rows if r.kind == "event"] == ["cursor_not_advancing:b"]
        assert sum(r.kind == "page" for r in rows) == 2


def test_missing_page_is_reported_once_and_tried_again(spark, tmp_path):
    stored(spark, str(tmp_path / "p"), page("start", "b", 2))
    for _ in range(2):
        rows = run(spark, tmp_path, pages=10)
        assert sum((r.detail or "").startswith("connector_exception") for r in rows) == 1
    stored(spark, str(tmp_path / "p"), page("b", None, 3, complete=True))
    assert sorted(r.cursor for r in run(spark, tmp_path, pages=10) if r.kind == "page") == ["b", "start"]


def test_outcomes(spark):
    p = lambda c, status, n, done=False: (c, "page", status, done, n, None)
    e = lambda c, detail: (c, "event", None, None, None, detail)
    rows = [
        p("done", "succeeded", 3), p("done", "succeeded", 0, True), p("cut", "succeeded", 3), p("cut", "succeeded", 3), p("stuck", "succeeded", 1), e("stuck", "cursor_not_advancing:x"),
        e("dead", "connector_exception:OSError"), p("broken", "succeeded", 2), e("broken", "connector_exception:OSError"), p("gone", "failed_permanent", 0), p("half", "succeeded", 5), p("half", "failed_permanent", 0),
        p("slow", "succeeded", 5), p("slow", "rate_limited", 0), p("later", "failed_transient", 0),
    ]
    out = paged.collection_outcome(spark.createDataFrame(rows, "c string, kind string, status string, is_complete boolean, position int, detail string"), ["c"], 2)
    got = {r.c: (r.status, r.reason, r.resume_available) for r in out.collect()}
    assert got == {
        "done": ("succeeded", None, False), "cut": ("partial", "page_limit", True), "stuck": ("partial", "cursor_not_advancing", True), "dead": ("failed_transient", "connector_exception", True),
        "broken": ("partial", "connector_exception", True), "gone": ("failed_permanent", "failed_permanent", False), "half": ("partial", "failed_permanent", False), "slow": ("rate_limited", "rate_limited", True),
        "later": ("failed_transient", "failed_transient", True),
    }
    assert {r.c: r["items"] for r in out.select("c", F.col("items")).collect()}["half"] == 5
