"""Batches that are written once and whole, whatever fails and whatever comes again."""

import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from evidentia.sources import ingest
from evidentia.streaming import incremental, sink

SCHEMA = "item long, external_type string, external_id string, payload string"


def rows(spark, first, n):
    kind = lambda i: ("", "t")[i % 5 > 0]
    return spark.createDataFrame([(i, kind(i), str(i), json.dumps({"a": i}) if i % 7 else "{broken") for i in range(first, first + n)], SCHEMA)


def normalise(items):
    return ingest.route(items).withColumnRenamed("reject_reason", "error_class")


def contents(spark, path):
    c = sink.Commits(spark, path)
    return {part: sorted(tuple(r) for r in c.read(part).collect()) for part in (sink.ROWS, sink.REJECTS, sink.SUMMARY)}


def test_stream_in_several_runs(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(3):
        rows(spark, 100 * k, 60).coalesce(1).write.mode("append").parquet(src)
        sink.run_batches(incremental.read_stream(spark, src, rows(spark, 0, 1)), normalise, out, ck)
    got = contents(spark, out)
    ids = [i for k in range(3) for i in range(100 * k, 100 * k + 60)]
    bad = {i: "missing_external_type" if i % 5 == 0 else "non_json_payload" for i in ids if i % 5 == 0 or i % 7 == 0}
    assert [r[0] for r in got["rows"]] == [i for i in ids if i not in bad]
    assert {r[0]: r[4] for r in got["rejects"]} == bad
    assert [r[0] for r in got["summary"]] == [0, 1, 2] and all(r[1] == 60 == r[2] + r[3] and r[4] == "partial" for r in got["summary"])


def test_replayed_batch_has_no_effect(spark, tmp_path):
    path = str(tmp_path / "out")
    write = sink.write_batch(normalise, path)
    write(rows(spark, 0, 20), 0)
    before = contents(spark, path)
    write(rows(spark, 0, 20), 0)
    write(rows(spark, 500, 9), 0)
    assert contents(spark, path) == before
    assert sink.Commits(spark, path).commit(0, "other") is False and contents(spark, path) == before


@pytest.mark.parametrize("at", [1, 2, 3])
def test_failure_between_writes_leaves_nothing(spark, tmp_path, monkeypatch, at):
    """The write of rows, of rejects or of the summary fails; the batch is then replayed."""
    path = str(tmp_path / "out")
    sink.write_batch(normalise, path)(rows(spark, 0, 20), 0)
    before, calls, real = contents(spark, path), [], DataFrameWriter.parquet

    def failing(self, *args, **how):
        calls.append(1)
        if len(calls) == at:
            raise OSError("lost")
        return real(self, *args, **how)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError, match="lost"):
        sink.write_batch(normalise, path)(rows(spark, 20, 20), 1)
    monkeypatch.undo()
    assert contents(spark, path) == before
    sink.write_batch(normalise, path)(rows(spark, 20, 20), 1)
    got = contents(spark, path)
    assert sorted(r[0] for r in got["rows"] + got["rejects"]) == list(range(40)) and len(got["summary"]) == 2
    assert sink.Commits(spark, path).sweep() == (1 if at > 1 else 0)
    assert contents(spark, path) == got


def test_stream_that_fails_goes_on_where_it_stopped(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows(spark, 0, 30).coalesce(1).write.parquet(src)
    commit, failed = sink.Commits.commit, []

    def once(self, batch, folder):
        if not failed:
            failed.append(1)
            raise OSError("lost before the commit")
        return commit(self, batch, folder)

    sink.Commits.commit = once
    try:
        with pytest.raises(Exception, match="lost before the commit"):
            sink.run_batches(incremental.read_stream(spark, src, rows(spark, 0, 1)), normalise, out, ck)
        assert sink.Commits(spark, out).read(sink.ROWS) is None
        sink.run_batches(incremental.read_stream(spark, src, rows(spark, 0, 1)), normalise, out, ck)
    finally:
        sink.Commits.commit = commit
    got = contents(spark, out)
    assert sorted(r[0] for r in got["rows"] + got["rejects"]) == list(range(30))


def test_statuses(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, error_class string")
    status = lambda d: sink.summary_of(d, 3).first().status
    assert (status(df), status(df.where("i = 1")), status(df.where("i = 2")), status(df.where(F.lit(False)))) == ("partial", "succeeded", "failed_permanent", "succeeded")
