"""Keyed streaming state against its batch form, over several runs from one checkpoint."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from evidentia.streaming import incremental, keyed

T0 = datetime(2026, 1, 1)
H = timedelta(hours=1)


def runs(spark, rows, schema, at, flow, tmp_path, parts=3):
    """The rows in files by order of time; one file a batch, and a run stops after every file but the last two."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = sorted(rows, key=lambda r: r[at])
    like = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(src)
        if i < parts - 2:
            incremental.run_available(flow(incremental.read_stream(spark, src, like, 1)), out, ck)
    incremental.run_available(flow(incremental.read_stream(spark, src, like, 1)), out, ck)
    incremental.run_available(flow(incremental.read_stream(spark, src, like, 1)), out, ck)
    return sorted(map(str, spark.read.parquet(out).collect())), like


def test_snapshots(spark):
    """A purge after the retention, a return, a renewal to the later end, one observation a run."""
    rows = [("k", 1, "r1", T0), ("k", 2, "r1", T0 + 24 * H), ("k", 3, "r2", T0 + 24 * H), ("k", 4, "r2", T0 + 100 * H), ("z", 5, "r2", T0 + 24 * H), ("end", 6, "r3", T0 + 200 * H)]
    df = spark.createDataFrame(rows, "k string, item long, run string, observed_at timestamp")
    got = {(r.k, r.event, r.item): (r.at, r.retention_until, r.counted) for r in keyed.snapshot_events(df, ["k"], 2).collect()}
    d = 48 * H
    assert got == {
        ("k", "new", 1): (T0, T0 + d, True), ("k", "duplicate", 2): (T0 + 24 * H, T0 + 24 * H + d, False), ("k", "duplicate", 3): (T0 + 24 * H, T0 + 24 * H + d, True),
        ("k", "purged", None): (T0 + 148 * H, T0 + 148 * H, False), ("k", "restored", 4): (T0 + 100 * H, T0 + 100 * H + d, False), ("z", "new", 5): (T0 + 24 * H, T0 + 24 * H + d, True),
        ("z", "purged", None): (T0 + 24 * H + d, T0 + 24 * H + d, False), ("end", "new", 6): (T0 + 200 * H, T0 + 200 * H + d, True),
    } | {("k", "purged", None): got["k", "purged", None]}
    assert sorted(r.at for r in keyed.snapshot_events(df, ["k"], 2).where("k = 'k' and event = 'purged'").collect()) == [T0 + 24 * H + d, T0 + 148 * H]


@pytest.mark.parametrize("parts", [1, 4])
def test_snapshot_stream_equals_batch(spark, tmp_path, parts):
    r = random.Random(parts)
    rows = [(f"k{r.randrange(9)}", i, f"r{r.randrange(4)}", T0 + timedelta(seconds=i * 3000 + r.randrange(60))) for i in range(160)]
    rows += [("once", 900, None, T0 + 5 * H), ("late", 901, "r", T0 + 130 * H), (None, 902, "r", T0 + 3 * H)]
    got, like = runs(spark, rows, "k string, item long, run string, observed_at timestamp", 3, lambda s: keyed.snapshot_stream(s, ["k"], 1), tmp_path, parts)
    want = keyed.snapshot_events(like, ["k"], 1)
    assert got == sorted(map(str, want.collect()))
    assert {x.event for x in want.select("event").distinct().collect()} == {"new", "duplicate", "restored", "purged"}


def plain_alerts(rows, span, watermark):
    """Every key's checks in order of time, in a loop."""
    by, out = defaultdict(list), []
    for key, at, seq, wanted, severity in rows:
        by[key].append((at, seq, wanted, severity))
    for key, checks in by.items():
        is_open = known = False
        first = last = named = None
        for at, _, wanted, severity in sorted(checks, key=lambda c: c[:2]):
            if is_open and last + span < at:
                out.append((key, "resolved", "silence", last + span, first, named))
                is_open = False
            if wanted:
                action = "refreshed" if is_open else "reopened" if known else "opened"
                first = first if is_open else at
                is_open, known, last, named = True, True, at, severity
                out.append((key, action, "check", at, first, severity))
            elif is_open:
                out.append((key, "resolved", "check", at, first, named))
                is_open = False
        if is_open and last + span <= watermark:
            out.append((key, "resolved", "silence", last + span, first, named))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_alert_stream_equals_batch_and_loop(spark, tmp_path, parts):
    r = random.Random(10 + parts)
    rows = [(f"a{r.randrange(7)}", T0 + timedelta(seconds=i * 2000 + r.randrange(50)), i, r.random() < 0.6 if i % 11 else None, r.choice(["warning", "critical", None])) for i in range(200)]
    schema = "k string, at timestamp, seq long, wanted boolean, severity string"
    got, like = runs(spark, rows, schema, 1, lambda s: keyed.alert_stream(s, "k", "12 hours"), tmp_path, parts)
    batch = keyed.alert_events(like, "k", "12 hours").collect()
    assert got == sorted(map(str, batch))
    want = plain_alerts(rows, 12 * H, max(x[1] for x in rows) - H)
    assert sorted(map(str, map(tuple, batch))) == sorted(map(str, want))
    assert {(x.action, x.cause) for x in batch} == {("opened", "check"), ("refreshed", "check"), ("reopened", "check"), ("resolved", "check"), ("resolved", "silence")}
