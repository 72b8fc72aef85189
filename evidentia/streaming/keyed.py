"""Keyed state with timers: snapshots that are remembered and forgotten, alerts that open and resolve.

Each flow has a batch form with windows and a streaming form with state and event-time timers, and both give the
same rows for the same items, as long as no item is later than the watermark allows. A key's items are taken in
order of time; state is a few numbers a key (and the runs that have counted it), and a timer a key. Every access to
state is a call to the JVM, so that a key's state is read once and written once a batch, whatever its items are. A
rerun from the same checkpoint goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from evidentia.session import ship

ship(__name__)

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the queries that start inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def timed(rows: DataFrame, at: str, late: str) -> DataFrame:
    """Rows under a watermark, with the microseconds of their time for state to count in, whatever the time zone."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withColumn("us", F.unix_micros(at)).withWatermark(at, late)


def tick(us: int) -> int:
    """The first millisecond that is not before a moment: timers and watermarks count those."""
    return -(-us // 1000)


def settled(us: Column, items: DataFrame, at: str, late_us: int) -> tuple[DataFrame, Column]:
    """One row with the last watermark of a stream over all items, and whether a moment has passed by then."""
    last = items.agg((F.floor((F.unix_micros(F.max(at).cast("timestamp")) - late_us) / 1000)).cast("long").alias("_watermark"))
    return last, F.ceil(us / 1000).cast("long") <= F.col("_watermark")


# Snapshots: the first item of a key is new; later ones observe it again, renew its retention to the later end,
# and bring it back if it had been purged.

SNAPSHOT = ["event", "item", "run", "at", "retention_until", "counted"]


def snapshot_events(items: DataFrame, keys: list[str], days: int, late: str = "1 hour") -> DataFrame:
    """keys, event (new, duplicate, restored, purged), item, run, at, retention_until, counted.

    items: keys, item, run, observed_at. An item counts once a run; a purge has neither item nor run.
    """
    at = F.col("observed_at").cast("timestamp")
    day, late_us = days * 86_400_000_000, _micros_of(late)
    w = Window.partitionBy(*keys).orderBy("_at", "item")
    rows = items.select(*keys, "item", "run", F.unix_micros(at).alias("_at"))
    rows = rows.withColumns({"_before": F.lag("_at").over(w) + day, "_next": F.lead("_at").over(w), "counted": F.row_number().over(Window.partitionBy(*keys, "run").orderBy("_at", "item")) == 1})
    event = F.when(F.col("_before").isNull(), "new").when(F.col("_before") < F.col("_at"), "restored").otherwise("duplicate")
    seen = rows.select(*keys, event.alias("event"), "item", "run", F.timestamp_micros("_at").alias("at"), F.timestamp_micros(F.col("_at") + day).alias("retention_until"), "counted")
    watermark, passed = settled(F.col("_at") + day, items, "observed_at", late_us)
    gone = rows.crossJoin(F.broadcast(watermark)).where((F.col("_next") > F.col("_at") + day) | (F.col("_next").isNull() & passed))
    none = {"item": rows.schema["item"].dataType, "run": rows.schema["run"].dataType}
    purged = gone.select(*keys, F.lit("purged").alias("event"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], *[F.timestamp_micros(F.col("_at") + day).alias(c) for c in ("at", "retention_until")], F.lit(False).alias("counted"))
    return seen.unionByName(purged)


class Snapshots(StatefulProcessor):
    """State of a key: when its retention ends and whether it was purged; and the runs that have counted it."""

    def __init__(self, keys: list[str], days: int):
        self.keys, self.span = keys, days * 86_400_000_000
        self.columns = (*keys, *SNAPSHOT)

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType().add("until", "long").add("purged", "boolean"))
        self.runs = handle.getListState("counted_runs", T.StructType().add("run", "string"))
        self.made = Row(*self.columns)

    def row(self, key, event, item, run, at, until, counted) -> Row:
        return self.made(*key, event, item, run, at, until, counted)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        kept = self.kept.get()
        until, purged = kept or (None, False)
        timer, new = until if until is not None and not purged else None, []
        known, first = {name for (name,) in self.runs.get()} if kept else set(), []
        for at, item, run in sorted(((r.us, r.item, r.run) for r in rows), key=lambda r: r[:2]):
            event = "new" if until is None else "restored" if purged or until < at else "duplicate"
            if event == "restored" and not purged:
                new.append(self.row(key, "purged", None, None, until, until, False))
            until, purged = at + self.span if until is None else max(until, at + self.span), False
            name = run if run is not None else ""
            counted = name not in known
            if counted:
                known.add(name)
                first.append((name,))
            new.append(self.row(key, event, item, run, at, until, counted))
        if timer != until:
            if timer is not None:
                self.handle.deleteTimer(tick(timer))
            self.handle.registerTimer(tick(until))
        self.kept.update((until, purged))
        if first:
            self.runs.appendList(first)
        yield from new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        until, purged = self.kept.get()
        if not purged and tick(until) <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.update((until, True))
            yield self.row(key, "purged", None, None, until, until, False)


def snapshot_stream(items: DataFrame, keys: list[str], days: int, late: str = "1 hour") -> DataFrame:
    """The same rows as `snapshot_events` from a stream of items."""
    schema = T.StructType([items.schema[k] for k in keys]).add("event", "string").add(items.schema["item"]).add(items.schema["run"]).add("at", "long").add("retention_until", "long").add("counted", "boolean")
    out = timed(items.select(*keys, "item", "run", "observed_at"), "observed_at", late).groupBy(*keys).transformWithState(Snapshots(keys, days), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "retention_until")})


# Alerts: a check that wants one opens, refreshes or re-opens it; a check that doesn't resolves it, as does silence.


def alert_events(checks: DataFrame, key: str, silence: str = "2 days", late: str = "1 hour") -> DataFrame:
    """key, action (opened, refreshed, reopened, resolved), cause (check, silence), at, first_at, severity.

    checks: key, at, seq (order among equal times), wanted, severity.
    """
    span, late_us = _micros_of(silence), _micros_of(late)
    w = Window.partitionBy(key).orderBy("_at", "seq")
    rows = checks.select(key, F.unix_micros(F.col("at").cast("timestamp")).alias("_at"), "seq", F.coalesce("wanted", F.lit(False)).alias("wanted"), "severity")
    # open before a check: the one before wanted it and was not too long ago
    still = F.coalesce(F.lag("wanted").over(w) & (F.lag("_at").over(w) + span >= F.col("_at")), F.lit(False))
    rows = rows.withColumns({"_open": still, "_known": F.max(F.col("wanted").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1, "_next": F.lead("_at").over(w)})
    action = F.when(F.col("wanted") & F.col("_open"), "refreshed").when(F.col("wanted") & F.col("_known"), "reopened").when(F.col("wanted"), "opened").when(F.col("_open"), "resolved")
    rows = rows.withColumn("action", action)
    first = F.last(F.when(F.col("action").isin("opened", "reopened"), F.col("_at")), ignorenulls=True).over(w)
    rows = rows.withColumns({"_first": first, "_severity": F.when(F.col("wanted"), F.col("severity")).otherwise(F.lag(F.when(F.col("wanted"), F.col("severity"))).over(w))})
    said = rows.where("action is not null").select(key, "action", F.lit("check").alias("cause"), F.timestamp_micros("_at").alias("at"), F.timestamp_micros("_first").alias("first_at"), F.col("_severity").alias("severity"))
    watermark, passed = settled(F.col("_at") + span, checks, "at", late_us)
    silent = rows.crossJoin(F.broadcast(watermark)).where(F.col("wanted") & ((F.col("_next") > F.col("_at") + span) | (F.col("_next").isNull() & passed)))
    ended = silent.select(key, F.lit("resolved").alias("action"), F.lit("silence").alias("cause"), F.timestamp_micros(F.col("_at") + span).alias("at"), F.timestamp_micros("_first").alias("first_at"), F.col("_severity").alias("severity"))
    return said.unionByName(ended)


class Alerts(StatefulProcessor):
    """State of a key: whether its alert is open, since when, when it was last wanted, and how severe."""

    def __init__(self, key: str, span: int):
        self.key, self.span = key, span

    def init(self, handle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", T.StructType().add("open", "boolean").add("first", "long").add("last", "long").add("severity", "string"))
        self.made = Row(self.key, "action", "cause", "at", "first_at", "severity")

    def row(self, key, action, cause, at, first, severity) -> Row:
        return self.made(key[0], action, cause, at, first, severity)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        state = self.alert.get()
        is_open, first, last, severity = state or (False, None, None, None)
        timer, known, new = last if is_open else None, state is not None, []
        for at, _, wanted, named in sorted(((r.us, r.seq, bool(r.wanted), r.severity) for r in rows), key=lambda r: r[:2]):
            if is_open and last + self.span < at:
                new.append(self.row(key, "resolved", "silence", last + self.span, first, severity))
                is_open = False
            if wanted:
                action = "refreshed" if is_open else "reopened" if known else "opened"
                first = first if is_open else at
                is_open, last, severity, known = True, at, named, True
                new.append(self.row(key, action, "check", at, first, severity))
            elif is_open:
                new.append(self.row(key, "resolved", "check", at, first, severity))
                is_open = False
        now = last if is_open else None
        if timer != now:
            if timer is not None:
                self.handle.deleteTimer(tick(timer + self.span))
            if now is not None:
                self.handle.registerTimer(tick(now + self.span))
        if known:
            self.alert.update((is_open, first, last, severity))
        yield from new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        is_open, first, last, severity = self.alert.get()
        if is_open and tick(last + self.span) <= expiredTimerInfo.getExpiryTimeInMs():
            self.alert.update((False, first, last, severity))
            yield self.row(key, "resolved", "silence", last + self.span, first, severity)


def alert_stream(checks: DataFrame, key: str, silence: str = "2 days", late: str = "1 hour") -> DataFrame:
    """The same rows as `alert_events` from a stream of checks."""
    schema = T.StructType([checks.schema[key]]).add("action", "string").add("cause", "string").add("at", "long").add("first_at", "long").add("severity", "string")
    out = timed(checks.select(key, "at", "seq", "wanted", "severity"), "at", late).groupBy(key).transformWithState(Alerts(key, _micros_of(silence)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "first_at")})


def _micros_of(interval: str) -> int:
    """The microseconds of an interval of days or smaller units, such as '1 hour'."""
    number, unit = interval.split()
    return round(float(number) * {"second": 1e6, "minute": 6e7, "hour": 3.6e9, "day": 8.64e10, "week": 6.048e11}[unit.rstrip("s")])
