"""Stored result pages as a Python data source, in batch and as a stream whose offset is the cursor.

A folder of pages is what Spark writes of rows (cursor, next_cursor, is_complete, status, expected_total, position, item)
by `store_pages`: one folder a cursor. A reader follows the cursors from page to page on the driver, at most `pages` of
them at a time, and makes one partition a page; the items are read in tasks. Rows come in kinds: `item`; `page`, one
for each page; `event`, what a collection has to report.

The offset names the page to read next, how many were read, the connector's version and how the collection stands:
open, complete, stopped (a page that says so, or whose cursor does not advance), failed (a page that can't be read, or
that ended in an error: tried again in a later run). It is saved in the folder `saved` before Spark learns of it, so
that a restarted stream never asks for less than it had. A saved cursor of another version is not resumed: the
collection begins anew and reports `checkpoint_version_mismatch`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from evidentia.session import ship

ship(__name__)

SCHEMA = "kind string, cursor string, next_cursor string, status string, is_complete boolean, expected_total long, position int, item string, detail string"
START = "start"
OPEN, COMPLETE, STOPPED, FAILED = "open", "complete", "stopped", "failed"


def store_pages(rows: DataFrame, path: str) -> None:
    """Write pages where the source finds them; rows have the columns above, an empty page a row without an item."""
    rows.write.mode("append").partitionBy("cursor").json(path)


@dataclass
class Page(InputPartition):
    """A page to read, or something to report in its place."""

    path: str
    cursor: str
    event: str | None = None
    detail: str | None = None


def lines(path: str, cursor: str) -> Iterator[dict]:
    """The rows of a page, whose folder is called as Spark calls it."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = {unquote(f.base_name): f.path for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory} if quote(cursor, safe="") != cursor else {f"cursor={cursor}": f"{base}/cursor={cursor}"}
    files = system.get_file_info(fs.FileSelector(found[f"cursor={cursor}"]))
    for f in sorted(x.path for x in files if x.base_name[0] not in "._" and x.size):
        with system.open_input_stream(f) as stream:
            for line in stream.read().decode().split("\n"):
                if line:
                    yield json.loads(line)


class Chain:
    """The pages of a collection, from cursor to cursor."""

    def __init__(self, options: dict):
        self.path, self.start = options["path"], options.get("start", START)
        self.version = options.get("version", "1")
        self.initial = {"cursor": self.start, "pages": 0, "version": self.version, "state": OPEN}

    def after(self, offset: dict) -> tuple[dict, Page]:
        """The offset behind the page that an offset names, and that page."""
        cursor = offset["cursor"]
        try:
            head = next(lines(self.path, cursor))
        except Exception as e:  # whatever keeps a page from being read ends the collection, not the query
            return offset | {"state": FAILED}, Page(self.path, cursor, "connector_exception", type(e).__name__)
        new, follow = offset | {"pages": offset["pages"] + 1}, head.get("next_cursor")
        if head["status"] != "succeeded":
            return new | {"cursor": follow or cursor, "state": STOPPED if head["status"] == "failed_permanent" else FAILED}, Page(self.path, cursor)
        if head.get("is_complete"):
            return new | {"state": COMPLETE}, Page(self.path, cursor)
        if not follow or follow == cursor:
            return new | {"state": STOPPED}, Page(self.path, cursor, "cursor_not_advancing", follow)
        return new | {"cursor": follow, "state": OPEN}, Page(self.path, cursor)

    def walk(self, offset: dict, most: int | None = None, until: dict | None = None) -> tuple[dict, list[Page]]:
        """Read on from an offset, for so many pages or until another offset, while the collection is open."""
        pages: list[Page] = []
        offset = offset | {"state": OPEN}
        while offset["state"] == OPEN and (most is None or len(pages) < most) and (until is None or offset["pages"] < until["pages"] or until["state"] == FAILED):
            offset, page = self.after(offset)
            pages.append(page)
        return offset, pages


def rows_of(page: Page) -> Iterator[tuple]:
    """A page's own row, its items, and what it has to report."""
    head, n = None, 0
    if page.event not in ("connector_exception", "checkpoint_version_mismatch"):
        for row in lines(page.path, page.cursor):
            said = (page.cursor, row.get("next_cursor"), row["status"], bool(row.get("is_complete")), row.get("expected_total"))
            head = head or said
            if row.get("item") is not None:
                n += 1
                yield ("item", *said, row.get("position"), row["item"], None)
        yield ("page", *head, n, None, None)
    if page.event:
        yield ("event", page.cursor, None, None, None, None, None, None, page.event if page.detail is None else f"{page.event}:{page.detail}")


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.chain, self.most = Chain(options), int(options["pages"]) if "pages" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        return self.chain.walk(self.chain.initial, self.most)[1]

    def read(self, partition: Page) -> Iterator[tuple]:
        return rows_of(partition) if partition is not None else iter(())


class PagesStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.chain, self.most, self.saved = Chain(options), int(options.get("pages", 100)), options["saved"]
        self.at = self.load()
        self.tried = False

    def file(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.saved) if "://" in self.saved or self.saved.startswith("file:") else (fs.LocalFileSystem(), self.saved)
        system.create_dir(base, recursive=True)
        return system, f"{base}/offset.json"

    def load(self) -> dict | None:
        from pyarrow import fs

        system, name = self.file()
        if system.get_file_info(name).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(name) as f:
            saved = json.loads(f.read())
        # another version's cursor means nothing to this one
        return saved if saved["version"] == self.chain.version else None

    def save(self, offset: dict) -> None:
        system, name = self.file()
        with system.open_output_stream(f"{name}.new") as f:
            f.write(json.dumps(offset).encode())
        system.move(f"{name}.new", name)

    def initialOffset(self) -> dict:  # noqa: N802
        return self.chain.initial

    def latestOffset(self) -> dict:  # noqa: N802
        at = self.at or self.chain.initial
        if at["state"] == OPEN or (at["state"] == FAILED and not self.tried):
            new, pages = self.chain.walk(at, self.most)
            # a page that still can't be read is nothing new
            at = at if at["state"] == FAILED and [p.event for p in pages] == ["connector_exception"] else new
            self.tried = True
            self.save(at)
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start["version"] == end["version"]:
            return self.chain.walk(start, until=end)[1] if start != end else []
        said = Page(self.chain.path, self.chain.start, "checkpoint_version_mismatch", f"{start['version']}->{end['version']}")
        return [said, *self.chain.walk(self.chain.initial, until=end)[1]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return rows_of(partition)

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    """Options: path, pages (at a time), start, version; a stream also needs saved, a folder of its own."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PagesStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Pages)


def collection_outcome(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """How collections end, from the rows of their pages: status, reason, pages, items, errors, resume_available.

    rows: keys, kind, status, is_complete, position (items of a page, in its own row), detail. An unreadable page or a
    failed one leaves a collection partial if it has items; whatever ends otherwise than complete can be resumed, but
    for a permanent failure.
    """
    page, event = F.col("kind") == "page", F.col("kind") == "event"
    stuck, broken = F.col("detail").startswith("cursor_not_advancing"), F.col("detail").startswith("connector_exception")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = rows.groupBy(*keys).agg(
        count(page).alias("pages"), F.coalesce(F.sum(F.when(page, F.col("position"))), F.lit(0)).cast("long").alias("items"),
        F.max(F.when(page & (F.col("status") != "succeeded"), F.col("status"))).alias("_failed"),
        (count(page & (F.col("status") != "succeeded")) + count(event & (stuck | broken))).alias("errors"), F.coalesce(F.bool_or(page & (F.col("status") == "succeeded") & F.col("is_complete")), F.lit(False)).alias("_complete"),
        F.coalesce(F.bool_or(event & broken), F.lit(False)).alias("_broken"), F.coalesce(F.bool_or(event & stuck), F.lit(False)).alias("_stuck"),
    )
    hard = F.col("_failed").isin("failed_transient", "failed_permanent")
    status = (
        F.when(F.col("_broken"), F.when(F.col("items") > 0, "partial").otherwise("failed_transient"))
        .when(hard & (F.col("items") > 0), "partial").when(F.col("_failed").isNotNull(), F.col("_failed"))
        .when(F.col("_stuck") | ~F.col("_complete") | (F.col("errors") > 0), "partial").otherwise("succeeded")
    )
    cut = (F.col("pages") >= most) if most is not None else F.lit(False)
    reason = (
        F.when(F.col("_broken"), "connector_exception").when(F.col("_failed").isNotNull(), F.col("_failed")).when(F.col("_stuck"), "cursor_not_advancing")
        .when(F.col("_complete"), None).when(cut, "page_limit").otherwise("open")
    )
    resume = (status != "succeeded") & (F.coalesce(F.col("_failed"), F.lit("")) != "failed_permanent")
    return sums.select(*keys, status.alias("status"), reason.alias("reason"), "pages", "items", "errors", resume.alias("resume_available"))
