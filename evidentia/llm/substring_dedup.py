"""Substring deduplication by compaction of a De Bruijn graph of words.

Every run of `window` words is an edge of the graph; its nodes are the runs of one word less at either end. An
edge belongs to its anchor: the k-mer of least hash inside it, so that equal edges share their anchor wherever
they stand. Consecutive edges with the same anchor are stored as one segment: its anchor, its source
coordinates and a 128-bit digest of the words that stand there, which keeps the graph about fourteen times
smaller than a row for each edge, and equality a matter of words and not of rolling hashes.

1. Segments are written once. An anchor met once has no repeated edge and goes.
2. Equal segments, by digest, become one unit with a count. What is met twice or more is repeated from end to end.
3. Where an anchor has several units, they may share single edges. The coordinates of one segment of each lead
   back to the source text; its edges are digested one by one, and those met twice or more are units too.
4. Units that follow each other in some text are linked through the node they share. A join gives every unit the
   number of different units that follow and precede it; where that is one on both sides the path does not
   branch, and the text's units on it become one span by their coordinates.
5. The spans are joined to the texts, and the words they cover go.

No group of equal anchors or units is ever gathered: counts are partial sums, and rows meet them by joins.

Defined results: a null text has no words and an empty text stays empty; texts shorter than the window lose
nothing; every row is a text of its own, whatever its id, so null and repeated ids are kept and their texts
never mix, and each copy counts; very long texts are cut whole; extra columns are ignored, or kept where the
function says so, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import discard, docs_of, fresh_name, materialise, ship
from evidentia.llm.rolling import Doc, chunked, leftmost_min, mix, words

ship(__name__)

WINDOW = 35
ANCHOR = 8


def _segments(d: Doc, window: int, k: int):
    """First edge, number of edges and anchor of every segment."""
    edges = d.inside(window)
    if not len(edges):
        return [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0, dtype=np.uint64)]
    kmers = d.grams(k)
    at = leftmost_min(kmers, window - k + 1)[edges]
    new = np.ones(len(edges), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (edges[1:] != edges[:-1] + 1)
    first = np.flatnonzero(new)
    return edges[first], np.diff(np.append(first, len(edges))), kmers[at[first]]


def word_digests(ws: list[bytes], starts: list[int], ends: list[int]):
    """Two 64-bit halves of the digest of each run of words; words hold no space, so the join is one to one."""
    raw = b"".join([xxhash.xxh3_128_digest(b" ".join(ws[a:b])) for a, b in zip(starts, ends, strict=True)])
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)


def _occurrences(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, docs in chunked(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                d = Doc(docs)
                start, count, anchors = _segments(d, window, k)
                doc = d.doc_at(start)
                flat = [w for ws in docs for w in ws]
                digests = word_digests(flat, start.tolist(), (start + count + window - 1).tolist())
                yield pa.record_batch(
                    [
                        pa.array(np.array(rows, dtype=np.int64)[doc]),
                        pa.array((start - d.starts[doc]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(anchors.view(np.int64)),
                        pa.array(np.ascontiguousarray(digests[:, 0])),
                        pa.array(np.ascontiguousarray(digests[:, 1])),
                    ],
                    names=["row", "start", "edges", "anchor", "u1", "u2"],
                )

    return run


def _edges(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("segments").to_pylist(), strict=True)
            for row, text, segments in rows:
                ws = words(text)
                count = np.array([s["edges"] for s in segments], dtype=np.int64)
                start = np.array([s["start"] for s in segments], dtype=np.int64)
                at = np.repeat(start - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(count.sum())
                digests = word_digests(ws, at.tolist(), (at + window).tolist())
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(at), row, dtype=np.int64)),
                        pa.array(at.astype(np.int32)),
                        pa.array(np.ascontiguousarray(digests[:, 0])),
                        pa.array(np.ascontiguousarray(digests[:, 1])),
                        pa.array(np.repeat(np.array([s["once"] for s in segments], dtype=bool), count)),
                    ],
                    names=["row", "start", "u1", "u2", "once"],
                )

    return run


def gone_words(n: int, spans: list[dict], window: int):
    """For each of n words, whether a span covers it."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, [s["start"] for s in spans], 1)
    np.add.at(delta, [s["start"] + s["edges"] + window - 1 for s in spans], -1)
    return np.cumsum(delta)[:-1] > 0


def left_of(text: str, spans: list[dict], window: int) -> str:
    ws = words(text)
    return b" ".join([w for w, g in zip(ws, gone_words(len(ws), spans, window).tolist(), strict=True) if not g]).decode()


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, spans_out = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                ws = words(text)
                n_words.append(len(ws))
                if not spans:
                    n_removed.append(0)
                    kept.append(b" ".join(ws))
                    spans_out.append([])
                    continue
                gone = gone_words(len(ws), spans, window)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g]))
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                spans_out.append([{"first": a, "last": b - 1} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(spans_out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"],
            )

    return run


def numbered(docs: DataFrame, row: str = "row") -> DataFrame:
    """The documents in the shared folder with a number for each row, which holds however often they are read."""
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()))


def repeated_units(texts: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """From (row, text) to a table of every place (row, start, edges) of a repeated unit (u1, u2), and of the unit `before` it if they touch."""
    segments = materialise(texts.mapInArrow(_occurrences(window, k), "row long, start int, edges int, anchor long, u1 long, u2 long"))
    shared = materialise(segments.groupBy("anchor").count().where("count > 1").select("anchor"))  # a plain table, so that a hot anchor's segments can be split
    found = materialise(segments.join(shared, "anchor"))
    discard(segments)
    units = found.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "edges", "anchor")).alias("at"))
    units = materialise(units)
    straight = found.join(units.where("n > 1").select("u1", "u2"), ["u1", "u2"]).select("row", "start", "edges", "u1", "u2")
    several = materialise(units.groupBy(F.col("at.anchor").alias("anchor")).count().where("count > 1").select("anchor"))
    looked = (
        units.select("at.*", "n")
        .join(several, "anchor")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "edges", (F.col("n") == 1).alias("once"))).alias("segments"))
    )
    edges = materialise(texts.join(looked, "row").select("row", "text", "segments").mapInArrow(_edges(window), "row long, start int, u1 long, u2 long, once boolean"))
    twice = materialise(edges.groupBy("u1", "u2").count().where("count > 1").select("u1", "u2"))
    single = edges.where("once").join(twice, ["u1", "u2"]).select("row", "start", F.lit(1).alias("edges"), "u1", "u2")
    placed = materialise(with_neighbours(straight.unionByName(single)))
    discard(found, shared, units, several, edges, twice)
    return placed


def with_neighbours(units: DataFrame) -> DataFrame:
    w = Window.partitionBy("row").orderBy("start")
    touching = F.lag("start").over(w) + F.lag("edges").over(w) == F.col("start")
    return units.withColumn("before", F.when(touching, F.struct(F.lag("u1").over(w).alias("u1"), F.lag("u2").over(w).alias("u2"))))


def compact(placed: DataFrame) -> DataFrame:
    """From the places of repeated units to spans (row, start, edges): the units of a text on one path that does not branch."""
    w = Window.partitionBy("row").orderBy("start")
    links = placed.where("before is not null").select("before.*", F.col("u1").alias("v1"), F.col("u2").alias("v2")).distinct()
    links = materialise(links)
    forks = links.groupBy("u1", "u2").count().where("count > 1").select("u1", "u2", F.lit(True).alias("fork"), F.lit(False).alias("meet"))
    meets = links.groupBy(F.col("v1").alias("u1"), F.col("v2").alias("u2")).count().where("count > 1").select("u1", "u2", F.lit(False).alias("fork"), F.lit(True).alias("meet"))
    branching = materialise(forks.unionByName(meets).groupBy("u1", "u2").agg(F.max("fork").alias("fork"), F.max("meet").alias("meet")))
    flagged = placed.select("row", "start", "edges", "u1", "u2", F.col("before").isNull().alias("first")).join(branching, ["u1", "u2"], "left")
    left_fork = F.coalesce(F.lag("fork").over(w), F.lit(False))
    begins = F.col("first") | F.coalesce("meet", F.lit(False)) | left_fork
    paths = flagged.select("row", "start", "edges", begins.alias("begins")).withColumn("nth", F.sum(F.col("begins").cast("long")).over(w))
    return paths.groupBy("row", "nth").agg(F.min("start").alias("start"), F.sum("edges").cast("int").alias("edges")).drop("nth")


def repeated_spans(texts: DataFrame, window: int, k: int) -> DataFrame:
    """A row (row, spans) for every text with repeated edges; spans may overlap in words."""
    return compact(repeated_units(texts, window, k)).groupBy("row").agg(F.collect_list(F.struct("start", "edges")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by a space), removed_spans (word places)."""
    texts = numbered(docs_of(docs))
    both = texts.join(repeated_spans(texts.select("row", "text"), window, k), "row", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<first:int,last:int>>")


def cut_columns(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """The rows with all their columns; text is what is left, and n_chars, where it is a column, its length.

    A text that loses nothing stays as it is, and so does a null one.
    """
    row, gone = fresh_name(docs, "row"), fresh_name(docs, "spans")
    rows = numbered(docs, row)
    spans = repeated_spans(rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), window, k)
    both = rows.join(spans.select(F.col("row").alias(row), F.col("spans").alias(gone)), row, "left").drop(row)
    kept = T.StructType([*docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [left_of(t, s, window) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column(gone).to_pylist(), strict=True)]
            columns = {name: batch.column(name) for name in batch.schema.names if name != gone}
            columns["text"] = pa.array(texts, pa.string())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    out = both.mapInArrow(run, kept)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size("removed_spans").cast("long").alias("n_spans"))
