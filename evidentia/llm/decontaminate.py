"""Benchmark leaks by the q-gram lemma.

Items are cut into overlapping segments of normalised letters (lower case, every run of other characters a
space). A copy of a segment of n letters with at most e edits shares at least n - q + 1 - q * e q-grams with
it, all on diagonals that differ by at most e. Every place of a text whose q-gram some segment has is
counted in two overlapping bands of diagonals, each 2e wide and e apart, so that one band holds all of a
copy's hits. Bands with enough hits are verified by alignment within the band.

An item of fewer than `MIN_LETTERS` letters allows no edits and has to stand between borders of words; one of
fewer than q letters has no q-gram and matches only a text that has no other letters.

Documents are spread over tasks and never shuffled. The items are a query set: the driver takes them up a
block of at most `block_letters` letters at a time, and each block is one pass over the documents whose
result is written before the next block is fetched, so that neither the driver nor a task holds more than
one block, however many items there are.

Defined results: null and empty texts and items match nothing; items that repeat each match; every row is
judged by its own text, so rows that repeat an id each give their rows, and null ids are like others; very
long texts are searched whole; extra columns are ignored, or kept where the function says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, docs_of, materialise, ship

ship(__name__)

Q = 12
SEGMENT = 120
STEP = 60
LETTERS_PER_EDIT = 15
MIN_LETTERS = 40
BLOCK_LETTERS = 1_000_000
CHUNK = 1 << 20
TABLE_BITS = 22
#: Segments that are aligned together.
ALIGNED = 4096
OTHER = re.compile(r"[\W_]+")
HITS = "doc_id long, item_id long, segments long, edits long, first_letter long"


def normalised(text: str | None) -> str:
    return OTHER.sub(" ", text.lower()).strip() if text else ""


def letters(text: str):
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def qgrams(codes, q: int = Q):
    """Hash of the q letters from each place on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    power, out, at, size = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), None, 0, 1
    while True:
        if q & size:
            part = power[at : at + n]
            out = part if out is None else out * m + part
            at += size
        if size * 2 > q:
            break
        power = (power[:-size] * m + power[size:]) * m
        size *= 2
    return out * np.uint64(0xBF58476D1CE4E5B9)


def allowed_edits(n: int) -> int:
    return n // LETTERS_PER_EDIT if n >= MIN_LETTERS else 0


class Segments:
    """The segments of a block of items and the places of their q-grams, in the order of the hashes."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.codes, hashes, owner, place = [], [], [], [], []
        self.whole: dict[str, list[int]] = {}
        for item_id, text in items:
            norm = letters(normalised(text))
            if len(norm) < Q:
                if len(norm):
                    self.whole.setdefault(normalised(text), []).append(item_id)
                continue
            starts = list(range(0, max(1, len(norm) - SEGMENT + 1), STEP))
            if len(norm) > SEGMENT and starts[-1] + SEGMENT < len(norm):
                starts.append(len(norm) - SEGMENT)
            for s in starts:
                code = norm[s : s + SEGMENT]
                h = qgrams(code)
                hashes.append(h)
                owner.append(np.full(len(h), len(self.codes)))
                place.append(np.arange(len(h)))
                self.item.append(item_id)
                self.codes.append(code)
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.hash, at, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.at = at
        self.owner = np.concatenate([np.zeros(0, dtype=np.int64), *owner])[order].astype(np.int32)
        self.place = np.concatenate([np.zeros(0, dtype=np.int64), *place])[order].astype(np.int32)
        self.edits = np.array([allowed_edits(len(c)) for c in self.codes], dtype=np.int64)
        self.need = np.array([max(1, len(c) - Q + 1 - Q * allowed_edits(len(c))) for c in self.codes], dtype=np.int64)

    def table(self):
        seen = np.zeros(1 << TABLE_BITS, dtype=bool)
        seen[(self.hash >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return seen


def aligned_edits(segments, windows, width: int):
    """Least edits of each segment against its window with its first letter up to `width` off, and how many letters of the window that takes.

    A row is a segment of n letters and a window of n + width.
    """
    n = segments.shape[1]
    slots = np.arange(width + 1)
    row = np.zeros((len(segments), width + 1), dtype=np.int64)
    for i in range(n):
        new = np.full(row.shape, n, dtype=np.int64)
        new[:, :width] = row[:, :width] + (windows[:, i : i + width] != segments[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - slots, axis=1) + slots
    return row.min(axis=1), n + row.argmin(axis=1)


def _windows(texts: list, starts: list[int], size: int):
    """The letters of each text from its start on, with no letter before its first and behind its last."""
    out = np.full((len(texts), size), 0xFFFFFFFF, dtype=np.uint32)
    for row, text, start in zip(out, texts, starts, strict=True):
        lo, hi = max(0, start), min(len(text), start + size)
        row[lo - start : hi - start] = text[lo:hi]
    return out


def band_edits(segment, text, start: int, width: int) -> tuple[int, int]:
    """Least edits of the segment against the text with its first letter `start` to `start + width` off, and where it ends."""
    edits, used = aligned_edits(segment[None], _windows([text], [start], len(segment) + width), width)
    return int(edits[0]), start + int(used[0])


def _counted(doc, seg, low):
    """The different (doc, seg, low) in order, and how often each is met; as one number each where that has room."""
    if not len(low):
        return np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)
    least, segs, lows = int(low.min()), int(seg.max()) + 1, int(low.max()) - int(low.min()) + 1
    if (int(doc.max()) + 1) * segs * lows >= 1 << 63:
        return np.unique(np.stack([doc, seg, low], 1), axis=0, return_counts=True)
    keys, hits = np.unique((doc * segs + seg) * lows + (low - least), return_counts=True)
    return np.stack([keys // lows // segs, keys // lows % segs, keys % lows + least], 1), hits


def _stands_alone(text, at: int, n: int) -> bool:
    return (at == 0 or text[at - 1] == 32) and (at + n == len(text) or text[at + n] == 32)


def _hits(segs: Segments):
    """From a list of texts to (place in the list, item_id, segments, edits, first_letter) of every leak."""
    table, least = segs.table(), int(segs.need.min()) if len(segs.need) else 1

    def chunk(norms: list[str], starts: list[int]) -> Iterator[tuple]:
        codes = letters("\n".join(norms))
        grams = qgrams(codes)
        near = np.flatnonzero(table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(near) or not len(segs.hash):
            return
        slot = np.minimum(np.searchsorted(segs.hash, grams[near]), len(segs.hash) - 1)
        known = segs.hash[slot] == grams[near]
        near, slot = near[known], slot[known]
        begins = np.array(starts)
        doc = np.searchsorted(begins, near, side="right") - 1
        enough = np.bincount(doc, minlength=len(norms))[doc] >= least
        near, slot, doc = near[enough], slot[enough], doc[enough]
        if not len(near):
            return
        count = segs.count[slot]
        ends = np.cumsum(count)
        posting = np.repeat(segs.at[slot] - (ends - count), count) + np.arange(ends[-1])
        seg = segs.owner[posting].astype(np.int64)
        doc = np.repeat(doc, count)
        diagonal = np.repeat(near, count) - begins[doc] - segs.place[posting]
        step = segs.edits[seg] + 1
        low = diagonal // step
        bands, hits = _counted(np.concatenate([doc, doc]), np.concatenate([seg, seg]), np.concatenate([low, low - 1]))
        found: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        text_of = lambda d: codes[begins[d] : begins[d] + len(norms[d])]
        bands = bands[hits >= segs.need[bands[:, 1]]].tolist()
        alike: dict[tuple[int, int], list[int]] = {}
        for i, (_, s, _) in enumerate(bands):
            alike.setdefault((len(segs.codes[s]), int(segs.edits[s])), []).append(i)
        aligned = {}
        for (n, e), all_of in alike.items():
            for k in range(0, len(all_of) if n >= MIN_LETTERS else 0, ALIGNED):
                some = all_of[k : k + ALIGNED]
                starts = [bands[i][2] * (e + 1) for i in some]
                windows = _windows([text_of(bands[i][0]) for i in some], starts, n + 2 * (e + 1))
                edits, used = aligned_edits(np.stack([segs.codes[bands[i][1]] for i in some]), windows, 2 * (e + 1))
                aligned |= zip(some, zip(edits.tolist(), (used + starts).tolist(), strict=True), strict=True)
        for i, (d, s, b) in enumerate(bands):
            e, n = int(segs.edits[s]), len(segs.codes[s])
            if n < MIN_LETTERS:  # the two diagonals of the band, letter by letter
                text = text_of(d)
                for at in (b, b + 1):
                    if 0 <= at <= len(text) - n and _stands_alone(text, at, n) and (text[at : at + n] == segs.codes[s]).all():
                        found.setdefault((d, segs.item[s]), {})[s] = (0, at)
                continue
            edits, end = aligned[i]
            if edits <= e:
                own = found.setdefault((d, segs.item[s]), {})
                own[s] = min(own.get(s, (edits, end - n)), (edits, end - n))
        for (d, item), own in found.items():
            yield d, item, len(own), min(x[0] for x in own.values()), max(0, min(x[1] for x in own.values()))

    def hits(texts: list[str | None]) -> Iterator[tuple]:
        i = 0
        while i < len(texts):
            first, norms, starts, size = i, [], [], 0
            while i < len(texts) and (not norms or size + len(texts[i] or "") < CHUNK):
                norms.append(normalised(texts[i]))
                starts.append(size)
                size += len(norms[-1]) + 1
                i += 1
            for d, norm in enumerate(norms if segs.whole else ()):
                yield from ((first + d, item, 1, 0, 0) for item in segs.whole.get(norm, ()))
            yield from ((first + d, *rest) for d, *rest in chunk(norms, starts))

    return hits


def _leaks(segs: Segments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _hits(segs)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], *rest) for i, *rest in hits(batch.column("text").to_pylist())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "segments", "edits", "first_letter"])

    return run


def _clean(segs: Segments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _hits(segs)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, *_ in hits(batch.column("text").to_pylist()):
                keep[i] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, block_letters: int) -> Iterator[Segments]:
    """The items in blocks; one is fetched when the one before has been used."""
    block, size = [], 0
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row.text) > block_letters:
            yield Segments(block)
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield Segments(block)


def leaks(docs: DataFrame, benchmark: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """A row (doc_id, item_id, segments, edits, first_letter) for each document and item of which it holds a segment."""
    docs = docs_of(docs)
    return reduce(DataFrame.unionByName, [materialise(docs.mapInArrow(_leaks(segs), HITS)) for segs in _blocks(benchmark, block_letters)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """The rows, with all their columns, whose text holds no segment of an item."""
    left, written = docs, None
    for segs in _blocks(benchmark, block_letters):
        left = materialise(left.mapInArrow(_clean(segs), docs.schema))
        if written is not None:
            discard(written)
        written = left
    return left
