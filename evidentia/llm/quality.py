"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

A text is cut into words and runs of symbols; words, and pairs of neighbours, are hashed to a weight each.
A pair of equal words backs off to one shared "same again" n-gram, as does "x y x" to another.
A feature's value is its count over the count of all features, so that length does not matter, times a
constant. Training reads a bounded sample of labelled rows, the `train_rows` of least hash, of which each
class holds at most half of the bound, and of those as many as fit `TRAIN_BYTES` bytes; the sample's order is the
order of that hash. Scoring is a sparse dot product in the tasks that read the texts, with the weights (4 MB at 2^20) shipped once to each.

Defined results: null and empty texts have no features and get the score of the intercept; without any
labelled row every score is 0.5; labels that are null or not 0 or 1 are ignored, and of unlike labels of one
id the greater counts; rows that repeat a labelled id are each a training row within the bound; ties of the
hash go by id and text; very long texts count whole; repeated rows stay repeated; extra columns are ignored. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import crc_mod, docs_of, ship

ship(__name__)

BITS = 20
TRAIN_ROWS = 12_000
TRAIN_BYTES = 32 << 20
PASSES = 3
SCALE = 50.0
CUT = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
MEMO_ENTRIES = 1_000_000


class TokenHash(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        got = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))
        return got


def features(text: str | None, memo: TokenHash, bits: int = BITS):
    """Weight numbers of all words and neighbour pairs, in order; a number stands as often as it occurs."""
    tokens = TOKEN.findall(text) if text else []
    h = np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]
    pairs[h[:-1] == h[1:]] = 1
    again = np.full(int((h[:-2] == h[2:]).sum()), 2, dtype=np.uint64)
    both = np.concatenate([h, pairs, again]) * np.uint64(0xD6E8FEB86659FD93)
    return (both >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: list[tuple[str, int]], bits: int = BITS, passes: int = PASSES, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
    """Weights and intercept by follow-the-regularised-leader, a row at a time."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    memo, made = TokenHash(), []
    for text, label in rows:
        at, count = np.unique(features(text, memo, bits), return_counts=True)
        made.append((np.append(at, size).astype(np.int32), np.append(SCALE * count / max(1, count.sum()), 1.0), label))

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(passes):
        for at, x, label in made:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    return final[:size].astype(np.float32), float(final[size])


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most train_rows labelled texts, half of each label, of least hash of the id."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    marks = marks.where(allowed).withColumn("order", F.xxhash64("doc_id"))
    halves = [marks.where(F.col("label") == v).orderBy("order", "doc_id").limit(train_rows // 2) for v in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # at most train_rows rows of three numbers
    rows = docs_of(docs).join(chosen, "doc_id").select("order", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = rows.orderBy("order", "doc_id", "text").limit(train_rows)  # no more than that where ids repeat
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("order", "doc_id", "text"))
    return [(r.text, r.label) for r in rows.withColumn("upto", upto).where(F.col("upto") <= TRAIN_BYTES).orderBy("order", "doc_id", "text").collect()]


def score(docs: DataFrame, weights, bias: float, bits: int = BITS) -> DataFrame:
    """doc_id and score, from 0 to 1; higher where label 1 is likelier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TokenHash()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = features(text, memo, bits)
                out[i] = bias + SCALE * weights[at].sum(dtype=np.float64) / max(1, len(at))
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=["doc_id", "score"])

    return docs_of(docs).mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 5) == 0


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, ~held_out(), train_rows)
    weights, bias = train(rows) if rows else (np.zeros(1 << BITS, dtype=np.float32), 0.0)
    scored = score(docs, weights, bias)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """The rows, with all their columns, whose text the classifier does not reject."""
    rows = training_rows(docs, labels, ~held_out(), train_rows)
    weights, bias = train(rows) if rows else (np.zeros(1 << BITS, dtype=np.float32), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TokenHash()
        for batch in batches:
            at = [features(t, memo) for t in batch.column("text").to_pylist()]
            raw = np.array([bias + SCALE * weights[a].sum(dtype=np.float64) / max(1, len(a)) for a in at])
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))) >= cut))

    return docs.mapInArrow(run, docs.schema)
