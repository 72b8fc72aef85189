"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and everything but letters becomes a space. Its subwords are all runs of two, three
and four characters whose inner ones are letters, so that a space marks a word's border. Each is hashed to
a row of an embedding; the mean of the rows goes through a linear layer and a softmax. Both are trained by
stochastic gradient descent in numpy on at most `train_rows` texts of each language, those of least hash of
the id, and fewer where there are many languages or the texts are long: all of them together are bounded by
`TRAIN_TEXTS` texts and `TRAIN_BYTES` bytes, shared out evenly. As the model is linear, scoring sums one row
of class weights for each subword.

A fifth of the training texts calibrates: the temperature that makes their likelihood greatest, and the
least probability at which those accepted are right in `precision` of cases and which all but `UNSURE` of
them reach; texts below it are marked as not accepted but still carry their likeliest language.

Defined results: null texts, and texts without a letter, are `und` with score 0 and not accepted; the same
holds for all texts where there is nothing to learn from; of rows that repeat an id each may be learnt from,
with its own text and language, and ties of the hash go by id and text; of languages that tie in probability
the first in order of name is predicted; very long texts count whole; repeated rows stay repeated; extra
columns are ignored. Language, source and id never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import crc_mod, docs_of, materialise, ship

ship(__name__)

BITS = 16
DIM = 16
TRAIN_ROWS = 400
TRAIN_TEXTS = 8_000
TRAIN_BYTES = 32 << 20
UNSURE = 0.005
PASSES = 4
RATE = 2.0
CHUNK = 1 << 19
OTHER = re.compile(r"[\W\d_]+")


def letters_only(text: str | None) -> str:
    """Lower-cased words between spaces; empty where there is no letter."""
    if not text or not any(map(str.isalpha, text)):
        return ""
    return f" {OTHER.sub(' ', text.lower()).strip()} "


def subwords(codes, bits: int = BITS):
    """Row numbers of the subwords at each place, and whether one starts there, for two, three and four letters."""
    c = codes.astype(np.uint32)
    blank = c == 32
    rows, valid, h = [], [], c * np.uint32(0x9E3779B1)
    for size in (2, 3, 4):
        n = max(0, len(c) - size + 1)
        h = (h[:n] * np.uint32(0x85EBCA6B)) ^ (c[size - 1 :][:n] * np.uint32(0xC2B2AE35))
        ok = np.ones(n, dtype=bool)
        if size == 2:
            ok = ~(blank[:n] & blank[1:][:n])
        for inner in range(1, size - 1):
            ok &= ~blank[inner : inner + n]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        rows.append((mixed >> np.uint32(32 - bits)).astype(np.int64))
        valid.append(ok)
    return rows, valid


def of_text(text: str):
    rows, valid = subwords(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32))
    return np.concatenate([r[v] for r, v in zip(rows, valid, strict=True)])


def train(samples: list[tuple[str, str]], precision: float = 0.99, seed: int = 7):
    """(languages, class weights for each subword, intercepts, temperature, least accepted probability)."""
    langs = sorted({lang for _, lang in samples})
    texts = [(t, langs.index(lang)) for t, lang in ((letters_only(t), lang) for t, lang in samples) if t]
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    made = [(*np.unique(of_text(t), return_counts=True), y) for t, y in texts]
    made = [(at, n / n.sum(), y) for at, n, y in made if len(at)]
    check, fit = made[::5], [m for i, m in enumerate(made) if i % 5] or made
    steps, total = 0, PASSES * len(fit)
    for _ in range(PASSES):
        for i in rng.permutation(len(fit)):
            at, share, y = fit[i]
            hidden = share @ emb[at]
            raw = hidden @ out + bias
            p = np.exp(raw - raw.max())
            p /= p.sum()
            p[y] -= 1
            rate = RATE * (1 - steps / total)
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            emb[at] -= rate * np.outer(share, back) * 10
            steps += 1
    table = emb @ out
    raws = np.array([share @ table[at] + bias for at, share, _ in check]) if check else np.zeros((0, len(langs)))
    truth = np.array([y for *_, y in check], dtype=np.int64)

    def probabilities(t):
        z = raws / t
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    temperature = min((0.25, 0.5, 1.0, 2.0, 4.0), key=lambda t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).sum()) if len(truth) else 1.0
    least = 0.0
    if len(truth):
        p = probabilities(temperature)
        top, right = p.max(1), p.argmax(1) == truth
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
        least = float(top[order][good[-1]]) if len(good) else 1.0
        least = max(least if not right.all() else 0.0, float(np.quantile(top, UNSURE, method="lower")))
    return langs, table.astype(np.float32), bias, temperature, least


def training_rows(docs: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """At most train_rows texts of each language, of least hash of the id.

    A cut of the hash that twice as many texts pass goes before the ranking, so that no language is ranked as a whole.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.alias("part"))
    sizes = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    langs = max(1, sizes.count())
    each, room = min(train_rows, max(1, TRAIN_TEXTS // langs)), TRAIN_BYTES // langs
    order = Window.partitionBy("lang").orderBy("part", "doc_id", "text")
    near = known.join(sizes, "lang").where(F.col("part") * F.col("n") <= 2 * each + 50)
    chosen = near.withColumns({"nth": F.row_number().over(order), "bytes": F.sum(F.octet_length("text")).over(order)}).where((F.col("nth") <= each) & (F.col("bytes") <= room))
    return [(r.text, r.lang) for r in chosen.select("lang", "nth", "text").orderBy("lang", "nth").collect()]


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score, accepted."""
    langs, table, bias, temperature, least = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [letters_only(t) for t in batch.column("text").to_pylist()]
            sums, counts, i = np.zeros((len(texts), len(langs))), np.zeros(len(texts)), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
                    size += len(texts[j])
                    j += 1
                codes = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "replace"), dtype=np.uint32)
                owner = np.repeat(np.arange(i, j), [len(t) for t in texts[i:j]])
                for rows, valid in zip(*subwords(codes), strict=True):
                    at, whose = rows[valid], owner[: len(rows)][valid]
                    if not len(at):
                        continue
                    first = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
                    counts[whose[first]] += np.diff(np.append(first, len(whose)))
                    for k in range(len(langs)):
                        sums[whose[first], k] += np.add.reduceat(table[:, k][at], first, dtype=np.float64)
                i = j
            if langs:
                raw = (sums / np.maximum(counts, 1)[:, None] + bias) / temperature
                p = np.exp(raw - raw.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                known = np.array([bool(t) for t in texts], dtype=bool)
                best, top = p.argmax(1), np.where(known, p.max(1, initial=0), 0.0)
                pred = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            else:
                top, known, pred = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool), ["und"] * len(texts)
            yield pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(top), pa.array(known & (top >= least))], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 3) == 1


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; learnt outside the held-out fold."""
    samples = training_rows(docs, ~held_out(), train_rows)
    model = train(samples) if samples else ([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0), 1.0, 1.0)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
