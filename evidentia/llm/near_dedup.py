"""Near-duplicate groups by Order MinHash.

Equal texts are one class, found by digest. The words of a class's text give shingles of five words, each
labelled by its occurrence (the second "a b c d e" of a text is another shingle than the first). A band of
the sketch takes the shingles of least hash under the band's own order, three of them, and keeps them in
the order in which they stand in the text: two texts meet in a band if they agree on these shingles and
their order. With similarity s they meet in one of 16 bands with probability 1 - (1 - s^3)^16, which is
0.99999 at 0.8.

Every pair of different groups that meets in a band is decided, but never by listing a bucket's pairs:

1. Leaders. In a bucket one text of each group meets one leader; what the alignment accepts joins the groups.
   The first round looks at three bands alone, which is enough for most texts, so that a member of a large
   group meets three leaders and not sixteen; later rounds look at all bands and only at groups still apart.
2. A bucket of two texts is decided by that. Texts in a larger bucket that still spans several groups enter an
   exact join. Shingles are ordered by how often their hash cell is met, rarest first. Texts of x and y
   shingles, y the longer, at the threshold t match m >= t/(1+t) (x+y) of them, so the first matched one stands
   among the first x - 2t/(1+t) x + 1 of the shorter and the first y - t y + 1 of the longer in that order
   (prefix filter); lengths differ by no more than t allows; what stands behind the shared shingle on either
   side suffices for m (positional filter); its places in the texts differ by no more than the unmatched
   shingles allowed; and bits in which the parity codes of the texts differ are no more than those, as every
   differing bit takes an unmatched shingle. Under one shingle only texts outside its main group are paired,
   with all others, so that a group however large is never paired with itself. Of the pairs that two groups
   have, one is verified at first; the others are only while their groups are apart.

A candidate is verified by alignment in a diagonal band: equal labelled shingles whose places differ by no
more than the unmatched shingles allowed, in the longest chain that is increasing in both texts, counted
against the union. Links of `threshold` or more make groups as connected components.

Defined results: a null text is alone in its class; equal texts, empty ones too, are one class; a text of
fewer than five words has its whole word sequence as its only shingle, one without words none; each row of an
id is in the class of its own text, so that repeated and null ids do no harm; of ties the least id counts, a
null id after all others; very long texts go through whole; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, docs_of, fresh_name, materialise, ship
from evidentia.llm.graph import components
from evidentia.llm.rolling import Doc, chunked, mix, words

ship(__name__)

SHINGLE = 5
BANDS = 16
MINIMA = 3
THRESHOLD = 0.8
FIRST_BANDS = 3
LEADER_ROUNDS = 2
SINGLE_ROUNDS = 2
CELLS = 1 << 18
CODE_WORDS = 16
LINK = "a long, b long, similarity double"


def labelled_shingles(d: Doc, i: int, size: int = SHINGLE):
    """Hashes of the shingles of the i-th document, by place; a repeated one counts on from its first."""
    a, n = int(d.starts[i]), int(d.sizes[i])
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    if n < size:
        out = d.powers[1][a : a + 1]
        for j in range(1, n):
            out = mix(out, d.powers[1][a + j : a + j + 1])
        return mix(out, np.array([n], dtype=np.uint64))
    h = d.grams(size)[a : a + n - size + 1]
    order = np.argsort(h, kind="stable")
    run = h[order]
    new = np.append(True, run[1:] != run[:-1])
    if new.all():
        return mix(h, np.zeros(1, dtype=np.uint64))
    first = np.flatnonzero(new)
    nth = np.empty(len(h), dtype=np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix(h, nth)


def sketch(shingles, bands: int = BANDS, minima: int = MINIMA):
    """One key for each band."""
    if not len(shingles):
        return np.zeros(0, dtype=np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    take = min(minima, len(shingles))
    ranks = mix(shingles[None, :], (keys * np.uint64(0x9FB21C651E98DF25))[:, None])
    least = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
    for column in shingles[least].T:
        keys = mix(keys, column)
    return keys


def ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers, so that what meets it exactly is not lost to rounding."""
    return Fraction(threshold).limit_denominator(1_000_000).as_integer_ratio()


def aligned_similarity(x, y, threshold: float = THRESHOLD) -> float:
    """Shingles matched in order within the band, over the union; 0 where the threshold can't be met."""
    up, down = ratio(threshold)
    both = len(x) + len(y)
    if min(len(x), len(y)) * down < up * max(len(x), len(y)) or not len(x):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    keep = np.abs(i - j) * (up + down) <= (down - up) * both
    i, j = i[keep], j[keep]
    if len(i) * (up + down) < up * both:
        return 0.0
    j = j[np.argsort(i)]
    chain = len(j)
    if not (j[1:] > j[:-1]).all():
        ends: list[int] = []
        for v in j.tolist():
            at = bisect_left(ends, v)
            ends[at : at + 1] = [v]
        chain = len(ends)
    return chain / (len(x) + len(y) - chain)


def cell(shingles):
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def parity_code(shingles):
    """For each bit whether an odd number of shingles falls to it; two codes differ in no more bits than the texts in shingles."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % (64 * CODE_WORDS), minlength=64 * CODE_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _each(columns: list[str], made):
    """Run made(shingles) over the texts of a batch and keep the named columns beside its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, docs in chunked(list(range(batch.num_rows)), batch.column("text").to_pylist()):
                d = Doc(docs)
                part = batch.slice(done, len(ids))
                done += len(ids)
                yield made([part.column(c) for c in columns], [labelled_shingles(d, i) for i in range(len(ids))])

    return run


def _sketches(bands: int, minima: int):
    def made(columns, shingles):
        keys = pa.array([sketch(s, bands, minima).view(np.int64) for s in shingles], pa.list_(pa.int64()))
        return pa.record_batch([*columns, keys], names=["row", "doc_id", "digest", "bands"])

    return _each(["row", "doc_id", "digest"], made)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each cell is met in a partition, as two lists."""
    met = np.zeros(CELLS, dtype=np.int64)
    for _ in _each([], lambda _, shingles: np.add(met, np.bincount(cell(np.concatenate(shingles)), minlength=CELLS), out=met))(batches):
        pass
    at = np.flatnonzero(met)
    yield pa.record_batch([pa.array([at], pa.list_(pa.int64())), pa.array([met[at]], pa.list_(pa.int64()))], names=["cells", "met"])


def _prefixes(threshold: float, met):
    """The rarest shingles of each text: their place in that order (pos) and in the text, and whether a shorter text needs them too."""
    up, down = ratio(threshold)

    def made(columns, shingles):
        rep, part = columns
        keys, places, taken, short = [], [], [], []
        for s in shingles:
            n = len(s)
            take = n - -(-up * n // down) + 1 if n else 0
            order = np.lexsort((s, met[cell(s)]))[:take]
            keys.append(s[order])
            places.append(order)
            taken.append(take)
            short.append(n - -(-2 * up * n // (up + down)) + 1)
        pos = np.concatenate([np.arange(t) for t in taken])
        spread = lambda x: pa.array(np.repeat(np.asarray(x), taken))
        return pa.record_batch(
            [
                spread(rep.to_numpy()),
                spread(part.to_numpy()),
                spread(np.array([len(s) for s in shingles], dtype=np.int32)),
                pa.array(np.concatenate(keys).view(np.int64)),
                pa.array(pos.astype(np.int32)),
                pa.array(np.concatenate(places).astype(np.int32)),
                pa.array(pos < np.repeat(np.array(short), taken)),
            ],
            names=["rep", "part", "n", "key", "pos", "place", "short"],
        )

    return _each(["rep", "part"], made)


def _codes(columns, shingles):
    codes = np.stack([parity_code(s) for s in shingles])
    return pa.record_batch([*columns, *[pa.array(np.ascontiguousarray(codes[:, i])) for i in range(CODE_WORDS)]], names=["rep", *[f"c{i}" for i in range(CODE_WORDS)]])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            sims = []
            for left, right in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if left != last:
                    last, kept = left, labelled_shingles(Doc([words(left)]), 0)
                sims.append(aligned_similarity(kept, labelled_shingles(Doc([words(right)]), 0), threshold))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _ident(doc_id: Column, digest: Column) -> Column:
    """One value for id and text together, also where the id is null."""
    return F.concat(digest, F.coalesce(doc_id.cast("string").cast("binary"), F.lit(b"")))


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The columns of chosen, of which `ident` names rows of the documents, and the text of each."""
    texts = docs_of(docs).where("text is not null").select(_ident(F.col("doc_id"), _digest(F.col("text"))).alias("ident"), "text")
    return texts.join(chosen, "ident").dropDuplicates(["ident"]).drop("ident")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs that meet the threshold."""
    left = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    found = both.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_verify(threshold), LINK)
    return materialise(found.where(F.col("similarity") >= threshold))


def classes(docs: DataFrame, bands: int = BANDS, minima: int = MINIMA) -> tuple[DataFrame, DataFrame]:
    """The rows with a text (row, doc_id, digest) and one row (rep, class_id, ident, digest, bands) for each distinct text."""
    rows = docs_of(docs).where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", _digest(F.col("text")).alias("digest"), "text")
    rows = materialise(rows.mapInArrow(_sketches(bands, minima), "row long, doc_id long, digest binary, bands array<long>"))
    reps = rows.groupBy("digest").agg(F.min("row").alias("rep"), F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"))
    return rows.select("row", "doc_id", "digest"), materialise(reps.select("rep", "class_id", _ident(F.col("class_id"), F.col("digest")).alias("ident"), "digest", "bands"))


def _with_parts(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return members.withColumn("part", F.col("rep"))
    return members.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")


def _meeting(reps: DataFrame) -> DataFrame:
    """(rep, key, first) of every text in a bucket of two or more; first where it is of the bands of the first round."""
    each = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = materialise(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))  # a plain table, so that a large bucket can be split
    return materialise(each.join(shared, "key", "left_semi").select("rep", "key", (F.col("band") < FIRST_BANDS).alias("first")))


def _leaders(members: DataFrame, nth: int) -> DataFrame:
    """From (key, rep, part) to pairs of a text of each group in a bucket with the bucket's leader, where they are of different groups."""
    rank = F.xxhash64("rep", "key", F.lit(nth))
    ones = materialise(members.groupBy("key", "part").agg(F.min_by("rep", rank).alias("rep")))
    led = ones.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("rep", rank).alias("leader")).where("n > 1").select("key", "leader")
    met = ones.join(materialise(led), "key").where("rep <> leader")
    return met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def near_links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, minima: int = MINIMA) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (row, doc_id, digest), classes (rep, class_id, ident, digest), verified links (a, b, similarity) between reps, and the groups (id, component) they make."""
    rows, reps = classes(docs, bands, minima)
    # what meets no other text in any band is in no pair: all that follows reads only the others, whose texts are dealt out once
    met = _meeting(reps)
    texts = materialise(_texts(docs, reps.select("rep", "ident").join(met.select("rep").distinct(), "rep")))
    links, parts, tested = None, None, None
    for nth in range(LEADER_ROUNDS + 1):
        members = met.where("first") if nth == 0 else met
        pairs = _leaders(_with_parts(members.select("rep", "key"), parts), nth)
        pairs = materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        links, parts = _joined(links, parts, pairs, texts, threshold)
        tested = pairs if tested is None else tested.unionByName(pairs)
    crowd = materialise(_crowd(met, parts))
    if not crowd.isEmpty():
        pairs = materialise(_across(crowd, texts, threshold).join(tested, ["a", "b"], "left_anti"))
        for nth in range(SINGLE_ROUNDS + 1):
            if pairs.isEmpty():
                break
            pairs = materialise(_apart(pairs, parts))
            chosen = pairs.select("a", "b")
            if nth < SINGLE_ROUNDS:
                one = F.min_by(F.struct("a", "b"), F.xxhash64("a", "b", F.lit(nth))).alias("pair")
                chosen = materialise(pairs.groupBy("part_a", "part_b").agg(one).select("pair.a", "pair.b"))
            links, parts = _joined(links, parts, chosen, texts, threshold)
            pairs = pairs.select("a", "b").join(chosen, ["a", "b"], "left_anti")
    discard(met, texts)
    return rows, reps.drop("bands"), links, parts


def _joined(links: DataFrame | None, parts: DataFrame | None, pairs: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The links and groups with those that the pairs add."""
    if links is not None and pairs.isEmpty():
        return links, parts
    if links is None:
        more = _verified(pairs, texts, threshold)
        return more, components(more)
    # later pairs are few, and so are their texts
    ends = materialise(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    chosen = materialise(texts.join(ends, "rep", "left_semi"))
    more = _verified(pairs, chosen, threshold)
    discard(ends, chosen)
    if more.isEmpty():
        return links, parts
    # groups are what is linked now, not their texts
    moved = components(_apart(more, parts).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    known = parts.union(moved.select("id", F.col("id").alias("component"))).distinct()
    roots = moved.select(F.col("id").alias("component"), F.col("component").alias("root"))
    return links.unionByName(more), materialise(known.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")))


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b, part_a, part_b (the lesser part first) of the pairs whose ends are in different groups."""
    of = lambda x: parts.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    own = [F.coalesce(f"of_{x}", x) for x in "ab"]
    placed = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return placed.select("a", "b", F.least(*own).alias("part_a"), F.greatest(*own).alias("part_b")).where("part_a <> part_b")


def _crowd(met: DataFrame, parts: DataFrame) -> DataFrame:
    """(rep, part) of the texts in buckets of three or more that still span several groups."""
    members = materialise(_with_parts(met.select("rep", "key"), parts))
    open_keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("least"), F.max("part").alias("most")).where("n > 2 and least < most").select("key")
    return members.join(open_keys, "key", "left_semi").groupBy("rep").agg(F.first("part").alias("part"))


def _across(crowd: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of different parts, all that can reach the threshold among the crowd."""
    up, down = (F.lit(x).cast("long") for x in ratio(threshold))
    texts = materialise(texts.join(crowd, "rep"))
    counts = texts.select("text").mapInArrow(_cells, "cells array<long>, met array<long>").select(F.inline(F.arrays_zip("cells", "met"))).groupBy("cells").agg(F.sum("met").alias("met"))
    counts = counts.toArrow()  # no more rows than cells
    met = np.zeros(CELLS, dtype=np.int64)
    met[counts.column("cells").to_numpy()] = counts.column("met").to_numpy()
    rare = materialise(texts.mapInArrow(_prefixes(threshold, met), "rep long, part long, n int, key long, pos int, place int, short boolean"))
    sized = rare.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mains = materialise(sized.groupBy("key").agg(F.count(F.lit(1)).alias("of"), F.max_by("part", F.struct("n", "part")).alias("main")).where("of > 1").select("key", "main"))
    rare = rare.join(mains, "key").withColumn("minor", F.col("part") != F.col("main")).drop("main")
    code = [f"c{i}" for i in range(CODE_WORDS)]
    codes = texts.select("rep", "text").mapInArrow(_each(["rep"], _codes), ", ".join(["rep long", *[f"{c} long" for c in code]]))
    rare = materialise(rare.join(codes, "rep"))
    x, y = rare.where("minor").alias("x"), rare.alias("y")
    both = F.col("x.n") + F.col("y.n")
    shorter = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in code[1:]), F.bit_count(F.col("x.c0").bitwiseXOR(F.col("y.c0"))))
    meet = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.part") != F.col("y.part"))
        & (~F.col("y.minor") | (F.col("x.rep") < F.col("y.rep")))
        & F.when(shorter, F.col("x.short")).otherwise(F.col("y.short"))
        & (F.least("x.n", "y.n") * down >= F.greatest("x.n", "y.n") * up)
        & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (up + down) >= both * up)
        & (F.abs(F.col("x.place") - F.col("y.place")) * (up + down) <= both * (down - up))
        & (differ * (up + down) <= both * (down - up))
    )
    return x.join(y, meet).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _grouped(docs: DataFrame, threshold: float, bands: int, minima: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, digest) and classes (digest, class_id, ident, group: the first class of its group)."""
    rows, reps, _, parts = near_links(docs, threshold, bands, minima)
    placed = _with_parts(reps, parts)
    order = F.struct(F.col("class_id").isNull().alias("none"), "class_id", "digest", "ident")
    firsts = placed.groupBy("part").agg(F.min(order).alias("group"))
    return rows, materialise(placed.join(firsts, "part").select("digest", "class_id", "ident", "group"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, minima: int = MINIMA) -> DataFrame:
    """doc_id, class_id (least id with that text), group_id (least id of the near group); a row for each row."""
    rows, named = _grouped(docs, threshold, bands, minima)
    found = rows.join(named, "digest").select("doc_id", "class_id", F.col("group.class_id").alias("group_id"))
    alone = F.col("doc_id").cast("long")
    return found.unionByName(docs.where("text is null").select(alone.alias("doc_id"), alone.alias("class_id"), alone.alias("group_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, of one document of each group: the least id. Null texts stay; of rows that repeat both id and text one stays."""
    _, named = _grouped(docs, threshold, BANDS, MINIMA)
    name = fresh_name(docs, "ident")
    firsts = named.where(F.col("ident") == F.col("group.ident")).select(F.col("ident").alias(name))
    text = F.col("text").cast("string")
    kept = docs.where("text is not null").withColumn(name, _ident(F.col("doc_id").cast("long"), _digest(text))).join(firsts, name, "left_semi")
    return kept.dropDuplicates([name]).drop(name).unionByName(docs.where("text is null"))
