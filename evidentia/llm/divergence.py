"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. Tasks count them by (lang, source)
before anything is shuffled; what remains are postings, one row a language and term with its count in every
source that has it. A language keeps the terms of ten of its documents. All arithmetic is on whole numbers.

`pair`: the sum over all kept terms of f between two sources. A term that only one of them has depends on its
count alone, so those sums come from a histogram of counts; postings give the terms that both have, and what
neither has counts once for all.

`term`: the ten terms by which a source departs most. The terms of a group fall into buckets by their count
there; the largest count and the language's least probability in a bucket bound f. Buckets are evaluated
best first, in waves, until the bounds of all unseen ones are strictly below the tenth value; equal bounds are
evaluated, so that ties go by name.

Defined results: null text, lang or source is an empty one; a group without kept terms has its pairs and no
terms; a language without kept terms has pairs of value 0; a language of one source has no pairs; equal values
rank by the item's UTF-8 bytes; repeated rows count as documents each; very long texts count whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import discard, materialise, ship

ship(__name__)

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: entries that a task counts before it passes them on, and bytes of a text that it splits at once
ENTRIES = 300_000
BLOCK = 1 << 20
#: counts up to here have a bucket each; beyond, a power of two has as many buckets as BUCKETS says
EXACT = 32
BUCKETS = 16
#: the first wave takes buckets until this many terms a group, each later one so many times more
WAVE = 64

LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()
COUNTS = "lang string, source string, term string, n long, docs long"


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a block at a time; a block ends where a term does."""
    raw, at = raw.translate(LETTERS), 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in total.items():
            terms, seen = [None, *counts], docs[lang, source]
            n = len(terms)
            yield pa.record_batch(
                [pa.array([lang] * n), pa.array([source] * n), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(seen[t] for t in counts)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        total.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "raw")), strict=True):
            counts, once = total[lang, source], set()
            before = len(counts)
            for words in words_of(text):
                counts.update(words)
                once.update(words)
            docs[lang, source].update(once)
            held += len(counts) - before
            if held > ENTRIES:
                yield from flush()
                held = 0
    yield from flush()


def postings_of(docs: DataFrame, least_docs: int = LEAST_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, term, n, sources (array of source and n) of kept terms; the row of a null term lists all sources."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("raw"))
    counted = rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    postings = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return postings.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).drop("docs")


def chance(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), in decimals where longs could overflow."""
    small = F.expr(f"{SCALE}L * ({n} + 2) div ({total} + 2 * {v})")
    large = F.expr(f"cast({n} + 2 AS decimal(19,0)) * cast({SCALE} AS decimal(10,0)) div cast({total} + 2 * {v} AS decimal(20,0))")
    return F.when(F.expr(f"{n} < {(1 << 62) // SCALE - 2}L"), small).otherwise(large) + 1


def f(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both lie between 1 and SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _groups(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, total, kept (terms it has), v, lang_total and p0, the chance of a term it doesn't have."""
    langs = postings.where("term IS NOT NULL").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    every = postings.where("term IS NULL").select("lang", F.explode("sources.source").alias("source"))
    of_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    joined = every.join(of_group, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "v", "lang_total"])
    return joined.withColumn("p0", F.when(F.col("v") > 0, chance("0", "total", "v")).otherwise(1))


def bucket_of(n: Column) -> Column:
    """Counts up to EXACT apart, larger ones by narrow powers; only bounds depend on it, never a result."""
    return F.when(n <= EXACT, n).otherwise(F.floor(F.log2(n) * BUCKETS) + EXACT).cast("int")


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def top_terms(terms: DataFrame, groups: DataFrame, top: int = TOP, wave: int = WAVE) -> DataFrame:
    """lang, source, item, value, rank of the terms of highest f among those likelier in the source than in its language."""
    key = ["lang", "source", "bucket"]
    sizes = groups.select("lang", "source", "total", "v", "lang_total")
    held = terms.withColumn("bucket", bucket_of(F.col("n")))
    stats = held.groupBy(*key).agg(F.max("n").alias("most"), F.min("lang_n").alias("least"), F.count("*").alias("terms")).join(sizes, ["lang", "source"])
    bounded = stats.withColumns({"p": chance("most", "total", "v"), "q": chance("least", "lang_total", "v")}).where("p > q").withColumn("bound", f("p", "q"))
    ahead = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounded = materialise(bounded.select(*key, "bound", F.coalesce(F.sum("terms").over(ahead), F.lit(0)).alias("ahead")))
    best, low, high = None, 0, wave
    while True:
        due = bounded.where((F.col("ahead") >= low) & (F.col("ahead") < high))
        if best is not None:
            due = _open(due, best, top)
        seen = held.join(due.select(*key), key).join(sizes, ["lang", "source"])
        seen = seen.withColumns({"p": chance("n", "total", "v"), "q": chance("lang_n", "lang_total", "v")}).where("p > q").select("lang", "source", F.col("term").alias("item"), f("p", "q").alias("value"))
        every = seen if best is None else seen.unionByName(best.drop("rank"))
        new = materialise(_ranked(every, top))
        if best is not None:
            discard(best)
        best, low, high = new, high, high * wave
        if _open(bounded.where(F.col("ahead") >= low), best, top).isEmpty():
            discard(bounded)
            return best


def _open(due: DataFrame, best: DataFrame, top: int) -> DataFrame:
    """The buckets whose bound is not strictly below the last value of their group's full list."""
    last = best.where(F.col("rank") == top).select("lang", "source", F.col("value").alias("last"))
    return due.join(last, ["lang", "source"], "left").where(F.col("last").isNull() | (F.col("bound") >= F.col("last"))).drop("last")


def pair_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value, rank."""
    sizes = groups.select("lang", "source", "total", "v", "p0")
    counts = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(sizes, ["lang", "source"]).withColumn("p", chance("n", "total", "v"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    alone = counts.join(others, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(f("p", "other_p0") * F.col("times")).alias("alone"))
    held = terms.join(sizes, ["lang", "source"]).withColumn("p", chance("n", "total", "v"))
    lists = held.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("held"))
    first = lists.select("lang", "held", F.posexplode("held").alias("at", "a"))
    both = first.select("lang", "a", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("b"))
    shared = f("a.p", "b.p") - f("a.p", "b.p0") - f("b.p", "a.p0")
    met = both.groupBy("lang", F.col("a.source").alias("one"), F.col("b.source").alias("two")).agg(F.sum(shared).alias("shared"), F.count("*").alias("met"))
    mine = groups.select("lang", "source", "v", "kept", "p0")
    theirs = groups.select("lang", F.col("source").alias("other"), F.col("kept").alias("other_kept"), F.col("p0").alias("other_p0"))
    pairs = mine.join(theirs, "lang").where("source <> other").withColumns({"one": F.least("source", "other"), "two": F.greatest("source", "other")})
    back = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("alone").alias("back"))
    joined = pairs.join(met, ["lang", "one", "two"], "left").join(alone, ["lang", "source", "other"], "left").join(back, ["lang", "source", "other"], "left").fillna(0, ["shared", "met", "alone", "back"])
    neither = (F.col("v") - F.col("kept") - F.col("other_kept") + F.col("met")) * f("p0", "other_p0")
    value = F.when(F.col("v") > 0, F.col("alone") + F.col("back") + F.col("shared") + neither).otherwise(0)
    return _ranked(joined.select("lang", "source", F.col("other").alias("item"), value.alias("value")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    postings = materialise(postings_of(docs, least_docs, lang, source, text))
    kept = postings.where("term IS NOT NULL")
    terms = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n")
    groups = materialise(_groups(terms, postings))
    parts = {"pair": pair_sums(terms, groups), "term": top_terms(terms, groups, top)}
    named = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, rows in parts.items()]
    return named[0].unionByName(named[1])
