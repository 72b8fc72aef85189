"""The divergence audit against plain loops over every term and source."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from evidentia.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, rank string"


def plain(rows, least_docs, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        g = (lang or "", source or "")
        groups.add(g)
        counts[g].update(words)
        docs[g[0]].update(set(words))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= least_docs}
        ours = [g for g in groups if g[0] == lang]
        total = {g: sum(counts[g][t] for t in kept) for g in ours}
        p = lambda g, t: 1 + 10**9 * (counts[g][t] + 2) // (total[g] + 2 * len(kept))  # noqa: B023, E731
        whole = lambda t: 1 + 10**9 * (sum(counts[g][t] for g in ours) + 2) // (sum(total.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        me = (lang, source)
        pairs = [(g[1], sum(f(p(me, t), p(g, t)) for t in kept)) for g in ours if g != me]
        terms = [(t, f(p(me, t), whole(t))) for t in kept if counts[me][t] and p(me, t) > whole(t)]
        for part, items, n in (("pair", pairs, None), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:n], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def rows_of(n, seed=7):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'é' if i % 7 == 0 else ''}{chr(97 + i // 26)}" for i in range(120)] + ["The", "THE", "ÄB", "äb", "a1b", "x_y", "日本"]
    made = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "en", "de", None]), r.choice(["hot"] * 5 + ["s1", "s2", "s3", None])
        made.append((" ".join(r.choice(words[: r.choice([10, 60, 127])]) for _ in range(r.randrange(0, 60))), lang, source))
    return [*made, (None, "en", "only null"), ("", "xx", "none"), ("alone", "yy", "a"), ("alone", "yy", "b"), *[("same words here", "zz", s) for s in "abc" for _ in range(5)]]


@pytest.mark.parametrize(("least_docs", "wave"), [(10, 64), (2, 2), (1, 2)])
def test_equals_loops(spark, monkeypatch, least_docs, wave):
    """Also in many small waves, with few counts in a bucket of their own and tasks that pass on their counts early."""
    if wave == 2:
        monkeypatch.setattr(divergence, "EXACT", 2)
        monkeypatch.setattr(divergence, "BUCKETS", 1)
        monkeypatch.setattr(divergence.top_terms, "__defaults__", (10, 2))
    rows = rows_of(400)
    docs = spark.createDataFrame([(i % 50, *r, 1, "t", "r") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    out = divergence.audit(docs, least_docs)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, least_docs)


def test_empty_table_and_no_kept_term(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).collect() == []
    few = spark.createDataFrame([(1, "a b", "en", s, 1, "", "") for s in "xyz"], SCHEMA)
    assert sorted(tuple(r) for r in divergence.audit(few).collect()) == plain([("a b", "en", s) for s in "xyz"], 10)


def test_counts_beyond_longs_stay_exact(spark):
    n, total, v = 40_000_000_000, 700_000_000_001, 12_345
    row = spark.createDataFrame([(n, total, v, 5)], "n long, total long, v long, m long").select(divergence.chance("n", "total", "v"), divergence.chance("m", "total", "v")).first()
    assert tuple(row) == tuple(1 + 10**9 * (k + 2) // (total + 2 * v) for k in (n, 5))


def test_long_texts_are_split_between_words(monkeypatch):
    text = ("Lorem ipsum dolor-sit " * 400 + "x" * 500 + " ende").encode()
    whole = [w for part in divergence.words_of(text) for w in part]
    monkeypatch.setattr(divergence, "BLOCK", 7)
    assert [w for part in divergence.words_of(text) for w in part] == whole == text.translate(divergence.LETTERS).split()


def test_tasks_flush_without_loss(monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 4)
    batch = pa.record_batch([pa.array(["en", "de"] * 20), pa.array(["s"] * 40), pa.array([f"a b {chr(97 + i % 26)}{chr(97 + i // 26)}".encode() for i in range(40)])], names=["lang", "source", "raw"])
    n, docs = Counter(), Counter()
    for part in divergence._count(iter([batch])):
        for r in part.to_pylist():
            n[r["lang"], r["term"]] += r["n"]
            docs[r["lang"], r["term"]] += r["docs"]
    assert +n == +docs
    assert n["en", "a"] == 20 and n["de", None] == 0 and n.total() == 120 and len(n) == 46
