import random
from collections import Counter

import numpy as np

from evidentia.llm.near_dedup import aligned_similarity, keep_one, near_groups


def shingles(t):
    w = (t or "").split()
    s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    n = Counter()
    out = []
    for x in s:
        n[x] += 1
        out.append((x, n[x]))
    return set(out)


def brute(rows):
    sh = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (sh[i] and len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def corpus(seed=3):
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = [None, None, "", "", "one two", "one  two", "three", "a " * 60]
    for _ in range(25):
        base = fresh(r.randrange(30, 300))
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 8])):
                w[r.randrange(len(w))] = "edit"
            if r.random() < 0.3:
                w = w + fresh(3)
            texts.append(" ".join(w))
    big = fresh(400)
    texts += [" ".join([*big[:i], "x", *big[i + 1 :]]) for i in range(0, 390, 3)]
    passage = fresh(60)
    texts += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(120)]
    return list(enumerate(texts))


def test_same_groups_as_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rep int").repartition(4)
    got = {r.doc_id: r.group_id for r in near_groups(df).collect()}
    assert got == brute(rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_empty_and_null(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, None), (5, None), (6, "q")], "doc_id long, text string")
    assert keep_one(df).count() == 4


def test_repeated_and_null_ids_and_clashing_names(spark):
    r = random.Random(11)
    fresh = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    base, other, long = fresh(100), fresh(40), fresh(60_000)
    near = base + " end"
    rows = [(5, None), (6, "null 5"), (None, None), (7, base), (7, other), (7, base), (3, near), (None, other), (None, other), (9, fresh(30)), (20, long), (21, long + " x"), (30, "same words here"), (30, "same words here")]
    df = spark.createDataFrame([(i, t, k, 1, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, ident int, rep int, digest string").repartition(3)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.class_id or 0, x.group_id or 0) for x in near_groups(df).collect())
    want = [(False, 3, 3, 3), (False, 5, 5, 5), (False, 6, 6, 6), (False, 7, 7, 3), (False, 7, 7, 3), (False, 7, 7, 7), (False, 9, 9, 9), (False, 20, 20, 20), (False, 21, 21, 20), (False, 30, 30, 30), (False, 30, 30, 30), (True, 0, 0, 0), (True, 0, 7, 7), (True, 0, 7, 7)]
    assert got == sorted(want)
    kept = keep_one(df)
    assert kept.columns == df.columns
    left = Counter((x.doc_id, x.text) for x in kept.collect())
    assert left == Counter([(5, None), (None, None), (6, "null 5"), (3, near), (7, other), (9, rows[9][1]), (20, long), (30, "same words here")])


def test_copies_that_lose_exactly_a_fifth_at_the_front():
    for n in range(5, 500, 5):
        x = np.arange(n, dtype=np.uint64)
        assert aligned_similarity(x, x[n // 5 :]) == aligned_similarity(x[n // 5 :], x) == 0.8
        assert aligned_similarity(x, x[n // 5 + 1 :]) == 0.0


def test_pairs_inside_a_crowd_just_below_the_threshold(spark):
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    texts = [" ".join(fresh(8) + passage) for _ in range(2000)]  # two of them: 56 of 72 shingles, 0.78
    pairs = {}
    for k in range(0, 80, 2):
        last = fresh(1)
        texts[k], texts[k + 1] = (" ".join(fresh(7) + last + passage) for _ in range(2))  # 57 of 71, 0.803
        pairs[k + 1] = k
    got = {g.doc_id: g.group_id for g in near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: pairs.get(i, i) for i in range(len(texts))}
