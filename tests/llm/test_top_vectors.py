"""The block-wise search against every score."""

import math
import random

import pytest

from evidentia.llm import top_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector string"


def plain(rows, k=5, every=50):
    """Rows of (id, vector); a query's result is the k best of every row that has another id."""
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    top = (1 << 63) - 1
    out = []
    for i, q in kept:
        if i is not None and i % every == 0:
            scored = [(max(-top - 1, min(top, sum(a * b for a, b in zip(q, v, strict=False)))), j) for j, v in kept if j != i]
            scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "i", "v") for i, v in rows], SCHEMA)
    every, how = how.pop("every", 50), {"k": 5, **how}
    out = top_vectors.search(df, df.where(df.vec_id % every == 0), **how)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def clustered(n, dims, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 12]]) for i in range(n)]
    return rows + [(n + i, rows[50][1]) for i in range(n // 3)]


@pytest.mark.parametrize("sizes", [{}, {"shelf": 48, "chunk": 5}, {"shelf": 16, "chunk": 1, "leads": 1}])
def test_equals_every_score(spark, sizes):
    """A third of the rows are copies of one query's vector, so that ties decide."""
    rows = clustered(600, 9)
    assert found(spark, rows, **sizes) == plain(rows)


def test_unclean_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(r.choice([4, 4, 4, 2, 6, 0]))]) for i in range(120)]
    rows += [(50, None), (100, [1.0, None]), (150, [math.nan, 1.0]), (200, [math.inf]), (250, [1e308]), (None, [1.0, 1.0]), (None, [0.5]), (-50, [1.0, -1.0, 1.0, -1.0]), (7, [0.3, 0.1]), (50, [0.25, 0.5])]
    assert found(spark, rows, shelf=32, chunk=2) == plain(rows)


def test_scores_beyond_doubles_and_longs(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([1, -1]) * (2.0 ** r.choice([20, 30, 45]) + i) for _ in range(5)]) for i in range(80)]
    assert found(spark, rows, every=10, shelf=16, chunk=3) == plain(rows, every=10)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0, -0.5]), (1, [-1.0, 0.25]), (2, [0.0, 0.0])]
    assert found(spark, rows) == plain(rows)


def test_bounds_leave_blocks_unread(spark, monkeypatch):
    """On clustered rows most shelves are never sent: the bounds decide, not the data's order."""
    import numpy as np

    m = np.floor(256 * np.array([v for _, v in sorted(clustered(2400, 16), key=lambda r: r[0] % 12)]))
    starts = range(0, len(m), top_vectors.BLOCK)
    b = top_vectors.bounds(m[:40], np.array([m[s : s + 16].max(axis=0) for s in starts]), np.array([m[s : s + 16].min(axis=0) for s in starts]))
    scores = m[:40] @ m.T
    assert all((scores[:, s : s + 16].max(axis=1) <= b[:, i]).all() for i, s in enumerate(starts))
    kth = np.sort(scores, axis=1)[:, -5]
    assert (b >= kth[:, None]).mean() < 0.6
