import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm.quality_rules import CUT, DIMS, FLOORS, UNIT, base_statistics, estimates, judge, robust_distances


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h i", "a " * 9, "x y " * 50, "é ü\n\né ü\n é ü\né ü\r\n" * 3, "# $ <a> |b| 100%", "nb sp " * 40, "\U0001f600 z\x0bq\x0cw"]


def corpus():
    r = random.Random(6)
    out = list(TEXTS)
    for _ in range(60):
        w = [f"w{r.randrange(5)}" for _ in range(r.randrange(120))]
        out.append("".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in w))
    block = [f"b{i}" for i in range(12)]
    out += [" ".join([f"u{i}{j}" for j in range(30)] + block + ["mid"] + block) for i in range(3)]
    return out


def test_statistics_by_hand(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_words int")
    for r in base_statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(rows[r.doc_id]), repr(rows[r.doc_id])


def robust_by_hand(x):
    """Least determinant over three starts, each concentrated until it settles, with exact quantiles."""
    def subset(d):
        return x[d <= np.sort(d)[int(np.ceil(0.75 * len(x))) - 1]]

    def fitted(sub):
        mu, cov = sub.mean(0), np.cov(sub.T, bias=True) + np.diag(np.square(FLOORS))
        return np.linalg.det(cov), np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)

    mid = np.median(x, 0)
    mad = 1.4826 * np.median(abs(x - mid), 0)
    z = abs(x - mid) / np.maximum(mad, FLOORS)
    ends = []
    for start in (z.max(1), z.sum(1), (z * z).sum(1)):
        det, d = fitted(subset(start))
        while True:
            new, further = fitted(subset(d))
            if new >= det * (1 - 1e-9):
                break
            det, d = new, further
        ends.append((det, d))
    det, d = min(ends, key=lambda e: e[0])
    return det, d / max(1, np.median(d) / 3.3567)


def test_estimates_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)) * [0.3, 1, 1, 1] + [1.6, 1, 2, 3]
    x[:100] += [2, 4, 0, 0]
    y = rng.normal(size=(900, 4)) @ rng.normal(size=(4, 4)) + 2
    y[::7] = [4, 0, 4, 0]  # ties: many equal rows far off
    both = {"g": np.round(x, 3), "h": np.round(y, 3)}
    rows = [(1000 * k + i, g, *[int(round(v * UNIT)) for v in row]) for k, (g, m) in enumerate(both.items()) for i, row in enumerate(m.tolist())]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], f"doc_id long, group string, {', '.join(f'{d} long' for d in DIMS)}")
    got = robust_distances(df).toPandas().set_index("doc_id").sort_index()
    dets = {r.group: r.det for r in estimates(df).collect()}
    for g, m in both.items():
        det, want = robust_by_hand(m)
        mine = got[got.group == g].distance.to_numpy()
        assert abs(dets[g] / det - 1) < 0.1
        assert np.median(abs(mine - want) / np.maximum(want, 1)) < 0.1
        assert ((mine > CUT) == (want > CUT)).mean() > 0.99
    mine = got[got.group == "g"].distance.to_numpy()
    assert (mine[:100] > CUT).mean() > 0.9 and (mine[100:] > CUT).mean() < 0.005


def test_small_groups_are_judged_by_their_language_or_all(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(2, 9))) for _ in range(n)) + "."
    noisy = lambda n: " ".join(f"{w}###" for w in prose(n).split())
    rows = [(i, prose(60), "en", "big") for i in range(60)] + [(100, noisy(60), "en", "rare"), (101, prose(60), "en", "rare")]
    rows += [(200, noisy(60), "xx", "one"), (201, prose(60), "yy", None)]
    got = {x.doc_id: x for x in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[100].kept and not got[200].kept
    assert got[101].kept and got[201].kept and all(got[i].kept for i in range(60)) and all(x.distance is not None for x in got.values())


def test_outliers_and_odd_rows(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(2, 9))) for _ in range(n)) + "."
    rows = [(i, prose(r.randrange(25, 300)), "en", "s") for i in range(300)]
    rows += [(900 + i, " ".join(f"{w}###" for w in prose(60).split()), "en", "s") for i in range(6)]
    rows += [(950, None, None, None), (951, "", "en", None), (952, prose(40), None, "s"), (952, prose(40), None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(1))
    got = judge(df).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].kept for i in range(300)) and not any(by[900 + i].kept for i in range(6))
    assert not by[950].kept and by[950].base_failed and by[952].kept
    assert judge(df.where("false")).count() == 0


def test_equal_rows_share_their_verdict_and_long_texts_count_whole(spark):
    line = "plain words of a usual kind that stand in this line and in no other one of them"
    rows = [(i, f"{line} {i}\nand {i} more words follow here to make it long enough", "en", "s") for i in range(50)]
    rows += [(100 + i, " ".join(f"w{i}-{k}" for k in range(60_000)), "en", "s") for i in range(2)] + [(200, rows[0][1], "en", "s")] * 30
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()
    same = {(x.distance, x.kept) for x in got if x.doc_id in (0, 200)}
    assert len(got) == len(rows) and len(same) == 1
    assert {x.n_words for x in got if x.doc_id in (100, 101)} == {60_000}
