import hashlib
import random
import re
from collections import Counter

from evidentia.llm.substring_dedup import compact, cut_columns, dedup_substrings, digests, with_neighbours


def brute(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus():
    r = random.Random(5)
    text = lambda n, v=40: " ".join(f"w{r.randrange(v)}é" for _ in range(n))
    shared = [text(r.randrange(30, 90)) for _ in range(4)]
    rows = [None, "", " \n\t ", "a " * 200, "x y z " * 40, text(34), text(35)]
    rows += [text(r.randrange(1, 300)) for _ in range(10)]
    rows += [f"{text(r.randrange(60))}\n{r.choice(shared)}  {text(r.randrange(60))}" for _ in range(40)]
    rows += [rows[-1]] * 5 + [rows[10] + " tail"] + ["nb sp em " * 30]
    rows += [text(4000, 3)]
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept_text string").repartition(5)
    for window, k in ((35, 8), (9, 4)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests(dedup_substrings(df, window, k)).collect()}
        assert got == brute(rows, window)


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(map(str, range(40)))
    rows = dedup_substrings(spark.createDataFrame([(None, text), (None, text), (7, text), (8, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 40), (0, 40), (7, 40), (8, 0)]


def test_rows_of_one_id_do_not_mix_and_names_do_not_clash(spark):
    r = random.Random(9)
    fresh = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    shared = fresh(50)
    texts = [f"{fresh(10)} {shared}", fresh(100), f"{shared} {fresh(5)}", fresh(3), None, fresh(60), f"{fresh(70)} {shared}", fresh(30_000)]
    ids = [None, None, None, 4, 4, 4, 4, None]
    rows = [(i, t, k, 0, 1, 2, 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, row int, `of` int, start int, n_chars int").repartition(3)
    want = brute(list(enumerate(texts)), 35)
    got = {x.spans: x for x in cut_columns(df).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        n, gone, sha = want[k]
        if gone:
            assert hashlib.sha256(got[k].text.encode()).hexdigest() == sha and got[k].n_chars == len(got[k].text)
        else:
            assert got[k].text == t
    assert sorted((x.n_words, x.n_removed, x.kept_sha256) for x in digests(dedup_substrings(df)).collect()) == sorted(want.values())


def test_paths_end_where_the_graph_branches(spark):
    # units a b c in two texts, a b d in a third: b forks, so the path a-b ends there
    rows = [(r, at, 2, ord(u), 0) for r, units in enumerate(["abc", "abc", "abd", "x"]) for at, u in zip(range(0, 9, 2), units)]
    got = {(x.row, x.start, x.edges) for x in compact(with_neighbours(spark.createDataFrame(rows, "row long, start int, edges int, u1 long, u2 long"))).collect()}
    assert got == {(0, 0, 4), (0, 4, 2), (1, 0, 4), (1, 4, 2), (2, 0, 4), (2, 4, 2), (3, 0, 2)}
