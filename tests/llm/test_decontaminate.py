import random

from evidentia.llm.decontaminate import LETTERS_PER_EDIT, MIN_LETTERS, Q, Segments, band_edits, drop_leaks, leaks, letters, normalised, qgrams


def semi_global(seg, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(seg, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def corpus():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abdeiklmnorst") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.choice([12, 20, 35, 60]))) for i in range(12)] + [(90, None), (91, ""), (92, "short one"), (93, "a Short, exact phrase of some letters"), (94, "tiny")]
    docs = [(0, None), (1, ""), (2, prose(900))]
    for d in range(3, 60):
        item = r.choice(items[:12])[1]
        chars = list(item)
        for _ in range(r.choice([0, 0, 1, 3, 6, 12, 40])):
            k = r.randrange(len(chars))
            chars[k] = r.choice(["", "z", "Q", "xy"])
        part = "".join(chars)
        docs.append((d, f"{prose(r.randrange(60))}, {part.upper() if d % 5 == 0 else part}!\n{prose(r.randrange(60))}"))
    docs += [(100 + d, prose(80)) for d in range(20)]
    docs += [(200, f"{prose(9)} a short exact PHRASE of some letters. {prose(9)}"), (201, "a short exact phrase of some letters"), (202, "a short exact phrase of some letterses"), (203, "a short exact phrase of some lettrs")]
    docs += [(204, "Tiny!"), (205, "tiny thing"), (206, "short one"), (207, "that short one"), (200, prose(30)), (None, items[0][1])]
    return docs, items


def brute(docs, items):
    segs = Segments([(i, t) for i, t in items if t])
    out = set()
    for d, t in docs:
        n = normalised(t)
        for item, code in zip(segs.item, segs.codes, strict=True):
            seg = "".join(map(chr, code))
            if n and (f" {seg} " in f" {n} " if len(code) < MIN_LETTERS else semi_global(seg, n) <= len(code) // LETTERS_PER_EDIT):
                out.add((d, item))
        out |= {(d, item) for item, x in items if n and len(normalised(x)) < Q and normalised(x) == n}
    return out


def test_same_pairs_as_full_alignment(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert len(want) > 20
    got = [(r.doc_id, r.item_id) for r in leaks(df, bench).collect()]
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    assert sorted(got, key=key) == sorted(want, key=key) and {(201, 93), (204, 94), (None, 0)} <= want
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench, block_letters=300).collect()} == want
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns
    rows = {(r.doc_id, r.text) for r in kept.collect()}
    assert rows == {(d, t) for d, t in docs if not brute([(d, t)], items)} == {(r.doc_id, r.text) for r in drop_leaks(df, bench, block_letters=300).collect()}


def test_pieces(spark):
    a = letters("abcdefghijklmnop")
    assert len(qgrams(a)) == 16 - Q + 1 and qgrams(a)[1] == qgrams(a[1:])[0]
    assert band_edits(letters("hello"), letters("say helo now"), 2, 4)[0] == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert leaks(empty, bench).count() == 0
    one = spark.createDataFrame([(None, "a b"), (3, "c")], "doc_id long, text string")
    assert drop_leaks(one, bench).count() == 2


def test_very_long_texts_and_repeated_items(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abdeiklmnorst") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(40)
    docs = [(1, f"{prose(300_000)} {item} {prose(50_000)}"), (2, prose(300_000)), (3, item * 3)]
    bench = spark.createDataFrame([(7, item), (7, item), (8, item.upper())], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 7), (1, 8), (3, 7), (3, 8)}


def test_segments_of_a_chunk_are_aligned_together(monkeypatch):
    """Leaks are those of a text by itself, in any size of group, and the alignment is called for groups and not for segments."""
    import numpy as np

    from evidentia.llm import decontaminate as D

    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [(i, prose(r.randrange(6, 40))) for i in range(20)] + [(90, "one short item")]
    texts = [prose(20), None, ""]
    for k in range(60):
        t = list(items[k % 21][1])
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = "z"
        texts.append(" ".join([prose(5), "".join(t), prose(5)]))
    segs, calls, run = Segments(items), [], D.aligned_edits
    alone = [(i, *rest) for i, t in enumerate(texts) for _, *rest in D._hits(segs)([t])]
    monkeypatch.setattr(D, "aligned_edits", lambda *a: calls.append(len(a[0])) or run(*a))
    assert sorted(D._hits(segs)(texts)) == sorted(alone) and len(alone) > 30
    assert len(calls) <= 20 < sum(calls)
    calls.clear()
    monkeypatch.setattr(D, "ALIGNED", 3)
    assert sorted(D._hits(segs)(texts)) == sorted(alone) and max(calls) <= 3
    doc, seg, low = (np.array(x) for x in zip(*[(r.randrange(3), r.randrange(2), r.randrange(-2, 2)) for _ in range(80)], strict=True))
    for far in (1, 1 << 40):  # within and beyond the room of one number
        got, hits = D._counted(doc * far, seg * far, low)
        want, n = np.unique(np.stack([doc * far, seg * far, low], 1), axis=0, return_counts=True)
        assert (got == want).all() and (hits == n).all()
