import random

from evidentia.llm.language_id import identify


def corpus():
    r = random.Random(4)
    stems = {"en": ["the", "ing", "tion", "and"], "fr": ["eau", "ment", "é", "oi"], "de": ["ung", "sch", "ü", "keit"]}
    rows = []
    for i in range(240):
        lang = "enfrde"[2 * (i % 3) :][:2]
        rows.append((i, " ".join("".join(r.choice(stems[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !!", "de"), (1003, "the" * 20000, None), (1004, "sch ung", None)]
    df = spark.createDataFrame([(*x, 0.1) for x in rows + odd], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in identify(df).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [(got[i].lang_pred == lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 40 and sum(held) / len(held) > 0.98
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(df).collect()] == ["und", "und"]
    assert identify(df.where("false")).count() == 0


def test_predictions_against_a_plain_loop(spark):
    from math import exp

    import numpy as np

    from evidentia.llm import language_id as L

    rows = corpus()
    model = L.train([(t, lang) for _, t, lang in rows[:90]])
    langs, table, bias, temperature, least = model
    texts = [t for _, t, _ in rows[90:]] + ["a", "é!", "ab" * 3000, "12", ""]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    below = 0
    for i, t in enumerate(texts):
        clean = L.letters_only(t)
        if not clean:
            assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
            continue
        at = [L.of_text(clean[k : k + size])[j] for size, j in ((2, 0), (3, -1), (4, -1)) for k in range(len(clean) - size + 1) if len(L.of_text(clean[k : k + size])) and usable(clean[k : k + size])]
        raw = [sum(float(table[a][k]) for a in at) / max(1, len(at)) + bias[k] for k in range(len(langs))]
        e = [exp((x - max(raw)) / temperature) for x in raw]
        p = [x / sum(e) for x in e]
        assert got[i].lang_pred == langs[int(np.argmax(p))] and abs(got[i].score - max(p)) < 1e-5
        assert got[i].accepted == (got[i].score >= least)
        below += not got[i].accepted
    assert below


def usable(run):
    """A run of letters, between spaces at most."""
    return run != "  " and " " not in run[1:-1]
