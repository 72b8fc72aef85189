import random

from pyspark.sql import functions as F

from evidentia.llm.quality import classify, keep_good


def corpus(n=400):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["an", "ti", "re", "sho", "le"]) for _ in range(r.randrange(1, 4)))
    good = lambda: " ".join(word() for _ in range(r.randrange(20, 80))) + "."
    bad = [lambda: " | ".join(word() for _ in range(40)), lambda: " ".join(f"{word()}###" for _ in range(40)), lambda: " ".join(x for x in (word() for _ in range(9)) for _ in range(6))]
    rows = [(i, (bad[i % 3]() if i % 8 == 0 else good()), int(i % 8 != 0)) for i in range(n)]
    return rows


def test_held_out_rows_and_folds(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = classify(docs, labels).toPandas().set_index("doc_id")
    truth = {i: q for i, _, q in rows}
    held = got[got.held_out]
    assert len(got) == len(rows) and 0.1 < len(held) / len(got) < 0.3
    assert (held.predicted == held.index.map(truth)).mean() > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.index[got.predicted == 1])


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a " * 30000)], "doc_id long, text string")
    out = classify(docs, labels).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert classify(docs.where(F.lit(False)), labels.where(F.lit(False))).count() == 0


def test_training_and_scores_against_a_plain_loop(spark):
    from math import exp, sqrt

    from evidentia.llm import quality

    rows = [(t, q) for _, t, q in corpus(60)] + [("", 1), ("one", 0)]
    memo, bits, alpha, beta, l1, l2 = quality.TokenHash(), 12, 1.0, 1.0, 1e-4, 1e-3
    made = []
    for text, label in rows:
        x = {}
        at = quality.features(text, memo, bits).tolist()
        for i in at:
            x[i] = x.get(i, 0) + quality.SCALE / len(at)
        made.append((x | {1 << bits: 1.0}, label))
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((beta + sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(quality.PASSES):
        for x, label in made:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                s = (sqrt(n.get(i, 0.0) + g * g) - sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    weights, bias = quality.train(rows, bits)
    assert abs(bias - weight(1 << bits)) < 1e-6 and max(abs(float(weights[i]) - weight(i)) for i in range(1 << bits)) < 1e-4
    docs = spark.createDataFrame(list(enumerate(t for t, _ in rows)), "doc_id long, text string")
    for r in quality.score(docs, weights, bias, bits).collect():
        x = made[r.doc_id][0]
        assert abs(r.score - 1 / (1 + exp(-sum(weight(i) * v for i, v in x.items())))) < 1e-3


def test_unlike_labels_and_repeated_ids_within_the_bound(spark):
    from evidentia.llm import quality

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (2, None), (4, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (4, 1), (4, 1)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, F.lit(True), 10)
    assert len(rows) == 10 and all(q == 1 for t, q in rows if t.startswith("text"))
