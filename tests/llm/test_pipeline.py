import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from evidentia.llm import decontaminate, near_dedup, quality, sentencepieces, substring_dedup  # noqa: E402

from .test_decontaminate import brute as leaking  # noqa: E402
from .test_near_dedup import brute as groups  # noqa: E402
from .test_substring_dedup import brute as cut  # noqa: E402


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice(["an", "ti", "re", "sho", "le", "mi"]) for _ in range(r.randrange(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(24)) for i in range(6)]
    passage = prose(50)
    docs = [prose(r.randrange(30, 120)) for _ in range(150)]
    docs += [docs[1]] * 3 + [docs[2] + " tail"] * 2 + [f"{prose(30)} {passage} {prose(30)}" for _ in range(6)]
    docs += [f"{prose(20)} {items[i % 6][1]} {prose(20)}" for i in range(8)] + [None, "", " a\n b "]
    bad = [" | ".join(word() for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs + bad)]
    labels = [(i, int(i < len(docs)), 0) for i in range(len(rows)) if i % 3 and not (len(docs) - 3 <= i < len(docs))]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_stages_against_brute_force(spark, sf):
    path, rows, items = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, path)
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good and 150 < len(good) < len(rows) - 30
    text = {i: t for i, t, *_ in rows if i in good}
    first = set(groups(sorted(text.items())).values())
    left = [(i, text[i]) for i in sorted(first)]
    n_cut = cut(left, 35)
    after = {}
    spans = {r.doc_id: r.kept_text for r in substring_dedup.dedup_substrings(spark.createDataFrame(left, "doc_id long, text string")).collect()}
    for i, t in left:
        after[i] = spans[i] if n_cut[i][1] else t
    leaky = {d for d, _ in leaking([(i, t) for i, t in after.items()], items)}
    out = corpus_pipeline.run(spark, path)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(after) - leaky and leaky
    model = sentencepieces.Model(corpus_pipeline.piece_model_path())
    for i, r in got.items():
        assert r.text == after[i] and r.n_chars == (None if after[i] is None else len(after[i]))
        assert bytes(r.ids_le) == model.encode(after[i] or "")[0] and r.n_tokens * 4 == len(r.ids_le)
    assert near_dedup.THRESHOLD == 0.8 and decontaminate.Q == 12


def test_columns_stay(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf[0]).count() == 0
