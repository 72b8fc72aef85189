import random

import pytest

from evidentia.llm import graph, near_dedup


def test_components_of_paths_stars_and_dense_groups(spark):
    r = random.Random(4)
    path = list(range(0, 400, 2))
    jumbled = r.sample(range(1001, 1200), 150)
    dense = r.sample(range(2000, 2100), 40)
    star = r.sample(range(3000, 3500), 300)
    edges = [*zip(path, path[1:], strict=False), *zip(jumbled[1:], jumbled, strict=False), *((a, b) for a in dense for b in dense if r.random() < 0.5 or a == dense[0]), *((max(star), b) for b in star)]
    want = {x: min(group) for group in (path, jumbled, dense, star) for x in group}
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert {x.id: x.component for x in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def loose_group(n, seed=8):
    """Texts with edits of their own all over, each less than 0.8 like most others, and links enough to make groups."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**9)}" for _ in range(300)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.choice([2, 3, 5, 6, 7])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def counted(monkeypatch):
    seen = {"edges": 0, "pairs": 0}
    components, verified = near_dedup.components, near_dedup._verified

    def count(name, made):
        def run(rows, *more):
            seen[name] += rows.count()
            return made(rows, *more)

        return run

    monkeypatch.setattr(near_dedup, "components", count("edges", components))
    monkeypatch.setattr(near_dedup, "_verified", count("pairs", verified))
    return seen


def test_edges_between_groups_are_few(spark, counted):
    docs = spark.createDataFrame(list(enumerate(loose_group(600))), "doc_id long, text string").repartition(4)
    groups = {g.group_id for g in near_dedup.near_groups(docs).collect()}
    # with all links and the edges of all groups again in every round there were 2,611
    assert len(groups) == 132 and counted["edges"] <= 3 * 600


def test_texts_are_dealt_out_once_and_only_those_that_meet(spark, monkeypatch):
    asked, texts, verified, rounds = [], near_dedup._texts, near_dedup._verified, []

    def counted(docs, chosen):
        asked.append(chosen.count())
        return texts(docs, chosen)

    monkeypatch.setattr(near_dedup, "_texts", counted)
    monkeypatch.setattr(near_dedup, "_verified", lambda *a: rounds.append(1) or verified(*a))
    r = random.Random(9)
    rows = loose_group(300) + [" ".join(f"w{r.randrange(10**9)}" for _ in range(60)) for _ in range(100)]
    got = {g.doc_id: g.group_id for g in near_dedup.near_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] == i for i in range(300, 400)) and len(set(got.values())) < 300
    assert len(rounds) > 2 and len(asked) == 1 and asked[0] <= 300
