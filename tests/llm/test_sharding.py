import random
import zlib

from evidentia.llm.sharding import cut_bytes, documents, propagate, shard


def corpus():
    r = random.Random(8)
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(5, 400))) for _ in range(3000)]
    texts += [texts[0]] * 900 + [texts[1]] * 40 + [x for x in texts[2:60] for _ in range(3)]
    return [(i, t) for i, t in enumerate(texts)] + [(90000, None), (90001, ""), (None, "n"), (5, texts[5])]


def test_even_gapless_and_together(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, law string").repartition(3)
    got = shard(df, shards=8).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    loads, slots, groups = {}, {}, {}
    for g in got:
        raw = (text[g.doc_id] or "").encode()
        assert (g.size, g.text_crc32, g.law, g.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        loads[g.shard] = loads.get(g.shard, 0) + g.size
        slots.setdefault(g.shard, []).append(g.slot)
        groups.setdefault(text[g.doc_id], []).append(g.shard)
    mean = sum(loads.values()) / 8
    assert set(loads) == set(range(8)) and max(abs(v - mean) for v in loads.values()) < 0.02 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    small = [len(set(v)) for t, v in groups.items() if t and 1 < len(v) <= 41]
    assert sum(n == 1 for n in small) > 0.9 * len(small)
    firsts = {r.row: r.shard for r in documents(df, 8).collect()}
    assert len(set(firsts.values())) == 8


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_propagation_cuts_fewer_links_and_keeps_quotas(spark):
    rows = corpus()
    first = documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).cache()
    linked = propagate(first, 8)
    before = cut_bytes(first.join(linked.select("row"), "row"))
    assert cut_bytes(linked) < 0.2 * before
    total = first.selectExpr("sum(size) as s").first().s
    assert max(r.s for r in linked.groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()) <= total / 8


def test_repeated_rows_and_very_long_texts(spark):
    rows = [(1, "same words")] * 400 + [(2, "x" * 3_000_000)] + [(None, None)] * 100 + [(i, f"text {i}") for i in range(10, 60)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=4).collect()
    assert len(got) == len(rows) and sorted(g.size for g in got) == sorted(len(t or "") + 16 for _, t in rows)
    slots = {}
    for g in got:
        slots.setdefault(g.shard, []).append(g.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
