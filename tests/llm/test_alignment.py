"""The alignment against a plain loop over the libraries' own encodings."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from evidentia.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, row string, pair string"
TEXTS = [
    "The quick brown fox jumps over the lazy dog", "naïve café – déjà vu, coöperation", "日本語のテキスト と emoji 😀😀 mixed", "a\n  b\t\tc  ", "  leading and trailing   ", " ", "\n", "\u00a0x \u2003y",
    "<s> plain </s> <|endoftext|> text<|endoftext|>", "for i in range(10):\n    if x:\n        print('it''s don't we'll')\n", "x" * 700, "ab" * 300 + " " + "1234567890" * 40, "mark \u2581 of a piece", "zero\u0000byte \x1c sep \x85 next",
    "e\u0301 combining \u200d joiner ", "😀" * 50, "word " * 400, "word " * 400, "", None, "\ufeffbom and \r\n lines\r\nend", "ა ბ გ \u0e01\u0e32\u0e23 ไทย", "tab\tend ", "…", "a ", " a",
]


def plain(texts):
    """Every number of the contract by loops over the whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    entries = alignment.byte_level_entries(a.get_vocab(with_added_tokens=True))
    surface = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for t in texts:
        groups, links, n = [], Counter(), (0, 0)
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xs, ys = [entries[i] for i in x], [surface(i) for i in y]
            if b"".join(xs) == b"".join(ys) == (" " + t).encode():
                n, at, j, g = (len(x), len(y)), (0, 0), 0, ([], [])
                ends = set(_ends(xs)) & set(_ends(ys))
                todo = sorted([(e, 0, i) for e, i in zip(_ends(xs), x, strict=True)] + [(e, 1, i) for e, i in zip(_ends(ys), y, strict=True)], key=lambda r: r[0])
                for k, (e, which, i) in enumerate(todo):
                    g[which].append(i)
                    if e in ends and (k + 1 == len(todo) or todo[k + 1][0] != e):
                        groups.append(g)
                        links.update((p, q) for p in g[0] for q in g[1])
                        g = ([], [])
        counts.update(set(links))
        rows.append((n, groups, links))
    best = Counter()
    for (p, _), c in counts.items():
        best[p] = max(best[p], c)
    out = []
    for n, groups, links in rows:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((*n, len(groups), links.total(), sum(m for k, m in links.items() if counts[k] == best[k[0]]), sum(m * counts[k] for k, m in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def _ends(parts):
    at, out = 0, []
    for p in parts:
        at += len(p)
        out.append(at)
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("wide", "hot"), [(alignment.WIDE, alignment.HOT), (3, 5), (0, 0)])
def test_equals_loops(spark, wide, hot):
    """Also with every document too wide for one row, and with most pairs too rare for the broadcast."""
    docs = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t, "r", "p") for i, t in enumerate(TEXTS)], SCHEMA)
    out = alignment.align(docs, A, B, wide=wide, hot=hot)
    assert out.columns == ["doc_id", *COLUMNS]
    got = sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in COLUMNS)) for r in out.collect())
    want = sorted((-1 if i % 5 == 0 else i % 7, *r) for i, r in enumerate(plain(TEXTS)))
    assert got == want


def test_documents_equal_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in alignment.align(docs, A, B).collect())
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted((r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True))


def test_very_long_text_and_empty_table(spark):
    """A text of a million characters, half of them without a space."""
    text = "lorem ipsum dolor " * 30_000 + "abcdefghij" * 50_000
    docs = spark.createDataFrame([(1, text, "", "")], SCHEMA)
    (row,) = alignment.align(docs, A, B).collect()
    assert tuple(row[c] for c in COLUMNS) == plain([text])[0]
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_random_texts_in_small_slices(spark):
    """Texts of random characters against the library of the first vocabulary's own format."""
    import random

    r = random.Random(5)
    signs = list("ab é'\n\t  .,<>|0129_-\u00a0\u2003\u3000\x1c\x85\u200b😀日ß") + ["'s", " don't", "<|endoftext|>", "<s>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA).repartition(7)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A, B, wide=9).collect()}
    assert [got[i] for i in range(3000)] == plain(texts)


def test_documents_stay_rows_and_sorts_stay_plain(spark):
    """Tokens come a document a row, whatever is encoded together, and no sort or set function is interpreted in a lambda."""
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(TEXTS)], SCHEMA).coalesce(1)
    tokens = alignment.tokenise(docs, A, B)
    assert sorted(r.doc_id for r in tokens.collect()) == list(range(len(TEXTS)))
    plan = alignment.groups_of(tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_intersect(" in plan
    assert all(f"{call}(" not in line for line in plan.splitlines() if "lambdafunction" in line for call in ("sort_array", "array_intersect"))


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_kept_chunks_have_the_same_tokens(limit):
    """Chunks met again, in part or not at all within the limit, have the ids that the tokenizers give."""
    import pyarrow as pa

    pair = alignment.Pair(A, B)
    kept = alignment.Kept(pair, limit)
    for chunks in (["one", "naïve", "two"], ["two", "x" * 99, "one"], [], ["🙂", "naïve", "mark ▁ of", "three"], ["three", "mark ▁ of"]):
        got, want = (e.encode(pa.array(chunks, pa.string()), False) for e in (kept, pair))
        for x, y in zip(got, want, strict=True):
            assert [x[0][b : b + n].tolist() for b, n in zip(x[1], x[2])] == [y[0][b : b + n].tolist() for b, n in zip(y[1], y[2])]
        assert len(kept.number) <= limit
