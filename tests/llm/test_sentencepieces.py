import hashlib
import struct

import public_tokenizers as P
import pytest
import sentencepiece as sp
from pyspark.sql import functions as F

from evidentia.llm.sentencepieces import CharMap, Model, digests, encode

PATH = P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "  two  spaces   here ", "line\nbreaks\n\n\tand tabs\r\n", "café über naïve ß",
    "▁mark ▁ inside▁", "emoji \U0001f600\U0001f3fd and 中文字", "1234567890 3.14e-10", "\x00\x01\x7f control",
    "x" * 500, "ab " * 2000, "nospaces" * 300, "абв אב", "<s> </s> <unk> <0x0A>", "�", "ﬁ ﬂ ① Ⅳ ｱﾞ",
]


def test_same_ids_and_text_as_the_library(spark):
    lib = sp.SentencePieceProcessor(model_file=PATH)
    rows = digests(encode(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), PATH)).collect()
    for r in rows:
        ids = lib.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) == r.n_spans
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), TEXTS[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest(), TEXTS[r.doc_id]


def test_spans_tile_the_source():
    m = Model(PATH)
    for t in TEXTS:
        t = t or ""
        _, spans, _ = m.encode(t)
        got = list(struct.iter_unpack("<2I", spans))[1:-1]
        assert b"".join(t.encode()[a:b] for a, b in got) == t.encode()
    ids, spans, _ = m.encode("hello  wörld")
    assert list(struct.iter_unpack("<2I", spans))[-1] == (13, 13)


@pytest.mark.parametrize("rule", ["nfkc_cf"])
def test_compiled_map_by_longest_prefix(rule):
    lib = sp.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    cm = CharMap.compiled(proto.normalizer_spec.precompiled_charsmap)
    for t in filter(None, TEXTS):
        steps = list(cm.steps(t.encode()))
        assert sum(n for _, n in steps) == len(t.encode())
        assert b"".join(o for o, _ in steps).decode() == lib.normalize(t)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, decoded int, ids_le int")
    assert encode(df, PATH).count() == 0
    two = spark.createDataFrame([(1, "a", 5), (1, "a", 5)], "doc_id long, text string, decoded int")
    assert [r.decoded for r in encode(two, PATH).collect()] == ["a", "a"]
    assert encode(two, PATH).where(F.col("decoded") == "a").count() == 2


def test_words_of_a_slice_are_merged_together(monkeypatch):
    """Random texts in slices that share a memo: as the library, and only units with unknown characters or of great length are merged alone."""
    import random

    from evidentia.llm import sentencepieces

    alone, merge = [], Model.merge
    monkeypatch.setattr(Model, "merge", lambda self, text: alone.append(text) or merge(self, text))
    monkeypatch.setattr(sentencepieces, "MEMO_ENTRIES", 400)
    r = random.Random(4)
    parts = ["the", "an", "ti", "qu", "é", "Zz", " ", " ", "  ", "\n", "7", ".", "▁", "中", "\U0001f600", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(300)] + ["theanti" * 40, "", "plain words only"] * 2
    m, lib = Model(PATH), sp.SentencePieceProcessor(model_file=PATH)
    for a, b in sentencepieces.slices([None, *texts]):
        at, ids, spans, decoded = m.encode_all([t or "" for t in [None, *texts][a:b]])
        assert len(decoded) == b - a and len(spans) == len(ids) == at[-1]
    for i in range(0, len(texts), 50):
        some = texts[i : i + 50]
        at, ids, spans, decoded = m.encode_all(some)
        for k, t in enumerate(some):
            want = lib.encode(t, add_bos=True, add_eos=True)
            assert ids[at[k] : at[k + 1]].tolist() == want and decoded[k].decode() == lib.decode(want)
            own = spans[at[k] : at[k + 1]].tolist()[1:-1]
            assert b"".join(t.encode()[x:y] for x, y in own) == t.encode()
    assert not any(u.isascii() and len(u) <= sentencepieces.LONG and u.isalpha() for u in (x.strip("▁") for x in alone))
