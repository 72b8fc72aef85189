"""Alignment of two tokenizers: the groups of tokens that cover the same bytes, and the pairs that they link.

Both tokenizers encode the same bytes, a space and the text. A task splits texts where neither can join tokens
(before a space that follows a character which is no white space), encodes each chunk once for some megabytes of
text, keeps the tokens of its first chunks, and returns documents as ends with ids, nothing more. All that follows
is array functions: the ends that both share cut the text into groups, found by `array_intersect`; a sort of tokens
and cuts together puts a mark between groups, at which the ids are split; both sides of a group are zipped, and
products of its ids are the links. A pair's count is the number of documents that hold it.

Links come back to their documents by a broadcast of the commonest pairs, at most `HOT` of them, which a
histogram of the counts picks; the others meet in a join by pair. A document of more than `WIDE` links never holds
them in one row: its groups are exploded instead.

Defined results: a null or empty text, and one whose tokens don't spell it (U+2581 in it, say), has no tokens, zeros
and '' for its digest; repeated rows and null ids count as documents of their own; very long texts go through whole;
equal counts are all best; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import docs_of, materialise, ship

ship(__name__)

SPACE = "▁"
#: rows and bytes of text that a task takes at once
SLICE = 1024
SLICE_BYTES = 1_500_000
#: different chunks whose tokens a task keeps
KEPT = 100_000
#: chunks that are encoded as one text
TOGETHER = 100
#: ids of the second tokenizer in a pair's number are below this
PAIR = 1 << 20
#: a token's number is its end * TOKEN + its id; ids are below the last one, which marks an end
TOKEN = 1 << 21
MARK = TOKEN - 1
WIDE = 1 << 16
HOT = 200_000

LONGS = T.ArrayType(T.LongType(), False)
TOKENS = T.StructType().add("row", "long").add("doc_id", "long")
for _column in ("a_tokens", "a_marks", "b_tokens", "b_marks"):
    TOKENS = TOKENS.add(_column, LONGS)


#: how byte-level texts are split before merges; a fixed value
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pair:
    """Two tokenizers over the same bytes: byte-level merges with a pattern, and pieces with a space before the text."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import numpy as np
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("the first tokenizer has to be byte-level without a normaliser")
        special = {t["content"] for t in spec["added_tokens"]}
        self.a_bytes = byte_level_entries({t: i for t, i in spec["model"]["vocab"].items() if t not in special})
        ranks = {entry: i for i, entry in enumerate(self.a_bytes) if entry}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m] for m in merged]
        if order != sorted(order):
            raise ValueError("the first tokenizer's ids have to follow the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b = lambda texts: b.encode(texts, num_threads=1)
        # no piece has a space after another character, and the model keeps spaces: a text may be cut before them
        self.plain = b.decode(b.encode(" a  b ")) == " a  b " and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.entries = (self.a_bytes, self.b_bytes)
        self.sizes = [np.array([len(x) for x in entries], dtype=np.int32) for entries in self.entries]

    def both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text, by either; a text that its tokens don't spell has none."""
        a, b = [self.a(f" {t}") for t in texts], self.b(texts)
        raw = "".join(f" {t}" for t in texts).encode()
        if any(b"".join(map(entries.__getitem__, chain.from_iterable(ids))) != raw for entries, ids in zip(self.entries, (a, b), strict=True)):
            if len(texts) > 1:
                each = [self.both([t]) for t in texts]
                return [x[0][0] for x in each], [x[1][0] for x in each]
            return [[]], [[]]
        return a, b

    def encode(self, chunks: pa.StringArray, joinable: bool) -> list[tuple]:
        """For either tokenizer: the ids of all chunks, where those of each begin, and how many they are.

        Chunks that may stand before any other are encoded as texts of many and told apart by their lengths.
        """
        import numpy as np
        import pyarrow.compute as pc

        texts, lengths = chunks.to_pylist(), pc.binary_length(chunks).to_numpy()
        joined = np.flatnonzero([joinable or bool(c) and safe(c[-1]) for c in texts]) if self.plain else np.zeros(0, int)
        ids = self.both([" ".join([texts[i] for i in joined[k : k + TOGETHER]]) for k in range(0, len(joined), TOGETHER)])
        if not all(ids[0]):
            joined, ids = joined[:0], ([], [])
        alone = np.setdiff1d(np.arange(len(texts)), joined)
        each = self.both([texts[i] for i in alone])
        ends = np.cumsum(lengths[joined] + 1)
        out = []
        for together, rest, size in zip(ids, each, self.sizes, strict=True):
            together = np.fromiter(chain.from_iterable(together), np.int32)
            starts = np.concatenate([[0], np.searchsorted(np.cumsum(size[together]), ends, side="right")]).astype(np.int64)
            later = len(together) + np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int64)
            begin, end = np.zeros((2, len(texts)), dtype=np.int64)
            begin[joined], end[joined], begin[alone], end[alone] = starts[:-1], starts[1:], later[:-1], later[1:]
            out.append((np.concatenate([together, np.fromiter(chain.from_iterable(rest), np.int32)]), begin, end - begin))
        return out


class Kept:
    """The tokens of the first chunks that a task meets, at most so many, which are encoded once a task."""

    def __init__(self, pair: Pair, limit: int):
        import numpy as np

        self.pair, self.limit, self.number = pair, limit, {}
        self.tokens = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

    def encode(self, chunks: pa.StringArray, joinable: bool) -> list[tuple]:
        """As the tokenizers' own encode, for chunks that differ."""
        import numpy as np

        texts = chunks.to_pylist()
        at = np.fromiter((self.number.get(t, -1) for t in texts), np.int64, len(texts))
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        more = new[: self.limit - len(self.number)]
        out, tokens = [], []
        for (ids, begin, count), (new_ids, new_begin, new_count) in zip(self.tokens, self.pair.encode(chunks.take(pa.array(new)), joinable), strict=True):
            begins, counts = np.zeros((2, len(texts)), dtype=np.int64)
            begins[old], counts[old], begins[new], counts[new] = begin[at[old]], count[at[old]], new_begin + len(ids), new_count
            out.append((np.concatenate([ids, new_ids]), begins, counts))
            n = counts[more]
            own = out[-1][0][np.repeat(begins[more] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            tokens.append((np.concatenate([ids, own]), np.concatenate([begin, len(ids) + np.cumsum(n) - n]), np.concatenate([count, n])))
        self.tokens = tokens
        self.number.update((texts[i], k) for k, i in enumerate(more.tolist(), len(self.number)))
        return out


def safe(c: str) -> bool:
    """Letters, numbers, punctuation, signs and marks: no pattern takes them for white space."""
    return unicodedata.category(c)[0] in "LNPSM"


def chunks_of(parts: list[str]) -> list[str]:
    """Parts between spaces joined again until each ends in a character that is no white space."""
    out, cur = [], None
    for p in parts:
        cur = p if cur is None else f"{cur} {p}"
        if p and safe(p[-1]):
            out.append(cur)
            cur = None
    if cur is not None:
        if cur.strip(" ") or not out:
            out.append(cur)
        else:
            out[-1] += f" {cur}"
    return out


def byte_level_entries(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of every entry: printable Latin-1 characters stand for themselves, the other bytes for 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in set(printable)))
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        if all(c in byte_of for c in entry):
            out[i] = bytes(byte_of[c] for c in entry)
    return out


def _rows(kept: Kept, part: pa.RecordBatch, chunks: pa.ListArray, joinable: bool = False) -> pa.RecordBatch:
    """Tokens of documents: every chunk that occurs is encoded once and its ids are laid out where it stands."""
    import numpy as np

    coded = chunks.flatten().dictionary_encode()
    at, sizes = coded.indices.to_numpy(), np.diff(chunks.offsets.to_numpy())
    encoded = kept.encode(coded.dictionary, joinable)
    # a chunk without tokens is one that they don't spell; its documents have no chunks
    spelt = encoded[0][2] > 0
    if not spelt.all():
        row = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.bincount(row, weights=~spelt[at], minlength=len(sizes)) == 0
        at, sizes = at[whole[row]], np.where(whole, sizes, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    columns = {x: part.column(x) for x in ("row", "doc_id")}
    for name, (ids, starts, count), size in zip("ab", encoded, kept.pair.sizes, strict=True):
        before = np.concatenate([[0], np.cumsum(count[at])])
        tokens = ids[np.repeat(starts[at] - before[:-1], count[at]) + np.arange(before[-1])]
        offsets = before[bounds]
        ends = np.concatenate([[0], np.cumsum(size[tokens], dtype=np.int64)])
        ends = (ends[1:] - np.repeat(ends[offsets[:-1]], np.diff(offsets))) * TOKEN
        of_rows = lambda values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))  # noqa: B023, E731
        columns |= {f"{name}_tokens": of_rows(ends + tokens), f"{name}_marks": of_rows(ends + MARK)}
    return pa.record_batch([columns[f.name] for f in TOKENS.fields], names=TOKENS.names)


def _tokenise(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        pair = Pair(a_path, b_path)
        kept = Kept(pair, KEPT)

        def made(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            text = part.column("text")
            none = pc.fill_null(pc.or_(pc.equal(text, ""), pc.match_substring(text, SPACE)), True)
            bare, part = part.filter(none), part.filter(pc.invert(none))
            if bare.num_rows:
                yield _rows(kept, bare, pa.array([[]] * bare.num_rows, pa.list_(pa.string())))
            split = pc.split_pattern(part.column("text"), " ") if pair.plain else pa.array([[t] for t in part.column("text").to_pylist()], pa.list_(pa.string()))
            coded = split.flatten().dictionary_encode()
            unsafe = pc.take(pa.array([not c or not safe(c[-1]) for c in coded.dictionary.to_pylist()], pa.bool_()), coded.indices)
            odd = pc.is_in(pa.array(range(part.num_rows), pa.int64()), pc.unique(pc.filter(pc.list_parent_indices(split), unsafe)).cast(pa.int64()))
            for chosen, again in ((pc.invert(odd), False), (odd, True)):
                rest, chunks = part.filter(chosen), split.filter(chosen)
                if rest.num_rows:
                    yield _rows(kept, rest, pa.array(map(chunks_of, chunks.to_pylist()), chunks.type) if again and pair.plain else chunks, not again)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = SLICE
                while n > 1 and batch.slice(at, n).column("text").nbytes > SLICE_BYTES:
                    n //= 2
                yield from made(batch.slice(at, n))
                at += n

    return run


def tokenise(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (of no meaning outside one run), doc_id, and by both tokenizers every token as its end in bytes * TOKEN + its id,
    with the mark of each end, which stands behind the tokens that end there."""
    rows = docs_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(_tokenise(a_path, b_path), TOKENS)


def _ids(group: Column, kind: str = "long") -> Column:
    return F.split(group, ",").cast(f"array<{kind}>")


def _product(group: Column) -> Column:
    """Every link of a group in words, a1,a2|b1,b2, as a number, a * PAIR + b, repeated as often as it occurs."""
    a, b = (F.substring_index(group, "|", k) for k in (1, -1))
    return F.flatten(F.transform(_ids(a), lambda a: F.transform(_ids(b), lambda b: a * PAIR + b)))


def groups_of(tokens: DataFrame, wide: int = WIDE) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the links of each document: as numbers in `links`
    (null for a group that has more than one, whose links follow), or as groups of ids in `wide` where there are more than so many.

    Spark interprets lambdas node by node, so that they are few and short, and works on plain numbers outside of them
    alone. A column that a lambda takes is used twice, as Spark would move it into the lambda's function else.
    """
    cut = tokens.withColumn("cuts", F.array_intersect("a_marks", "b_marks"))
    # marks between groups: none stands behind the last
    marks = F.slice("cuts", 1, F.greatest(F.size("cuts") - 1, F.lit(0)))
    marked = lambda x: F.sort_array(F.concat(f"{x}_tokens", marks)).alias(f"{x}_marked")
    size = lambda values, name: F.size(values).cast("long").alias(name)
    cut = cut.select("row", "doc_id", size("a_marks", "n_a"), size("b_marks", "n_b"), size("cuts", "n_groups"), marked("a"), marked("b"))
    said = lambda x: F.concat_ws(",", F.transform(f"{x}_marked", lambda v: v.bitwiseAND(MARK)).cast("array<string>"))
    parts = lambda x: F.when(F.size(f"{x}_marked") > 0, F.split(F.replace(said(x), F.lit(f",{MARK},"), F.lit(";")), ";")).alias(x)
    cut = cut.select("row", "doc_id", "n_a", "n_b", "n_groups", parts("a"), parts("b"))
    groups = F.zip_with("a", "b", lambda a, b: F.concat(a, F.lit("|"), b)).alias("groups")
    # a link of two sides of one id is a sum, and null stands for the other groups
    one = lambda x: ~F.contains(x, F.lit(","))
    single = F.zip_with("a", "b", lambda a, b: F.when(one(a) & one(b), a.cast("long") * PAIR + b.cast("long"))).alias("single")
    cut = cut.select("row", "doc_id", "n_a", "n_b", "n_groups", groups, single)
    # the most links that there can be: all other tokens in one group
    more = [F.col(n) - F.col("n_groups") for n in ("n_a", "n_b")]
    most = F.col("n_groups") + more[0] + more[1] + more[0] * more[1]
    size = lambda g, k: F.size(F.split(F.substring_index(g, "|", k), ",")).cast("long")
    counted = F.when(most > wide, F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + size(g, 1) * size(g, -1)))
    fans = F.filter("groups", lambda g: F.contains(g, F.lit(","))).alias("fans")
    cut = cut.select("*", F.when(F.col("n_a") > 0, F.sha2(F.concat_ws(";", "groups"), 256)).otherwise("").alias("groups_sha256"), counted.alias("counted"), fans)
    narrow = F.coalesce("counted", F.lit(0)) <= wide
    links = F.concat("single", F.flatten(F.transform("fans", _product)))
    side = lambda g, k, name: _ids(F.substring_index(g, "|", k), "int").alias(name)
    each = F.transform("groups", lambda g: F.struct(side(g, 1, "a"), side(g, -1, "b")))
    cut = cut.select("*", F.when(narrow, links).alias("links"), F.when(~narrow, each).alias("wide"))
    n_links = F.when(F.col("n_a") == 0, 0).otherwise(F.coalesce("counted", F.size("links") - F.size("fans"))).cast("long")
    return cut.select("row", "doc_id", "n_a", "n_b", "n_groups", n_links.alias("n_links"), "groups_sha256", "links", "wide")


def _link_rows(aligned: DataFrame, once: bool) -> DataFrame:
    """(row, pair) for every link, or every pair once a document."""
    narrow, wide = aligned.where(F.col("links").isNotNull()), aligned.where(F.col("wide").isNotNull())
    few = narrow.select("row", F.explode(F.array_distinct("links") if once else F.col("links")).alias("pair")).where(F.col("pair").isNotNull())
    many = wide.select("row", F.explode("wide").alias("g")).select("row", F.explode("g.a").alias("a"), F.col("g.b").alias("bs"))
    many = many.select("row", "a", F.explode("bs").alias("b")).select("row", (F.col("a").cast("long") * PAIR + F.col("b")).alias("pair"))
    return few.unionByName(many.distinct() if once else many)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs, best: whether no other pair of its first id is in more documents."""
    counts = _link_rows(aligned, once=True).groupBy("pair").agg(F.count("*").alias("n_docs"))
    highest = counts.groupBy(F.expr(f"pair div {PAIR}").alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {PAIR}")).join(highest, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("best"))


def least_hot(counts: DataFrame, hot: int = HOT) -> int:
    """The least count of which at most `hot` pairs have as much, among powers of two."""
    sizes = {int(r["e"]): r["n"] for r in counts.groupBy(F.floor(F.log2("n_docs")).alias("e")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for e in sorted(sizes, reverse=True):
        total += sizes[e]
        if total > hot:
            break
        least = e
    return 1 << min(least, 62)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row per row."""
    aligned = materialise(groups_of(tokenise(docs, a_path, b_path, id_col, text_col), wide))
    counts = materialise(pair_counts(aligned))
    least = least_hot(counts, hot)
    rows = _link_rows(aligned, once=False)
    common, rare = counts.where(F.col("n_docs") >= least), counts.where(F.col("n_docs") < least)
    sums = [F.sum("best").alias("n_best"), F.sum("n_docs").alias("count_sum")]
    found = rows.join(F.broadcast(common), "pair").groupBy("row").agg(*sums)
    if not rare.isEmpty():
        left = rows.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*sums)
        found = found.unionByName(left).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"]
    return aligned.drop("links", "wide").join(found, "row", "left").select(*columns)
