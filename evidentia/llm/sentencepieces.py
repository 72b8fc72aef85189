"""SentencePiece encoding and decoding that keeps the place of every piece in the source.

The model file is read as data (pieces, scores, normaliser). A text is normalised by taking, at each
place, the longest prefix that the compiled character map knows; each output byte remembers the source
bytes it came from. Byte-pair merges then run on the normalised text, and every piece is projected back
to the span of source bytes it covers. Texts are spread over tasks by Spark; a task works unit by unit (a
run of letters, or of other characters, with the spaces before it) with a bounded memo, which is exact
because no piece of the vocabulary spans such a border; where one does, units are words or whole texts.
Units that are new to a slice of texts are merged together, a merge of each at a time, and the ids and spans of all
texts of the slice are laid out at once.

Defined results: a null text encodes as an empty one; an empty text is the begin and end id alone;
repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain
from operator import concat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import docs_of, ship

ship(__name__)

SPACE = "▁"
MEMO_ENTRIES = 300_000
SLICE = 500
SLICE_CHARS = 1 << 22
LONG = 64
WIDTHS = (8, 16, 32, LONG)
NONE = np.iinfo(np.int32).max
NEVER = float("inf")
LETTER = re.compile(r"[^\W\d_]")
BY_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
WHOLE = re.compile(r"(?s).+")


class CharMap:
    """Longest-prefix normalisation by a compiled character map, with the source length of each step."""

    def __init__(self, rules: dict[bytes, bytes]):
        self.rules = rules
        self.longest = max(map(len, rules), default=0)
        self.starts = frozenset(k[0] for k in rules)

    @classmethod
    def compiled(cls, blob: bytes) -> CharMap:
        """Read every key of the double-array trie and the zero-ended string its value points to."""
        if not blob:
            return cls({})
        (n,) = struct.unpack_from("<I", blob)
        units, strings = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :]
        base = lambda u: (u >> 10) << ((u & 512) >> 6)
        children: dict[int, list[int]] = {}
        for p, u in enumerate(units):
            if 0 < u & 0x800000FF < 256:
                children.setdefault(p ^ (u & 255), []).append(p)
        rules, todo = {}, [(base(units[0]), b"")]
        while todo:
            at, key = todo.pop()
            for p in children.get(at, ()):
                here, q = key + bytes([at ^ p]), p ^ base(units[p])
                if units[p] & 256:
                    v = units[q] & 0x7FFFFFFF
                    rules[here] = strings[v : strings.index(b"\0", v)]
                todo.append((q, here))
        return cls(rules)

    def steps(self, raw: bytes) -> Iterator[tuple[bytes, int]]:
        """(output, bytes of source used) from left to right; what no rule covers passes a character at a time."""
        i, n = 0, len(raw)
        while i < n:
            if raw[i] in self.starts:
                for size in range(min(self.longest, n - i), 0, -1):
                    if (out := self.rules.get(raw[i : i + size])) is not None:
                        yield out, size
                        i += size
                        break
                else:
                    size = 0
                if size:
                    continue
            c = raw[i]
            size = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            yield raw[i : i + size], size
            i += size


class Pairs:
    """What two neighbours merge to, for pieces that are numbers."""

    def __init__(self, known: dict[str, tuple[int, int]], costs: dict[str, float], n_pieces: int):
        self.base = n_pieces + 1
        rank = {c: i for i, c in enumerate(sorted(set(costs.values())))}
        made = {}
        for piece, (i, _) in known.items():
            for k in range(1, len(piece)):
                if (a := known.get(piece[:k])) and (b := known.get(piece[k:])):
                    made[a[0] * self.base + b[0]] = (rank[costs[piece]], i)
        keys = sorted(made)
        # a last key that no pair has, for what is sought behind all others
        self.keys = np.array([*keys, np.iinfo(np.int64).max], dtype=np.int64)
        self.ranks = np.array([*(made[k][0] for k in keys), NONE], dtype=np.int32)
        self.made = np.array([*(made[k][1] for k in keys), -1], dtype=np.int32)
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        self.sizes, self.moves = np.zeros(n_pieces, dtype=np.int32), np.zeros(n_pieces, dtype=np.int32)
        for piece, (i, size) in known.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
            self.sizes[i], self.moves[i] = size, size - 2 * piece.count(SPACE)

    def of(self, a, b):
        """Rank of the merge of each a with its b, NONE without one, and the piece it makes."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge(self, sym):
        """Merge the pair of best rank, leftmost first, in every row of pieces (-1 behind its end) until none has one; the pieces, and which are left."""
        n, width = sym.shape
        sym = np.concatenate([sym, np.full((n, 1), -1, dtype=sym.dtype)], axis=1)
        left = sym[:, :-1] >= 0
        rank, made = self.of(sym[:, :-1], sym[:, 1:])
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)
        while True:
            best = rank[rows]
            i = best.argmin(axis=1)
            go = best[np.arange(len(rows)), i] < NONE
            rows, i = rows[go], i[go]
            if not len(rows):
                return sym[:, :-1], left
            j = after[rows, i]
            k = after[rows, j]
            both = made[rows, i]
            sym[rows, i], left[rows, j], rank[rows, j] = both, False, NONE
            after[rows, i], before[rows, k] = k, i
            rank[rows, i], made[rows, i] = self.of(both, sym[rows, k])
            h = before[rows, i]
            some = h >= 0
            at, h = rows[some], h[some]
            rank[at, h], made[at, h] = self.of(sym[at, h], both[some])


class Units(dict):
    """A number for every unit met. For each unit where its tokens begin and how many they are, and its decoded bytes; for each
    token its id, its length in normalised bytes and in those of a source that has a space for a mark."""

    def __init__(self):
        super().__init__()
        self.begin = self.count = np.zeros(0, dtype=np.int64)
        self.decoded: list[bytes] = []
        self.tokens = np.zeros((3, 0), dtype=np.int32)
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        got = self[unit] = len(self)
        self.new.append(unit)
        return got

    def add(self, begin, count, decoded: list[bytes], tokens) -> None:
        self.begin = np.concatenate([self.begin, begin + self.tokens.shape[1]])
        self.count = np.concatenate([self.count, count])
        self.decoded += decoded
        self.tokens = np.concatenate([self.tokens, tokens], axis=1)
        self.new = []


class Model:
    """The pieces and the normaliser of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.charmap = CharMap.compiled(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.known, self.costs, self.byte_ids, self.surface = {}, {}, {}, {}
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                self.known[p.piece], self.costs[p.piece] = (i, len(p.piece.encode())), -p.score
                self.surface[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
        self.unk, self.bos, self.eos = proto.trainer_spec.unk_id, proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.surface[self.unk] = proto.trainer_spec.unk_surface.encode()
        pairs = {a + b for p in self.known for a, b in zip(p, p[1:], strict=False)}
        # units of text that no piece reaches across; word characters that some piece joins to others count as others
        inner = [x for x in pairs if x[0] != SPACE]
        by_word = not any(x[1] == SPACE for x in inner)
        glue = {c for x in inner if bool(LETTER.match(x[0])) != bool(LETTER.match(x[1])) for c in x if LETTER.match(c)}
        letter = re.compile(rf"[^\W\d_{re.escape(''.join(sorted(glue)))}]")
        by_class = by_word and not any(bool(letter.match(x[0])) != bool(letter.match(x[1])) for x in inner)
        other = rf"[^\w{SPACE}]|[\d_{re.escape(''.join(sorted(glue)))}]"
        by_letters = re.compile(f"{SPACE}*(?:{letter.pattern}+|(?:{other})+)|{SPACE}+")
        self.units = (by_letters if by_class else BY_WORD if by_word else WHOLE).findall
        self.pairs = Pairs(self.known, self.costs, len(proto.pieces))
        self.memo = Units()

    def merge(self, text: str) -> list[str]:
        """Merge the adjacent pair of best score, leftmost first, until no pair is a piece."""
        sym, cost = list(text), self.costs.get
        best = [cost(pair, NEVER) for pair in map(concat, sym, sym[1:])]
        if len(sym) > LONG:
            return self.merge_long(sym, best)
        while best and (least := min(best)) < NEVER:
            i = best.index(least)
            both = sym[i] + sym[i + 1]
            sym[i : i + 2] = (both,)
            del best[i]
            if i < len(best):
                best[i] = cost(both + sym[i + 1], NEVER)
            if i:
                best[i - 1] = cost(sym[i - 1] + both, NEVER)
        return sym

    def merge_long(self, sym: list, best: list[float]) -> list[str]:
        """The same with a heap and linked neighbours, for words without a border over thousands of letters."""
        n, cost = len(sym), self.costs.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(c, i, i + 1, sym[i] + sym[i + 1]) for i, c in enumerate(best) if c < NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if sym[i] is None or right[i] != j or sym[j] is None or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (c := cost(both + sym[k])) is not None:
                    heapq.heappush(heap, (c, i, k, both + sym[k]))
            if (h := left[i]) >= 0 and (c := cost(sym[h] + both)) is not None:
                heapq.heappush(heap, (c, h, i, sym[h] + both))
        return [x for x in sym if x is not None]

    def unit(self, text: str) -> tuple[list[tuple[int, int, int]], bytes]:
        """The tokens (as in Units) and decoded bytes of a unit."""
        out = []
        for piece in self.merge(text):
            raw = piece.encode()
            moved = len(raw) - 2 * piece.count(SPACE)
            if (got := self.known.get(piece)) is not None:
                out.append((got[0], got[1], moved))
            elif self.byte_ids:
                # a mark that has no piece ends with its last byte
                out += [(self.byte_ids[b], 1, 1) for b in raw[:-1]] + [(self.byte_ids[raw[-1]], 1, moved - len(raw) + 1)]
            else:
                out.append((self.unk, len(raw), moved))
        return out, b"".join([self.surface[i] for i, _, _ in out])

    def learn(self) -> None:
        """Encode the units that are new to the memo: those of known characters together, others and long ones by themselves."""
        new = self.memo.new
        if not new:
            return
        n = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        begin = np.cumsum(n) - n
        sym = self.pairs.chars[np.frombuffer("".join(new).encode("utf-32-le"), dtype=np.uint32)]
        plain = (n <= LONG) & (np.minimum.reduceat(sym, begin) >= 0)
        decoded = [u.replace(SPACE, " ").encode() for u in new]
        first, count, tokens, done = np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64), [], 0
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            rows = np.flatnonzero(plain & (n > low) & (n <= width))
            if len(rows):
                inside = np.arange(width) < n[rows, None]
                placed = np.full((len(rows), width), -1, dtype=np.int32)
                placed[inside] = sym[(begin[rows, None] + np.arange(width))[inside]]
                placed, left = self.pairs.merge(placed)
                ids = placed[left]
                count[rows] = left.sum(axis=1)
                first[rows] = done + np.cumsum(count[rows]) - count[rows]
                tokens.append(np.stack([ids, self.pairs.sizes[ids], self.pairs.moves[ids]]))
                done += len(ids)
        for i in np.flatnonzero(~plain).tolist():
            made, decoded[i] = self.unit(new[i])
            first[i], count[i] = done, len(made)
            tokens.append(np.array(made, dtype=np.int32).T)
            done += len(made)
        self.memo.add(first, count, decoded, np.concatenate(tokens, axis=1))

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text and, where the map changed anything but spaces, the source byte before each of its bytes.

        Without changes the places follow from the space marks alone and None stands for them.
        """
        if not text:
            return "", None
        if not self.charmap.rules and not self.squeeze and SPACE not in text:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        mark, out, places, at = SPACE.encode(), bytearray(), [], 0
        if self.prefix:
            out += mark
            places += [0] * 3
        spaced = self.squeeze
        for piece, used in self.charmap.steps(text.encode()):
            if self.squeeze and spaced and piece in (b" ", mark):
                at += used
                continue
            spaced = piece[-1:] == b" "
            piece = piece.replace(b" ", mark)
            out += piece
            places += [at] * len(piece)
            at += used
        while self.squeeze and out.endswith(mark) and len(out) > (3 if self.prefix else 0):
            at = places[-3]
            del out[-3:], places[-3:]
        if self.squeeze and self.prefix and len(out) == 3:
            return "", None
        return out.decode(), [*places, at]

    def encode(self, text: str) -> tuple[bytes, bytes, bytes]:
        """Packed ids with begin and end, packed (start, end) source byte spans of all ids, decoded UTF-8."""
        at, ids, spans, decoded = self.encode_all([text])
        return ids.tobytes(), spans.tobytes(), decoded[0]

    def encode_all(self, texts: list[str]):
        """Where each text's tokens begin, with the end of the last; ids with begin and end, (start, end) source byte spans of them, decoded UTF-8 of each text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = Units()
        norms = [self.normalise(t) for t in texts]
        units = [self.units(norm) for norm, _ in norms]
        bounds = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)
        numbers = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(units)), dtype=np.int64, count=int(bounds[-1]))
        self.learn()
        count = self.memo.count[numbers]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids, sizes, moves = self.memo.tokens[:, np.repeat(self.memo.begin[numbers] - upto[:-1], count) + np.arange(upto[-1])]
        begin = upto[bounds]
        lengths = np.diff(begin)
        of = np.repeat(np.arange(len(texts)), lengths)
        # each text has a row before and behind its tokens
        at = begin + 2 * np.arange(len(texts) + 1)
        place = np.arange(len(ids)) + 2 * of + 1
        out = np.empty(int(at[-1]), dtype="<u4")
        out[at[:-1]], out[at[1:] - 1], out[place] = self.bos, self.eos, ids
        # each space mark takes three bytes where the source has one, and the first none
        ends = np.cumsum(moves, dtype=np.int64)
        ends = np.maximum(ends - np.concatenate([[0], ends])[begin[:-1]][of] - (1 if self.prefix else 0), 0)
        for i, (_, places) in enumerate(norms):
            if places is not None:
                a, b = begin[i], begin[i + 1]
                ends[a:b] = np.asarray(places, dtype=np.int64)[np.cumsum(sizes[a:b], dtype=np.int64)]
        whole = [len(t.encode()) for t in texts]
        spans = np.zeros((len(out), 2), dtype="<u4")
        spans[place, 1] = ends
        spans[1:, 0] = spans[:-1, 1]
        spans[at[:-1]] = 0
        spans[at[1:] - 1] = np.array(whole, dtype=np.int64)[:, None]
        each, surface = numbers.tolist(), self.memo.decoded
        decoded = [b"".join(map(surface.__getitem__, each[a:b])) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        if self.prefix:
            decoded = [d[1:] if d[:1] == b" " else d for d in decoded]
        return at, out, spans, decoded


def _packed(at, values) -> pa.Array:
    """A binary for each text from the rows of values between its places."""
    offsets = (at * values.itemsize * (values.size // max(1, len(values)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """From and to of at most SLICE texts and, but for a single one, SLICE_CHARS characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and j < i + SLICE and (j == i or size + len(texts[j] or "") <= SLICE_CHARS):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _encode(model_path: str, text_col: str, keep_text: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                at, ids, spans, decoded = model.encode_all([t or "" for t in texts[a:b]])
                made = {
                    "ids_le": _packed(at, ids),
                    "spans_le": _packed(at, spans),
                    "decoded": pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string()),
                }
                kept = {n: part.column(n) for n in part.schema.names if n not in made and (keep_text or n != text_col)}
                yield pa.record_batch(list((kept | made).values()), names=list(kept | made))

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids_le, spans_le (both packed little-endian unsigned 32-bit integers) and decoded, one row per row."""
    rows = docs_of(docs, id_col, text_col)
    return rows.mapInArrow(_encode(model_path, "text", keep_text=False), "doc_id long, ids_le binary, spans_le binary, decoded string")


def encode_columns(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The rows with all their columns, and ids_le, spans_le and decoded, which replace columns of that name."""
    made = T.StructType().add("ids_le", "binary").add("spans_le", "binary").add("decoded", "string")
    schema = T.StructType([f for f in docs.schema.fields if f.name not in made.names] + made.fields)
    return docs.mapInArrow(_encode(model_path, text_col), schema)


def n_ids(ids_le: Column) -> Column:
    return (F.octet_length(ids_le) / 4).cast("long")


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of the contract, from the operator's packed ids and decoded texts."""
    return encoded.select(
        "doc_id",
        n_ids(F.col("ids_le")).alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.octet_length("spans_le") / 8).cast("long").alias("n_spans"),
    )
