"""Digests of ordered values in bounded memory, and JSON in a canonical form."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import materialise, ship

ship(__name__)

#: parts whose text is joined at once
CHUNK = 512


def _chunks(n_keys: int, sep: str):
    """From rows in order to (keys, place, text, parts): the text of some parts of one key, joined, in order of place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            names, types = batch.schema.names[:n_keys], batch.schema.types[:n_keys]
            *columns, parts = (c.to_pylist() for c in batch.columns)
            made = []
            for at in range(0, len(parts), CHUNK):
                some = slice(at, at + CHUNK)
                keyed = zip(*[c[some] for c in columns], strict=True) if n_keys else repeat(())
                for key, rows in groupby(zip(keyed, parts[some], strict=False), key=itemgetter(0)):
                    kept = [p for _, p in rows if p is not None]
                    made.append((*key, place, sep.join(kept).encode(), len(kept)))
                    place += 1
            fields = zip([*names, "place", "text", "parts"], [*types, pa.int64(), pa.binary(), pa.int64()], strict=True)
            yield pa.record_batch({name: pa.array([row[i] for row in made], t) for i, (name, t) in enumerate(fields)})

    return run


def _running(n_keys: int, sep: bytes):
    """Digest the chunks of keys that come in order, key after key; what is held is one digest and one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, count = None, None, 0

        def done() -> pa.RecordBatch:
            columns = [pa.array([k], t) for k, t in zip(key, types, strict=True)]
            return pa.record_batch([*columns, pa.array([state.hexdigest()]), pa.array([count], pa.int64())], names=[*names, "digest", "parts"])

        for batch in batches:
            names, types = batch.schema.names[:n_keys], batch.schema.types[:n_keys]
            columns = [c.to_pylist() for c in batch.columns[:n_keys]]
            for i, (text, parts) in enumerate(zip(batch.column("text"), batch.column("parts").to_pylist(), strict=True)):
                if (own := tuple(c[i] for c in columns)) != key:
                    if state is not None:
                        yield done()
                    key, state, count = own, hashlib.sha256(), 0
                if count and parts:
                    state.update(sep)
                state.update(text.as_buffer())
                count += parts
        if state is not None:
            yield done()

    return run


def ordered_digest(df: DataFrame, keys: list[str], order: list[str], part: Column, sep: str = "|") -> DataFrame:
    """keys, digest (SHA-256 of the parts' text in order, joined by sep), parts: their number; null parts are left out.

    Tasks sort ranges of keys and order, and join the text of some hundreds of parts each. The digest of a key is one
    chain, which one task computes over these chunks: it reads the parts' text and no more, and sorts only chunks.
    """
    rows = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], part.cast("string").alias("_part"))
    by = [*keys, *[f"_o{i}" for i in range(len(order))], "_part"]
    held = [df.schema[k] for k in keys]
    fields = T.StructType([*held, T.StructField("place", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("parts", T.LongType())])
    chunks = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, "_part").mapInArrow(_chunks(len(keys), sep), fields))
    dealt = chunks.repartition(*keys) if keys else chunks.repartition(1)
    schema = T.StructType([*held, T.StructField("digest", T.StringType()), T.StructField("parts", T.LongType())])
    return dealt.sortWithinPartitions(*keys, "place").mapInArrow(_running(len(keys), sep.encode()), schema)


@F.pandas_udf(T.StringType())
def canonical_json_text(payload: pd.Series) -> pd.Series:
    """A JSON document with the keys of every object in order, no spaces and its characters as they are; null if it is none.

    Of a repeated key the last value counts; NaN and infinities are no JSON.
    """

    def refuse(word: str):
        raise ValueError(word)

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        except (ValueError, TypeError, RecursionError):
            return None

    return payload.map(one)


def content_hash(payload: Column) -> Column:
    """SHA-256 of the canonical form, so that the order of keys and spaces make no new content."""
    return F.sha2(canonical_json_text(payload).cast("binary"), 256)
