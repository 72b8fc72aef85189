"""Exact search for the vectors of highest inner product, a block of vectors at a time.

Vectors become whole numbers. They are ordered by their strongest components, so that a range of them points alike,
and a block is such a range: its forward index (the vectors), and the highest and lowest value of each component. A
query's bound for a block is the sum over its components of what the block's extremes allow at most, as in
block-max pruning with a component's positive and negative side as two terms. Blocks of one range lie together in a
shelf, the unit that is shuffled, and queries in chunks.

Every chunk meets the extremes of every shelf, in lanes, and keeps each query's best block and bound there. The
blocks of highest bound over all shelves are scored first and give each query a least last score; a shelf is then sent
only to chunks with a query whose bound there reaches it. Within a shelf a query's blocks are scored in the order of
their bounds, in rounds that double, until the bounds of the rest are strictly below its last score.

Defined results: vectors that are null, hold a null or a non-finite component, or overflow when scaled take no part,
as query or as candidate; an id stands for its rows, so no row of a query's id is its candidate, and an id that
repeats is searched for every row that has it; null ids are candidates, last among ties; vectors of unlike length
count as filled up with zeros; scores beyond a long are held to its range; fewer than k candidates give fewer rows;
equal scores go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import materialise, ship

ship(__name__)

SCALE = 256
K = 5
EVERY = 50
BLOCK = 16
SHELF = 4096
CHUNK = 256
#: strongest components that order the vectors, and blocks of highest bound that give a query its first last score
STRONGEST = 3
LEADS = 4
SHELVES_A_LANE = 8
LARGEST = (1 << 63) - 1
EXACT = float(1 << 53)


def scaled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector (array of doubles that are whole numbers), without the vectors that take no part."""
    x = F.col(vector_col).cast("array<double>")
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: c * SCALE).alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return whole.where(F.col("vector").isNotNull() & ~bad)


def strongest(vector: Column, n: int = STRONGEST) -> Column:
    """The components of largest size, each as its place and sign, strongest first."""
    sides = F.transform(vector, lambda c, i: F.struct((-F.abs(c)).alias("size"), F.when(c < 0, -1 - i).otherwise(i).alias("side")))
    return F.transform(F.slice(F.array_sort(sides), 1, n), lambda s: s["side"])


def _numbers(column: pa.ChunkedArray):
    """A matrix of whole numbers, rows filled up with zeros."""
    import numpy as np

    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    out = np.zeros((len(lists), size.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy()
    return np.floor(out)


def _packed(matrix) -> bytes:
    return matrix.astype("<f8").tobytes()


def _matrix(raw: bytes, width: int):
    import numpy as np

    return np.frombuffer(raw, "<f8").reshape(-1, width) if width else np.zeros((0, 0))


def _ids(column: pa.Array) -> tuple[bytes, bytes]:
    """Ids as packed longs, and a byte for each that says whether it is null."""
    import numpy as np

    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy().astype("<i8").tobytes(), null.astype(np.uint8).tobytes()


BUNDLE = "bundle long, width int, n int, ids binary, nulls binary, vectors binary"
BUNDLE_SCHEMA = pa.schema([("bundle", pa.int64()), ("width", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("vectors", pa.binary())])


def _bundles(size: int, extremes: bool):
    """Consecutive rows of a task, bundled; with extremes, also those of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        number, rest = TaskContext.get().partitionId() << 32, None

        def made(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            m = _numbers(part.column("vector"))
            ids, nulls = _ids(part.column("id").combine_chunks())
            number += 1
            row, schema = {"bundle": [number], "width": [m.shape[1]], "n": [len(m)], "ids": [ids], "nulls": [nulls], "vectors": [_packed(m)]}, BUNDLE_SCHEMA
            if extremes:
                at = np.arange(0, len(m), BLOCK)
                row |= {"high": [_packed(np.maximum.reduceat(m, at))], "low": [_packed(np.minimum.reduceat(m, at))]}
                schema = schema.append(pa.field("high", pa.binary())).append(pa.field("low", pa.binary()))
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            while rest.num_rows >= size:
                yield made(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and rest.num_rows:
            yield made(rest)

    return run


def shelves_of(vectors: DataFrame, size: int = SHELF) -> DataFrame:
    """The index: one row a shelf with its vectors and the extremes of its blocks."""
    ordered = vectors.withColumn("strongest", strongest(F.col("vector")))
    keys = [F.get("strongest", i) for i in range(STRONGEST)]
    ranged = ordered.repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "id").select("id", "vector")
    return ranged.mapInArrow(_bundles(size, True), f"{BUNDLE}, high binary, low binary").withColumnRenamed("bundle", "shelf")


def chunks_of(queries: DataFrame, size: int = CHUNK) -> DataFrame:
    return queries.select("id", "vector").mapInArrow(_bundles(size, False), BUNDLE).withColumnRenamed("bundle", "chunk")


def _fit(m, width: int):
    """A matrix with more columns of zeros, or fewer columns: what is cut off would meet zeros alone."""
    import numpy as np

    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _exact(q, *others):
    """Doubles where all sums of products are exact in them, or else Python's whole numbers."""
    import numpy as np

    top = lambda m: float(np.abs(m).max()) if m.size else 0.0
    if max(q.shape[1], 1) * top(q) * max(map(top, others)) < EXACT:
        return q, *others
    return tuple(np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, *others))


def bounds(q, high, low):
    """Queries by blocks: the most that an inner product with a vector of the block can be."""
    import numpy as np

    q, high, low = _exact(q, high, low)
    return _held(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)


def _held(scores):
    """Scores within the range of a long; only whole numbers of Python can be beyond it."""
    import numpy as np

    return np.minimum(np.maximum(scores, -LARGEST - 1), LARGEST) if scores.dtype == object else scores


def _best_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of a chunk and a shelf, every query's best bound there and the block that has it."""
    for batch in batches:
        for r in batch.to_pylist():
            b = bounds(_fit(_matrix(r["q"], r["q_width"]), r["width"]), _matrix(r["high"], r["width"]), _matrix(r["low"], r["width"]))
            at = b.argmax(axis=1)
            best = [float(x) for x in b[range(len(at)), at]]
            # a bound that a double can't hold is raised, never lowered
            best = [x if abs(x) < EXACT else x + abs(x) * 1e-12 for x in best]
            yield pa.record_batch([pa.array([r["chunk"]]), pa.array([r["shelf"]]), pa.array([best], pa.list_(pa.float64())), pa.array([at.tolist()], pa.list_(pa.int32()))], names=["chunk", "shelf", "bound", "block"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shelves' blocks as rows."""
    for batch in batches:
        for r in batch.to_pylist():
            starts, step = range(0, r["n"], BLOCK), 8 * r["width"]
            cut = lambda raw, size: [raw[s * size : (s + BLOCK) * size] for s in starts]  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict({"shelf": [r["shelf"]] * len(starts), "block": list(range(len(starts))), "width": [r["width"]] * len(starts), "ids": cut(r["ids"], 8), "nulls": cut(r["nulls"], 1), "vectors": cut(r["vectors"], step)}, schema=BLOCK_SCHEMA)


BLOCK_SCHEMA = pa.schema([("shelf", pa.int64()), ("block", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("vectors", pa.binary())])
FOUND = "chunk long, at int, query_id long, vec_id long, score long"
FOUND_SCHEMA = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    """The k highest scores of every query in a shelf (or in single blocks), none strictly below its last score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def found(r: dict) -> dict:
            qs, v = _exact(_fit(_matrix(r["q"], r["q_width"]), r["width"]), _matrix(r["vectors"], r["width"]))
            q_ids, ids, null = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], np.uint8) > 0
            at = r["at"] or range(len(qs))
            last = np.array([-np.inf if x is None else x for x in r["last"]], dtype=qs.dtype)
            scores = np.full((len(qs), len(v)), -np.inf, dtype=qs.dtype)
            own = (q_ids[:, None] == ids[None, :]) & ~null[None, :]
            starts = np.arange(0, len(v), BLOCK)
            bound = bounds(qs, np.maximum.reduceat(v, starts), np.minimum.reduceat(v, starts))
            order = np.argsort(-bound, axis=1, kind="stable")
            done, step = 0, 1
            while done < len(starts):
                next_ = order[:, done : done + step]
                open_ = np.take_along_axis(bound, next_, axis=1) >= last[:, None]
                if not open_.any():
                    break
                rows = np.repeat(np.arange(len(qs)), open_.sum(axis=1))
                blocks = next_[open_]
                by = np.argsort(blocks, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(blocks[by])) + 1):
                    s, who = starts[blocks[part[0]]], rows[part]
                    scores[who, s : s + BLOCK] = _held(qs[who] @ v[s : s + BLOCK].T)
                scores[own] = -np.inf
                if scores.shape[1] >= k:
                    kth = np.partition(scores, -k, axis=1)[:, -k]
                    last = np.maximum(last, kth)
                done, step = done + step, step * 2
            out = {name: [] for name in FOUND_SCHEMA.names}
            for i, row in enumerate(scores):
                hits = np.flatnonzero((row >= last[i]) & (row > -np.inf))
                hits = hits[np.lexsort((ids[hits], null[hits]))]
                hits = sorted(hits, key=lambda j: -row[j])[:k]  # noqa: B023
                for j in hits:
                    out["chunk"].append(r["chunk"])
                    out["at"].append(at[i])
                    out["query_id"].append(int(q_ids[i]))
                    out["vec_id"].append(None if null[j] else int(ids[j]))
                    out["score"].append(int(row[j]))
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(found(batch.slice(i, 1).to_pylist()[0]), schema=FOUND_SCHEMA)

    return run


def _first(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("chunk", "at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shelf: int = SHELF, chunk: int = CHUNK, leads: int = LEADS) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of highest inner product with every query row, but those of its id."""
    index = materialise(shelves_of(scaled(rows, id_col, vector_col), shelf))
    chunks = materialise(chunks_of(scaled(queries, id_col, vector_col).where("id IS NOT NULL"), chunk))
    lanes = max(1, index.count() // SHELVES_A_LANE)
    asked = chunks.select("chunk", F.col("width").alias("q_width"), F.col("vectors").alias("q"))
    in_lanes = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    extremes = index.select("shelf", "width", "high", "low", F.pmod(F.xxhash64("shelf"), F.lit(lanes)).cast("int").alias("lane"))
    cells = materialise(in_lanes.join(extremes, "lane").drop("lane").mapInArrow(_best_blocks, "chunk long, shelf long, bound array<double>, block array<int>"))
    each = cells.select("chunk", "shelf", F.posexplode(F.arrays_zip("bound", "block")).alias("at", "b")).select("chunk", "at", "shelf", "b.*")
    lead = each.withColumn("place", F.row_number().over(Window.partitionBy("chunk", "at").orderBy(F.desc("bound"), "shelf"))).where(F.col("place") <= leads)
    q_side = chunks.select("chunk", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), "n")
    one = lambda c, size: F.expr(f"substring({c}, at * {size} + 1, {size})")
    leading = lead.join(q_side, "chunk").select("chunk", "shelf", "block", "q_width", one("q_ids", "8").alias("q_ids"), one("q", "(8 * q_width)").alias("q"), F.array("at").alias("at"), F.array(F.lit(None).cast("double")).alias("last"))
    blocks = index.select("shelf", "n", "width", "ids", "nulls", "vectors").mapInArrow(_blocks, "shelf long, block int, width int, ids binary, nulls binary, vectors binary")
    columns = ["chunk", "q_width", "q_ids", "q", "width", "ids", "nulls", "vectors", "at", "last"]
    seeds = leading.join(blocks, ["shelf", "block"]).select(*columns).mapInArrow(_search(k), FOUND)
    # a double that is not above the score, also where doubles can't hold it
    floor_ = F.when(F.abs(F.col("score").cast("double")) < EXACT, F.col("score").cast("double")).otherwise(F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-12)
    kth = _first(seeds, k).where(F.col("rank") == k).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("at", floor_))).alias("last"))
    limits = materialise(chunks.select("chunk", "n").join(kth, "chunk", "left").select("chunk", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("last", i)).alias("last")))
    open_ = F.exists(F.arrays_zip("bound", "last"), lambda z: z["last"].isNull() | (z["bound"] >= z["last"]))
    still = cells.join(limits, "chunk").where(open_).select("chunk", "shelf", "last", F.lit(None).cast("array<int>").alias("at"))
    still = still.join(q_side.drop("n"), "chunk").join(index.select("shelf", "width", "ids", "nulls", "vectors"), "shelf")
    found = _first(still.select(*columns).mapInArrow(_search(k), FOUND), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(rows: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The search with every row as a query whose id is divisible by `every`."""
    return search(rows, rows.where(F.col(id_col) % every == 0), k, id_col, vector_col)
