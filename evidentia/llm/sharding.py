"""Shards of near equal bytes that keep linked documents together: balanced label propagation.

Links join documents of one group (equal texts). Each document starts on the shard that a hash of its id
names. A round counts, by joins, how many bytes of each group stand on each shard; a document that is not
where most of its group stands, among the shards with room, asks to move there, and each shard admits as
many bytes as its quota leaves, in the order of a hash. When hardly anything moves, a last step evens out
the shards: those above the mean give documents, linked ones last, to those below.

Everything that decides is a histogram: bytes by shard and bin of the hash order, whose size depends on the
number of shards and bins only. It is those that come to the driver, never documents. A group larger than a
shard's quota fills one shard after the other. Places within a shard are counted in two steps, by bin and
within the bin, so that no task numbers a whole shard.

Defined results: a null text has the size of an empty one, the checksum of an empty one and no link, as an
empty text; repeated rows are documents of their own; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import checkpoint, materialise

SHARDS = 40
BINS = 512
ROUNDS = 4
SLACK = 0.02
OVERHEAD = 16


def documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """row, doc_id, size, text_crc32, link (null: none), order (0 to 1 by hash) and the first shard."""
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.when(F.octet_length(raw) > 0, F.substring(F.sha2(raw, 256), 1, 32)).alias("link"),
    )
    h = F.xxhash64(F.lit("shard"), "doc_id", "row")
    return rows.withColumns({"shard": F.pmod(h, F.lit(shards)).cast("int"), "bin": F.pmod(F.shiftright(h, 20), F.lit(BINS)).cast("int")})


def _loads(df: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards)
    for r in df.groupBy("shard").agg(F.sum("size").alias("b")).collect():  # a row for each shard
        out[r.shard] = r.b
    return out


def cut_bytes(groups: DataFrame) -> int:
    """Bytes of linked documents that stand off the shard where most of their group stands."""
    by = groups.groupBy("link", "shard").agg(F.sum("size").alias("b")).groupBy("link").agg((F.sum("b") - F.max("b")).alias("off"))
    return by.agg(F.coalesce(F.sum("off"), F.lit(0)).alias("n")).first().n


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """The rows of linked documents with the shard that rounds of label propagation under quotas give them."""
    # documents without links can still leave a shard, so that only linked bytes use up its quota
    quota = _loads(rows, shards).sum() / shards * (1 - slack)
    sizes = rows.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link")
    linked = materialise(rows.join(materialise(sizes), "link").select(rows.columns))
    for _ in range(rounds):
        loads = _loads(linked, shards)
        room = np.maximum(quota - loads, 0)
        open_to = [int(i) for i in np.flatnonzero(room > quota * slack / 8)]
        # where a group's bytes stand; a shard without room counts only for those already there
        stand = linked.groupBy("link", "shard").agg(F.sum("size").alias("b"))
        free = F.col("shard").isin(open_to) if open_to else F.lit(False)
        aim = materialise(stand.groupBy("link").agg(F.max_by(F.when(free, F.col("shard")), F.struct(F.when(free, F.col("b")), F.xxhash64("link", "shard"))).alias("aim"), F.max(F.when(~free, F.col("b"))).alias("held"), F.max(F.when(free, F.col("b"))).alias("best")))
        asks = linked.join(aim, "link")
        asks = asks.withColumn("asks", F.col("aim").isNotNull() & (F.col("aim") != F.col("shard")) & (free | F.col("held").isNull() | (F.col("best") >= F.col("held"))))
        asks = materialise(asks.select(*linked.columns, "aim", "asks"))
        wanted = np.zeros((shards, BINS))
        for r in asks.where("asks").groupBy("aim", "bin").agg(F.sum("size").alias("b")).collect():  # shards times bins
            wanted[r.aim, r.bin] = r.b
        admitted = (np.cumsum(wanted, axis=1) <= room[:, None]).sum(axis=1)  # bins that fit as a whole
        if not sum(wanted[i, :a].sum() for i, a in enumerate(admitted)):
            break
        limit = F.element_at(F.array(*[F.lit(int(a)) for a in admitted]), F.col("aim") + 1)
        moved = F.when(F.col("asks") & (F.col("bin") < limit), F.col("aim")).otherwise(F.col("shard"))
        linked = materialise(asks.withColumn("shard", moved).select(linked.columns))
    return linked


def even_out(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Move documents of shards above the mean to those below it; those with few links go first.

    `placed` has `tie`, 0 for a document without links and 1 for one with. Each shard above the mean gives
    whole bins, in the order of tie and bin, while they fit its surplus; what the last bin still lacks or
    exceeds is below a five-hundredth of a shard.
    """
    cells = np.zeros((shards, 2 * BINS))
    for r in placed.groupBy("shard", "tie", "bin").agg(F.sum("size").alias("b")).collect():  # shards times bins
        cells[r.shard, r.tie * BINS + r.bin] = r.b
    loads = cells.sum(axis=1)
    mean = loads.sum() / shards
    lack = np.maximum(mean - loads, 0)
    target = np.full((shards, 2 * BINS), -1)
    for s in np.argsort(-loads):
        surplus = loads[s] - mean
        for c in np.flatnonzero(cells[s]):
            if surplus <= 0:
                break
            to = int(np.argmax(lack))
            b = cells[s, c]
            if b <= surplus + lack[to] and b / 2 <= surplus and b / 2 <= lack[to]:
                target[s, c] = to
                lack[to] = max(0, lack[to] - b)
                surplus -= b
    pairs = [(int(s), int(c), int(target[s, c])) for s, c in zip(*np.nonzero(target >= 0), strict=True)]
    moves = F.create_map(*[F.lit(x) for s, c, to in pairs for x in (s * 2 * BINS + c, to)]) if pairs else F.create_map().cast("map<int,int>")
    cell = F.col("shard") * (2 * BINS) + F.col("tie") * BINS + F.col("bin")
    return placed.withColumn("shard", F.coalesce(moves[cell], F.col("shard")).cast("int"))


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: rows before the bin, and the place within it."""
    counts = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")
    starts = checkpoint(counts.select("shard", "bin", before.alias("start")))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "row")) - 1
    return placed.withColumn("place", place).join(starts, ["shard", "bin"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long")).drop("place", "start")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), link; one row per row."""
    rows = materialise(documents(docs, shards))
    linked = propagate(rows, shards, rounds).select(*rows.columns, F.lit(1).alias("tie"))
    single = rows.join(linked.select("row"), "row", "left_anti").withColumn("tie", F.lit(0))
    placed = materialise(single.unionByName(linked))
    final = with_slots(materialise(even_out(placed, shards)))
    return final.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "link")
