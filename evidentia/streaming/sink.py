"""A sink that takes each micro-batch once and whole: rows, rejects and a summary become visible together.

A batch is written to a new folder; one small file, made last and only if it is not there yet, names that folder
and so commits it. Readers follow the commits. What a failed attempt left behind is never read, and a batch
that comes again after it was committed has no effect, so whatever part of a stream is replayed, each item counts once.
An item that can't be normalised is a reject with its reason and doesn't disturb the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.streaming.keyed import keyed_store

ROWS, REJECTS, SUMMARY = "rows", "rejects", "summary"


class Commits:
    """The committed batches of a table: one file a batch, which names the folder that holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self.at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, batch: int) -> bool:
        return self.fs.exists(self.at("commits", str(batch)))

    def commit(self, batch: int, folder: str) -> bool:
        """Make a batch visible; false if another attempt did so before. The file system makes a file only once."""
        name = self.at("commits", str(batch))
        staged = self.at("staged", uuid.uuid4().hex)
        out = self.fs.create(staged, False)
        out.write(bytearray(folder.encode()))
        out.close()
        self.fs.mkdirs(name.getParent())
        # a rename onto a name that exists is refused, and shows the file whole or not at all
        done = not self.fs.exists(name) and self.fs.rename(staged, name)
        self.fs.delete(staged, False)
        return bool(done)

    def folders(self) -> dict[int, str]:
        if not self.fs.exists(self.at("commits")):
            return {}
        named = self.spark.read.format("text").option("wholetext", True).load(f"{self.path}/commits").select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("int").alias("batch"), "value")
        return {r.batch: r.value for r in named.collect()}

    def read(self, part: str) -> DataFrame | None:
        """What the committed batches hold of a part, with their number; none before the first commit."""
        found = self.folders()
        if not found:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{folder}/{part}" for _, folder in sorted(found.items())])

    def sweep(self) -> int:
        """Delete what failed attempts left behind; only while no batch is being written."""
        kept = set(self.folders().values())
        base = self.at("data")
        stray = [s.getPath() for s in self.fs.listStatus(base) if s.getPath().getName() not in kept] if self.fs.exists(base) else []
        for path in stray:
            self.fs.delete(path, True)
        return len(stray)


def summary_of(done: DataFrame, batch: int) -> DataFrame:
    """One row: items, succeeded, failed, and the status that follows from them."""
    sums = done.agg(F.count(F.lit(1)).alias("input_count"), F.count_if(F.col("error_class").isNull()).alias("success_count"), F.count_if(F.col("error_class").isNotNull()).alias("error_count"))
    status = F.when(F.col("error_count") == 0, "succeeded").when(F.col("success_count") > 0, "partial").otherwise("failed_permanent")
    return sums.select(F.lit(batch).cast("long").alias("batch_id"), "*", status.alias("status"))


def write_batch(normalise: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: normalise adds `error_class`, null for what succeeded; the rest of its columns are the rows."""

    def write(items: DataFrame, batch: int) -> None:
        commits = Commits(items.sparkSession, path)
        if commits.has(batch):
            return
        folder = f"batch_{batch}-{uuid.uuid4().hex}"
        done = normalise(items).persist()
        try:
            whole = done.withColumn("batch_id", F.lit(batch).cast("long"))
            whole.where("error_class is null").drop("error_class").write.parquet(f"{path}/data/{folder}/{ROWS}")
            whole.where("error_class is not null").write.parquet(f"{path}/data/{folder}/{REJECTS}")
            summary_of(done, batch).write.parquet(f"{path}/data/{folder}/{SUMMARY}")
        finally:
            done.unpersist()
        commits.commit(batch, folder)

    return write


def run_batches(items: DataFrame, normalise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Take all that a stream has, batch by batch, into the table at a path, and stop."""
    with keyed_store(items.sparkSession):
        query = items.writeStream.foreachBatch(write_batch(normalise, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
