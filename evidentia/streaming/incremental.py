"""Incremental forms: deduplicated ingestion, windowed counts, alert states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.streaming.keyed import keyed_store


def read_stream(spark, path: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A Parquet folder as a stream; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedup_stream(items: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """First item of each key; state older than the watermark goes."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, key: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum by key and window, complete once the watermark has passed."""
    agg = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))
    return agg.select(F.col("w.start").alias("start"), key, "n", "cents")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take all that is there in bounded batches, write it to Parquet, and stop; a rerun takes only what is new."""
    with keyed_store(df.sparkSession):
        query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
