"""Session settings the engine expects: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def ship(module_name: str) -> None:
    """Pickle a module's functions and classes by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def session(name: str = "evidentia", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **more}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of its own only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt_"))
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's place below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it from there, column by column."""
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
