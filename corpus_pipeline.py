"""The corpus pipeline: from documents to pieces, in five stages of the training-data operators.

1. quality: documents that the classifier rejects go.
2. near_dedup: one document of each near-duplicate group stays, that of least id.
3. substring_dedup: words inside repeated runs of 35 words go from the texts; a document that loses nothing
   keeps its text as it is, one that loses all its words stays with an empty text.
4. decontaminate: documents that hold a benchmark segment go.
5. sentencepiece: the texts that remain, as packed ids and byte spans, beside the columns of documents.

Every stage but the last returns the columns of its input, whatever their names; the last one adds its own and
takes the place of columns that are called like them. Each stage's result is written to the shared folder as
Parquet and read again as the next one's documents.

Defined results: a null text is scored by the classifier's intercept, is no copy of anything, loses nothing,
holds no benchmark and has the pieces of an empty text; null and repeated ids are kept, as each row is judged
by its own text, but of rows that repeat both id and text one stays; of copies the least id stays, a null id
last; very long texts go through whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, near_dedup, quality, sentencepieces, substring_dedup
from evidentia.llm.common import materialise, table
from evidentia.llm.queries import piece_model_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_columns(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_columns(docs, piece_model_path()).withColumn("n_tokens", sentencepieces.n_ids(F.col("ids_le")))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode),
]

#: SQL can't express these stages; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
