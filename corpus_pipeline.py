"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Quality classifier (rejected documents go), exact dedup, near duplicates (one document of
each group stays), mixing sources to target weights, and BPE encoding and decoding. All
but the last return the columns of documents; the last one a row for each encoded row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlane.llm import bpe, exact_dedup, mixing, ngram_join, quality_classifier
from arborlane.llm.common import release, shared_dir, shrink_heaps, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.query(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rested(stage: Stage) -> Stage:
    """The stage, begun with what earlier ones held given back, also by executors."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", rested(quality)),
    ("exact_dedup", rested(exact)),
    ("ngram_join", rested(near)),
    ("mixing", rested(mix)),
    ("bpe", rested(encode)),
]

#: Near duplicates, nearest neighbours and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What stages hand over is written to the
    shared folder for checkpoints, under a name of this run, and goes once the next stage
    is written; the last stage's rows stay, as the result reads them."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if done:
            folder = spark._jvm.org.apache.hadoop.fs.Path(done)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        done = path
    return docs
