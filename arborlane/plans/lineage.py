"""Checkpoints for iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own, else, in local mode, one set here."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", "")
        if not given:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            given = tempfile.mkdtemp(prefix="arborlane-")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, without its lineage. In columns, which take a fraction
    of the room and time of a checkpoint's serialized rows; what was shuffled for it goes."""
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)
