"""Writers: append-only logs with compaction, first-writer-wins stores, lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlane.operators.journal import fold


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def compacted(spark: SparkSession, path: str, into: str, key: str = "id", order: str = "seq") -> DataFrame:
    """The log at path with one entry for each id, written to another folder: a reader of
    the old one is never without it."""
    fold(spark.read.parquet(path), key, order).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)


def put_new(entries: DataFrame, path: str, key: str) -> int:
    """Adds entries whose key the store does not have; of equal ones the first."""
    spark = entries.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
    except Exception as e:  # the store is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = entries.select(key).limit(0)
    new = entries.dropDuplicates([key]).join(there, key, "left_anti").select(entries.columns)
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()


def json_lines(rows: DataFrame) -> DataFrame:
    """(line) of each row as one JSON object, nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def junit_xml(suites: DataFrame) -> DataFrame:
    """(line) for each suite of (suite, tests, failures, errors, skipped, ms)."""
    form = '<testsuite name="%s" tests="%d" failures="%d" errors="%d" skipped="%d" time="%s"/>'
    seconds = F.concat(F.floor(F.col("ms") / 1000).cast("string"), F.lit("."), F.lpad((F.col("ms") % 1000).cast("string"), 3, "0"))
    return suites.select(F.format_string(form, "suite", "tests", "failures", "errors", "skipped", seconds).alias("line"))


def dot(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('  "%s" -> "%s";', "src", "dst").alias("line"))
