"""Append-only logs: the last entry of an id wins; entries after a torn one don't count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(entries: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last entry of each id: an aggregation with a map-side part, no window."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(key, "__last.*")


def valid_prefix(entries: DataFrame, log: str, order: str, valid: str) -> DataFrame:
    """Entries of each log before its first one that is not valid."""
    torn = entries.filter(~F.col(valid)).groupBy(log).agg(F.min(order).alias("__torn"))
    return entries.join(torn, log, "left").filter(F.col("__torn").isNull() | (F.col(order) < F.col("__torn"))).drop("__torn")


def last_values(entries: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """The last n values of each id, oldest first."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    top = entries.select(key, order, value).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def estimates(entries: DataFrame, key: str, kind: str, order: str, value: str, recent: int = 8, pool: int = 4) -> DataFrame:
    """The mean of an id's last ``recent`` values, and that of its kind, of the last
    ``pool`` values of each id."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    top = entries.select(key, kind, order, value).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= recent)
    own = top.groupBy(key, kind).agg(F.avg(value).alias("mean"), F.max_by(value, order).alias("last"))
    of_kind = top.filter(F.col("__k") <= pool).groupBy(kind).agg(F.avg(value).alias("kind_mean"))
    return own.join(F.broadcast(of_kind), kind)  # a handful of kinds
