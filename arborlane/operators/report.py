"""Reports over build results: aggregation with a map-side part, and bounded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAN = ("executed", "flaky")
GOOD = ("executed", "flaky", "cached", "wouldrun", "mayrun")


def _n(*outcomes: str):
    return F.count_if(F.col("outcome").isin(*outcomes))


def outcome_counts(results: DataFrame, by: str) -> DataFrame:
    """Counts of outcomes, success and busy time. Flaky counts as executed."""
    return results.groupBy(by).agg(
        _n(*RAN).alias("executed"), _n("cached").alias("cached"), _n("failed").alias("failed"), _n("skipped").alias("skipped"),
        F.bool_and(F.col("outcome").isin(*GOOD)).alias("success"),
        F.coalesce(F.sum(F.when(F.col("outcome").isin(*RAN), F.col("duration"))), F.lit(0)).cast("long").alias("busy"))


def tally(results: DataFrame, by: str) -> DataFrame:
    """Counts for each kind and the share of cache hits; null where nothing could hit."""
    x = results.groupBy(by).agg(
        _n("executed").alias("ran"), _n("flaky").alias("flaky"), _n("cached").alias("cached"), _n("failed").alias("failed"),
        _n("skipped").alias("skipped"), F.sum("duration").alias("ms"))
    return x.withColumn("hit_rate", F.round(F.try_divide(100.0 * F.col("cached"), F.expr("ran + flaky + cached + failed")), 4))


def first_examples(rows: DataFrame, head: str, detail: str, pos: str, k: int) -> DataFrame:
    """Rows of each head, and its first k non-empty details in order of pos. Ranks are
    filtered right away, which Spark does before the exchange (a limit for each group)."""
    w = W.partitionBy(head).orderBy(pos)
    top = rows.filter(F.col(detail) != "").withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k)
    some = top.groupBy(head).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", detail))), lambda x: x[detail]), ",").alias("examples"))
    return rows.groupBy(head).agg(F.count("*").alias("n")).join(some, head)


def tail(rows: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The last n lines of a text, and how many come before."""
    lines = F.split(text, "\n")
    size = F.size(lines)
    return rows.select(key, F.array_join(F.slice(lines, F.greatest(F.lit(1), size - (n - 1)), F.lit(n)), "\n").alias("tail"), F.greatest(F.lit(0), size - n).cast("long").alias("hidden"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place n div 2 (from 0) of each group, by counts of distinct values, so
    that a group is never one list."""
    c = rows.groupBy(by, value).agg(F.count("*").alias("__c"))
    w = W.partitionBy(by)
    c = c.withColumns({"__upto": F.sum("__c").over(w.orderBy(value)), "n": F.sum("__c").over(w)})
    return c.groupBy(by, "n").agg(
        F.min(F.when(F.col("__upto") > F.floor(F.col("n") / 2), F.col(value))).alias("median"), F.min(value).alias("low"), F.max(value).alias("high")
    ).select(by, "median", "low", "high", "n")


def lcov(counts: DataFrame) -> DataFrame:
    """A coverage record for each file from (file, line, count) of many reports."""
    line = counts.groupBy("file", "line").agg(F.sum("count").alias("hits"))
    one = F.struct("line", F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(","), F.col("hits").cast("string")).alias("t"))
    x = line.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(one)), lambda a: a["t"]).alias("d"), F.count("*").alias("lf"), F.count_if(F.col("hits") > 0).alias("lh"))
    return x.select(F.concat_ws("\n", F.concat(F.lit("SF:"), "file"), F.array_join("d", "\n"), F.concat(F.lit("LF:"), F.col("lf").cast("string")), F.concat(F.lit("LH:"), F.col("lh").cast("string")), F.lit("end_of_record")).alias("record"))


def headline(results: DataFrame, by: str) -> DataFrame:
    x = results.groupBy(by).agg(_n("failed").alias("f"), _n(*RAN).alias("b"), _n("skipped").alias("s"), _n("cached").alias("c"))
    term = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}")))
    return x.select(by, F.concat_ws(", ", term("f", "failed"), term("b", "built"), term("s", "skipped"), term("c", "cached")).alias("line"))


def first_and_more(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The first k distinct values of each group in order, and how many more there are."""
    d = rows.select(by, value).distinct()
    n = d.groupBy(by).agg(F.count("*").alias("__n"))
    top = d.withColumn("__k", F.row_number().over(W.partitionBy(by).orderBy(value))).filter(F.col("__k") <= k)
    some = top.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("__s"))
    more = F.when(F.col("__n") > k, F.concat(F.lit(" and "), (F.col("__n") - k).cast("string"), F.lit(" more"))).otherwise("")
    return n.join(some, by).select(by, F.concat("__s", more).alias("line"))
