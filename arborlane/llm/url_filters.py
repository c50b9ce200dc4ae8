"""URL rules by a sort-merge range join.

The canonical key of a rule or of a url is its host with the labels reversed, then
the path: a rule of a host covers the interval of keys that start with its own. A url
is looked up once for each suffix of its host that some rule has, so that a rule of a
host also covers its subdomains. Urls and rules are dealt by ranges of keys, sorted,
and swept once with a stack of the rules that are open at a key; the top of the stack
is the longest match. A range starts with the rules that are open at its lower bound.

Rules are nested or apart, so the longest rule is the last one opened. Among rules of
equal length (host and path together) the longer host wins, then block.

Defined cases: a null url, or one without ``://``, has an empty host and path and
matches no rule; what matches no rule is allowed; equal urls are swept once and joined
back, so that a url with a third of all rows is one key; empty tables give empty
results.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.llm.common import BROADCAST_ROWS, checkpointed, join_hot, partitions

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

SAMPLE_KEYS = 50_000
END = "\x01"  # between host and path; sorts before any character of a host


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path. Empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return _lower(host), path


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _sweep(opened: list[list[tuple[str, int]]]):
    """Rows of a range in the order of keys, rules before urls; ranges one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = -1, []
        for x in batches:
            out: dict[str, list] = {"host": [], "path": [], "rule_no": [], "len": []}
            for r, key, rule, host, path in zip(*(x.column(k).to_pylist() for k in ("r", "key", "rule", "host", "path"))):
                if r != at:
                    at, stack = r, list(opened[r])
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule >= 0:
                    stack.append((key, rule))
                elif stack:
                    for k, v in zip(out, (host, path, stack[-1][1], len(stack[-1][0]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("host", pa.string()), ("path", pa.string()), ("rule_no", pa.int64()), ("len", pa.int32())]))

    return run


def _range_of(bounds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            r = [bisect.bisect_right(bounds, k) for k in x.column("key").to_pylist()]
            yield x.append_column("r", pa.array(r, pa.int32()))

    return run


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: distinct (host, path). rules: (host, path, verdict, rule_no), rule_no unique.
    A row (host, path, rule_no) for each url that a rule covers."""
    spark = urls.sparkSession
    rules = rules.withColumn("key", F.concat(_reversed(F.col("host")), F.lit(END), F.col("path")))
    hosts = rules.select(F.col("host").alias("suffix")).distinct()
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked = urls.withColumn("suffix", F.explode(suffixes)).join(hosts, "suffix", "left_semi")
    looked = checkpointed(looked.select("host", "path", F.concat(_reversed(F.col("suffix")), F.lit(END), F.col("path")).alias("key")))
    n, parts = looked.count(), partitions(spark)
    share = max(1, n // SAMPLE_KEYS)
    sample = sorted(x[0] for x in looked.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).select("key").collect())
    bounds = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []
    starts = spark.createDataFrame([(i, b, b[:j]) for i, b in enumerate(bounds) for j in range(1, len(b) + 1)], "r int, bound string, pre string")
    open_at: list[list[tuple[str, int]]] = [[] for _ in range(len(bounds) + 1)]
    # a bound has at most as many open rules as it has characters
    for r, key, no in sorted(starts.join(rules, starts.pre == rules.key).filter("key < bound").select("r", "key", "rule_no").collect(), key=lambda x: (x[0], x[1])):
        open_at[r + 1].append((key, no))
    rows = looked.select("key", F.lit(-1).cast("long").alias("rule"), "host", "path").unionByName(
        rules.select("key", F.col("rule_no").cast("long").alias("rule"), "host", "path"))
    dealt = rows.mapInArrow(_range_of(bounds), "key string, rule long, host string, path string, r int")
    dealt = dealt.repartition(parts, "r").sortWithinPartitions("r", "key", F.col("rule").desc())
    found = dealt.mapInArrow(_sweep(open_at), "host string, path string, rule_no long, len int")
    return found.groupBy("host", "path").agg(F.max_by("rule_no", F.struct("len", -F.col("rule_no"))).alias("rule_no"))


def rule_table(spark, rules) -> DataFrame:
    """One rule for each (host, path), block before allow, numbered."""
    one = {}
    for host, path, verdict in rules:
        if one.get((host.lower(), path)) != "block":
            one[host.lower(), path] = verdict
    rows = [(h, p, v, i) for i, ((h, p), v) in enumerate(sorted(one.items(), key=lambda x: (-len(x[0][0]), x[1] != "block", x[0])))]
    return spark.createDataFrame(rows, "host string, path string, verdict string, rule_no long")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict of the url, which take the place of columns
    of these names."""
    host, path = parsed(F.col(url))
    rows = pages.select(F.struct(*pages.columns).alias("page"), host.alias("host"), path.alias("path"))
    each = checkpointed(rows.groupBy("host", "path").agg(F.count("*").alias("__n")))
    found = matched(each.select("host", "path"), rules)
    named = rules.select("rule_no", F.concat("host", "path").alias("rule"), "verdict")
    found = found.join(F.broadcast(named) if rules.count() <= BROADCAST_ROWS else named, "rule_no").drop("rule_no")
    hits = checkpointed(each.join(found, ["host", "path"]))
    out = join_hot(rows, hits, ["host", "path"], "__n")
    kept = [F.col("page")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url"), rule_table(pages.sparkSession, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path
  from (select page_id, coalesce(rest, '') as rest from u)
), r(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (
  select p.*, r.h || r.p as rule, r.v, row_number() over (partition by page_id order by length(r.h) + length(r.p) desc nulls last) as k
  from p left join r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.p)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1
"""
