"""Readers of text formats: manifests, event logs, importers, coverage, layered settings.

Texts come as rows, for instance of spark.read.text or of binaryFile; parsing is by
built-in functions, but for TOML, which is parsed in Arrow batches.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.functions.text import resolve_label

TARGET = "package string, name string, kind string, srcs array<string>, deps array<string>, error string"
EVENT = "schema string, seq long, event string, id string, result string, cached boolean, duration_ms long, detail string"
COVERAGE = "files array<struct<file:string,lines:array<struct<line_number:long,count:long>>>>"


def manifests(texts: DataFrame, package: str, text: str) -> DataFrame:
    """Targets of TOML manifests: a table of each kind of target under [kind.name]. A
    manifest that can't be read gives one row with the error, and the others their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for pkg, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                try:
                    for kind, named in tomllib.loads(t or "").items():
                        if isinstance(named, dict):
                            rows.extend((pkg, n, kind, list(v.get("srcs", [])), list(v.get("deps", [])), None) for n, v in named.items() if isinstance(v, dict))
                except tomllib.TOMLDecodeError as e:
                    rows.append((pkg, None, None, [], [], str(e)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["package", "name", "kind", "srcs", "deps", "error"])

    found = texts.select(F.col(package).cast("string"), text).mapInArrow(run, TARGET)
    return found.withColumn("deps", F.transform("deps", lambda d: resolve_label(d, F.col("package"))))


def events(lines: DataFrame, log: str, line_no: str, text: str, schema: str = "events/1") -> DataFrame:
    """Event rows of logs, with bad = middle or last for a line that is no JSON object.
    Blank lines and foreign schemas are left out; a bad last line means a cut-off log."""
    x = lines.filter(F.trim(text) != "").select(log, line_no, F.from_json(text, f"{EVENT}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    last = F.max(line_no).over(W.partitionBy(log))
    x = x.withColumn("bad", F.when(F.col("e._corrupt").isNotNull(), F.when(F.col(line_no) == last, "last").otherwise("middle")))
    return x.filter(F.col("bad").isNotNull() | (F.col("e.schema") == schema)).select(log, line_no, "e.seq", "e.event", "e.id", "e.result", "e.cached", "e.duration_ms", "e.detail", "bad")


def ninja(lines: DataFrame, text: str) -> DataFrame:
    """(target, rule, input, is_dep) of build statements: an input is a dependency if some
    statement produces it, else a file."""
    built = r"^build ([^ :]+): ([^ ]+) ?(.*)$"
    x = lines.select(F.regexp_extract(text, built, 1).alias("target"), F.regexp_extract(text, built, 2).alias("rule"), F.regexp_extract(text, built, 3).alias("ins")).filter("target <> ''")
    one = x.select("target", "rule", F.explode(F.filter(F.split("ins", " +"), lambda i: i != "")).alias("input"))
    made = x.select(F.col("target").alias("input"), F.lit(True).alias("is_dep")).distinct()
    return one.join(made, "input", "left").select("target", "rule", "input", F.coalesce("is_dep", F.lit(False)).alias("is_dep"))


def npm(packages: DataFrame, text: str) -> DataFrame:
    """(src, dst) between the packages of a workspace, from their package.json texts."""
    x = packages.select(F.from_json(text, "name string, dependencies map<string,string>").alias("p"))
    names = x.select(F.col("p.name").alias("dst"))
    wanted = x.select(F.col("p.name").alias("src"), F.explode(F.map_keys("p.dependencies")).alias("dst"))
    return wanted.join(names, "dst", "left_semi").select("src", "dst").distinct()


def gcov(reports: DataFrame, text: str) -> DataFrame:
    """(file, line, count) of coverage reports."""
    f = reports.select(F.explode(F.from_json(text, COVERAGE)["files"]).alias("f"))
    return f.select("f.file", F.explode("f.lines").alias("l")).select("file", F.col("l.line_number").alias("line"), F.col("l.count").alias("count"))


def settings(lines: DataFrame, layer: str, line_no: str, text: str) -> DataFrame:
    """(key, value, layer, line) of lines ``section key=value``: a later layer, then a later
    line, wins; a key set to false is left out."""
    line = r"^\s*([a-z]+)\s+--([A-Za-z0-9_-]+)(?:=(.*))?$"
    x = lines.select(layer, line_no, F.regexp_extract(text, line, 2).alias("key"), F.regexp_extract(text, line, 3).alias("value")).filter("key <> ''")
    top = x.groupBy("key").agg(F.max(F.struct(layer, line_no, "value")).alias("t"))
    return top.filter("t.value <> 'false'").select("key", "t.value", F.col(f"t.{layer}").alias("layer"), F.col(f"t.{line_no}").alias("line"))
