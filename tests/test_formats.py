"""Readers and sinks on the cases that the queries do not reach."""

from pyspark.sql import functions as F

from arborlane.operators import content, lowering, report, schedule
from arborlane.sources import formats, sinks


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_manifest_errors(spark):
    texts = [("a", '[library.x]\nsrcs=["x.c"]\ndeps=["//b:y", ":z", "//:t"]\n'), ("b", "not toml ["), ("c", ""), ("d", None)]
    rows = formats.manifests(spark.createDataFrame(texts, "package string, text string"), "package", "text").collect()
    assert [(r["name"], list(r["deps"])) for r in rows if r["package"] == "a"] == [("x", ["//b:y", "//a:z", "t"])]
    assert [r["error"] is not None for r in rows if r["package"] == "b"] == [True] and len(rows) == 2


def test_event_log(spark):
    ok = '{"schema":"events/1","seq":%d,"event":"done"}'
    lines = [("l", 1, ok % 1), ("l", 2, ""), ("l", 3, "{"), ("l", 4, ok % 2), ("l", 5, '{"schema":"events/1"'), ("m", 1, '{"schema":"x","seq":1}'), ("m", 2, ok % 7)]
    got = formats.events(spark.createDataFrame(lines, "log string, n int, text string"), "log", "n", "text")
    assert {(r["log"], r["n"], r["seq"], r["bad"]) for r in got.collect()} == {("l", 1, 1, None), ("l", 3, None, "middle"), ("l", 4, 2, None), ("l", 5, None, "last"), ("m", 2, 7, None)}


def test_ninja(spark):
    lines = spark.createDataFrame([("rule cc",), ("build a.o: cc a.c",), ("build app: link a.o  b.o",), ("build all: phony app",)], "text string")
    assert _set(formats.ninja(lines, "text")) == {("a.o", "cc", "a.c", False), ("app", "link", "a.o", True), ("app", "link", "b.o", False), ("all", "phony", "app", True)}


def test_settings(spark):
    lines = [(0, 1, "build --jobs=4"), (1, 1, "build --jobs=8"), (1, 2, "# note"), (1, 3, "test --color=false"), (0, 9, "test --color=auto")]
    got = formats.settings(spark.createDataFrame(lines, "layer int, n int, text string"), "layer", "n", "text")
    assert _set(got) == {("jobs", "8", 1, 1)}


def test_store(spark, tmp_path):
    at = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.put_new(first, at, "k") == 2
    assert sinks.put_new(spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), at, "k") == 3
    assert _set(spark.read.parquet(at)) == {(1, "a"), (2, "b"), (3, "c")}


def test_lowering(spark):
    t = spark.createDataFrame([("l", "library", ["a", "b"], 0), ("t", "test", ["x"], 2), ("u", "test", ["x"], 1)], "name string, kind string, srcs array<string>, shards int")
    assert {r["id"] for r in lowering.lowered(t).collect()} == {"compile:l:a", "compile:l:b", "archive:l", "test:t#0/2", "test:t#1/2", "test:u"}


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2)] + [("b", 7)], "k string, v long")
    assert {r["k"]: r["median"] for r in report.upper_median(rows, "k", "v").collect()} == {"a": 3, "b": 7}


def test_tail(spark):
    rows = spark.createDataFrame([(1, "\n".join(map(str, range(50)))), (2, "x")], "k int, t string")
    got = {r["k"]: r for r in report.tail(rows, "k", "t", 40).collect()}
    assert got[1]["hidden"] == 10 and got[1]["tail"].startswith("10\n") and got[2]["tail"] == "x" and got[2]["hidden"] == 0


def test_key_ignores_map_order(spark):
    x = spark.range(1).select(content.key_digest(("a", F.lit("é")), ("b", F.lit(""))).alias("k")).first()["k"]
    import hashlib

    assert x == hashlib.sha256("a\0".encode() + b"2\0" + "é\0".encode() + b"b\0" + b"0\0\0").hexdigest()


def test_sweep_refuses_no_graph(spark):
    none = spark.createDataFrame([], "graph string, pos int, duration long, guess long, needs array<int>")
    assert schedule.sweep(none, ("fifo",), (1,)).isEmpty()
