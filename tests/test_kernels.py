"""Kernels by hand-checked cases and properties, without a session where possible."""

import os

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlane.functions import depfile
from arborlane.functions.text import glob_regex
from arborlane.operators import change, graph, journal, schedule
from arborlane.operators.content import boundaries, gear_table
from arborlane.streaming.events import debounced


def test_two_chains():
    """Three actions of 10 ms, one waiting for another: work 30, critical path 20."""
    d, needs = [10, 10, 10], [[], [0], []]
    rank = schedule.ranks(d, needs)
    assert rank == [20, 10, 10]
    assert schedule.simulate(d, needs, rank, 1) == 30
    assert schedule.simulate(d, needs, rank, 2) == 20
    assert schedule.simulate(d, needs, rank, 9) == 20


@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.randoms())
def test_schedule_bounds(d, rnd):
    needs = [[j for j in range(i) if rnd.random() < 0.3] for i in range(len(d))]
    rank = schedule.ranks(d, needs)
    assert schedule.simulate(d, needs, rank, 1) == sum(d)
    assert schedule.simulate(d, needs, rank, len(d)) == max(rank)
    assert max(rank) <= schedule.simulate(d, needs, rank, 2) <= sum(d)


@settings(deadline=None, max_examples=30)
@given(st.binary(max_size=5000))
def test_chunks_cover(data):
    cuts = boundaries(data, 128, gear_table())
    assert sum(n for _, n in cuts) == len(data)
    assert [a for a, _ in cuts] == [sum(n for _, n in cuts[:i]) for i in range(len(cuts))]
    assert all(32 <= n <= 512 for _, n in cuts[:-1])


def test_chunks_move_with_content():
    data = os.urandom(60_000)
    gear = gear_table()
    whole = {data[a : a + n] for a, n in boundaries(data, 256, gear)}
    edited = data[:30_000] + b"x" + data[30_000:]
    again = [edited[a : a + n] for a, n in boundaries(edited, 256, gear)]
    assert sum(len(c) for c in again if c in whole) > 0.9 * len(data)


def test_chunks_refuse():
    with pytest.raises(ValueError):
        boundaries(b"x" * 999, 100, gear_table())


def test_depfile():
    assert depfile.parse("a.o: b.h c\\ d.h \\\n e$$f.h\n\nb.h:\n") == ["c d.h", "e$f.h"]
    assert depfile.parse("") == []
    assert depfile.parse("a.o b.o: C:/x.h d\\:e.h \\\r\n f.h\nno rule here\nx: $$y b.o") == ["$y", "C:/x.h", "d:e.h", "f.h"]


@given(st.text(max_size=200))
def test_depfile_total(text):
    depfile.parse(text)


def test_globs():
    import re

    assert re.match(glob_regex("src/*.c"), "src/a.c") and not re.match(glob_regex("src/*.c"), "src/x/a.c")
    assert re.match(glob_regex("src/**/*.c"), "src/x/y/a.c") and re.match(glob_regex("src/**/*.c"), "src/a.c")


def test_debounce():
    """A repeated path does not move the deadline."""
    rows = [(0, "a"), (4, "a"), (8, "b"), (9, "c"), (30, "a")]
    closed, open_ = debounced(rows, 6)
    assert closed == [(0, 0, ["a"]), (8, 9, ["b", "c"])] and open_ == (30, 30, ["a"])
    first, mid = debounced(rows[:3], 6)
    rest, last = debounced(rows[3:], 6, mid)
    assert first + rest == closed and last == open_


DIAMOND = [("cli", "render"), ("cli", "text"), ("render", "core"), ("text", "core"), ("core", "gen"), ("core_test", "core")]


def _edges(spark, rows=DIAMOND):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "src string, dst string, pos int")


def test_diamond(spark):
    e = _edges(spark)
    root = spark.createDataFrame([("cli",)], "name string")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(graph.reachable(e, root)) == ["cli", "core", "gen", "render", "text"]
    assert names(graph.reachable(e, root, "task")) == names(graph.reachable(e, root))
    up = graph.reachable(graph.flipped(e.select("src", "dst")), spark.createDataFrame([("core",)], "name string"))
    assert names(up) == ["cli", "core", "core_test", "render", "text"]
    assert graph.some_path(e, "cli", "gen") == ["cli", "render", "core", "gen"]
    assert graph.some_path(e, "cli", "cli") == ["cli"] and graph.some_path(e, "gen", "cli") == []
    loop = spark.createDataFrame([("a", "c", 0), ("c", "a", 0), ("c", "b", 1), ("b", "d", 0), ("a", "d", 9)], "src string, dst string, pos int")
    assert graph.some_path(loop, "a", "b") == ["a", "c", "b"] and graph.some_path(loop, "a", "d") == ["a", "c", "b", "d"]
    wide = spark.createDataFrame([(f"{i}", f"{i + 1}{x}") for i in range(1, 6) for x in "" "xy"] + [(f"{i}{x}", f"{i}") for i in range(2, 7) for x in "xy"], "src string, dst string")
    paths, more = graph.all_paths(wide, "1", 10, F.col("node") == "6")
    assert more and len(paths.collect()) == 10
    every, more = graph.all_paths(wide, "1", 32, F.col("node") == "6")
    assert not more and every.count() == 32
    with pytest.raises(ValueError, match="unknown target: zz"):
        graph.known(wide, ["1", "zz"])
    level = {r["name"]: r["level"] for r in graph.levels(e.select("src", "dst")).collect()}
    assert level == {"gen": 0, "core": 1, "render": 2, "text": 2, "core_test": 2, "cli": 3}
    assert graph.cyclic(e).isEmpty()


def test_cycle(spark):
    e = _edges(spark, [*DIAMOND, ("gen", "core")]).select("src", "dst")
    with pytest.raises(ValueError):
        graph.levels(e)
    assert {r["name"] for r in graph.cyclic(e).collect()} == {"core", "gen"}


def test_dry_run(spark):
    e = _edges(spark).select("src", "dst")
    own = spark.createDataFrame([("gen", "dirty"), ("text", "failed")], "name string, state string")
    got = {r["name"]: r["decision"] for r in change.decided(own, e).collect()}
    assert got == {"gen": "would_run", "core": "may_run", "render": "may_run", "text": "may_run", "cli": "may_run", "core_test": "may_run"}
    own = spark.createDataFrame([("text", "failed")], "name string, state string")
    got = {r["name"]: r["decision"] for r in change.decided(own, e).collect()}
    assert got["text"] == "failed" and got["cli"] == "skipped" and got["render"] == "cached"


def test_journal(spark):
    j = spark.createDataFrame([("l", 1, "a", True), ("l", 2, "b", True), ("l", 3, "a", False), ("l", 4, "b", True), ("m", 1, "a", True)], "log string, seq int, id string, valid boolean")
    kept = journal.valid_prefix(j, "log", "seq", "valid")
    assert sorted((r["log"], r["seq"]) for r in kept.collect()) == [("l", 1), ("l", 2), ("m", 1)]
    last = journal.fold(j.filter("log = 'l'"))
    assert {r["id"]: r["seq"] for r in last.collect()} == {"a": 3, "b": 4}
