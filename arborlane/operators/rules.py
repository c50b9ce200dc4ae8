"""Rules on rows: selection by attributes, decisions, tagged commands, findings, proofs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.functions.text import glob_regex


def having(targets: DataFrame, io: DataFrame, glob: str, role: str | None = None) -> DataFrame:
    """targets (target) with a path in io (target, path, role) that a glob matches."""
    hit = io.filter(F.regexp_like("path", F.lit(glob_regex(glob))))
    return targets.join(hit if role is None else hit.filter(F.col("role") == role), "target", "left_semi")


def having_flag(targets: DataFrame, actions: DataFrame, flag: str, value: bool) -> DataFrame:
    """targets with an action whose flag has the value."""
    return targets.join(actions.filter(F.col(flag) == F.lit(value)), "target", "left_semi")


def of_kind(actions: DataFrame, kind: str) -> DataFrame:
    """Actions of a kind; it is an error if there are none."""
    found = actions.filter(F.col("kind") == kind)
    if found.isEmpty():
        raise ValueError(f"no targets of kind {kind}")
    return found


def inside(path: Column, directory: Column) -> Column:
    """Whether a path is a directory or in it, by whole segments."""
    return (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def decision(no_cache: bool = False, runs: int = 1) -> Column:
    """outcome and reason of an action from upstream_failed, upstream_dirty (ids or null),
    test, volatile, known, same_key, same_outputs, bad_output (a path or null), restorable,
    remote and cause. The first condition that holds decides."""
    c = F.col
    told = lambda outcome, reason: F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"))
    none = F.lit("")
    recorded = c("known") & c("same_key") & c("same_outputs")
    steps = [
        (c("upstream_failed").isNotNull(), told("skipped", F.concat(F.lit("upstream failed: "), c("upstream_failed")))),
        (c("upstream_dirty").isNotNull(), told("may_run", F.concat(F.lit("depends on output of "), c("upstream_dirty"), F.lit(", which would run")))),
        (c("test") & F.lit(no_cache), told("would_run", F.lit("test cache disabled"))),
        (c("volatile"), told("would_run", F.lit("volatile stamp value"))),
        (c("test") & F.lit(runs > 1), told("would_run", F.lit(f"running {runs} times"))),
        (recorded & (c("bad_output").isNull() | c("restorable")), told("cached", none)),
        (recorded, told("would_run", F.concat(F.lit("output missing or modified: "), c("bad_output")))),
        (c("remote"), told("cached", none)),
        (c("known"), told("would_run", c("cause"))),
    ]
    out = told("would_run", F.lit("not built before"))
    for condition, result in reversed(steps):
        out = F.when(condition, result).otherwise(out)
    return out


def tagged(argv: Column, stamps: Column, preserve: Column, clean: Column, more: Column) -> Column:
    """The command that a key is made of: argv, then what else decides its outputs, each part
    behind a tag that no argument can be, as it starts with NUL. stamps: array of structs of
    key and value; clean: array of directories; more: array of commands."""
    tag = lambda name: F.lit("\0" + name)
    part = lambda a, f: F.flatten(F.transform(a, f))
    return F.concat(
        argv, part(stamps, lambda s: F.array(tag("stamp"), s["key"], F.coalesce(s["value"], F.lit("")))),
        F.when(preserve, F.array(tag("preserve-outputs"))).otherwise(F.array().cast("array<string>")),
        part(clean, lambda d: F.array(tag("clean-dir"), d)), part(more, lambda m: F.concat(F.array(tag("next-command")), m)))


#: The 64-bit FNV-1a hash's fixed values.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv_hex(rows: DataFrame, text: str, out: str = "fnv") -> DataFrame:
    """rows with the 64-bit FNV-1a hash of a text in hexadecimal. Spark's sums check for
    overflow, so a batch goes byte by byte through numpy, all rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            raw = [(t or "").encode() for t in x.column(x.schema.get_field_index(text)).to_pylist()]
            size = np.array([len(r) for r in raw], np.int64)
            order = np.argsort(-size, kind="stable")
            flat, first = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.cumsum(size) - size
            h = np.full(len(raw), FNV_START, np.uint64)
            for i in range(int(size.max(initial=0))):
                live = order[: np.searchsorted(-size[order], -i)]
                h[live] = (h[live] ^ flat[first[live] + i]) * np.uint64(FNV_PRIME)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([f"{int(v):016x}" for v in h])], [*x.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, {out} string")


def fingerprint(tools: DataFrame, group: str, name: str, digest: str) -> DataFrame:
    """A digest of each group's tools, in order of their names. A group is one toolchain."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(digest).alias("d"))))
    return tools.groupBy(group).agg(pairs.alias("p")).select(group, F.sha2(F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["n"], x["d"])), "\n"), 256).alias("fingerprint"))


def proven(then: DataFrame, now: DataFrame, key: str, maps: list[str], values: list[str]) -> DataFrame:
    """key and whether all that was recorded holds now: maps with equal entries, equal values.
    What one side lacks does not hold."""
    a, b = then.withColumnsRenamed({c: f"__{c}" for c in maps + values}).withColumn("__then", F.lit(True)), now.withColumn("__now", F.lit(True))
    entries = lambda c: F.array_sort(F.map_entries(c))
    same = F.col("__then").isNotNull() & F.col("__now").isNotNull()
    for c in maps:
        same = same & entries(F.col(c)).eqNullSafe(entries(F.col(f"__{c}")))
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(b, key, "full").select(key, same.alias("valid"))


def closest(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(input, suggestion): of names (name, pos) the first of least edit distance to each
    input, if that is at most one and a third of the input's length. names are the few
    labels of a package, broadcast."""
    d = F.levenshtein("input", "name")
    pairs = asked.join(F.broadcast(names), F.lit(True)).withColumn("at", F.struct(d.alias("d"), F.col("pos")))
    best = pairs.groupBy("input").agg(F.min_by("name", "at").alias("suggestion"), F.min("at").alias("at"))
    return best.filter(F.col("at.d") <= 1 + F.floor(F.length("input") / 3)).select("input", "suggestion")


def findings(targets: DataFrame, volatile: list[str], present: DataFrame) -> DataFrame:
    """(target, rule, value) of volatile variables in pass_env and of includes that are no
    directory present (dir), in order of target and rule."""
    env = targets.select("target", F.lit("volatile-pass-env").alias("rule"), F.explode("pass_env").alias("value")).filter(F.col("value").isin(volatile))
    dirs = targets.select("target", F.lit("missing-include-dir").alias("rule"), F.explode("includes").alias("value"))
    return env.union(dirs.join(present, dirs["value"] == present["dir"], "left_anti")).orderBy("target", "rule", "value")


def relative_path(raw: Column) -> Column:
    """path (normalized, null if refused) and error (null if accepted) of a workspace path."""
    parts = F.split(raw, "/")
    kept = F.filter(parts, lambda p: p != ".")
    error = (
        F.when(raw == "", "empty path").when(F.contains(raw, F.lit("\\")), "not forward slashes").when(F.startswith(raw, F.lit("/")), "absolute")
        .when(F.array_contains(parts, ""), "empty component").when(F.array_contains(parts, ".."), "escapes").when(F.size(kept) == 0, "no file"))
    return F.struct(F.when(error.isNull(), F.array_join(kept, "/")).alias("path"), error.alias("error"))


def declares(text: Column, needle: str) -> Column:
    """Whether a line that is no comment contains the needle."""
    return F.exists(F.split(text, "\n"), lambda x: ~F.regexp_like(F.ltrim(x), F.lit(r"^(//|#|\*)")) & F.contains(x, F.lit(needle)))


def cases(events: DataFrame, run: str) -> DataFrame:
    """(run, id, result) of test events; a run without any whose actions were all cached is
    one passing case."""
    tests = events.filter(F.col("test")).select(run, "id", "result")
    cached = events.filter(F.col("all_cached")).select(run).distinct().join(tests, run, "left_anti")
    return tests.union(cached.select(run, F.lit("test:all cached"), F.lit("cached")))


def changes(events: DataFrame, outputs: DataFrame, clean: list[str], private: tuple[str, ...] = (".git",)) -> DataFrame:
    """Events (path, kind) that change files a build may read."""
    own = F.lit(False)
    for d in (*private, *clean):
        own = own | inside(F.col("path"), F.lit(d))
    return events.filter(F.col("kind").isin("any", "create", "modify", "remove") & (F.col("path") != "") & ~own).join(outputs, "path", "left_anti")
