"""Comparing snapshots: first causes, differences, decisions, coverage of expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.operators.graph import peeled


def compared(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and change: only_a, only_b, the first field that differs, or same."""
    left = a.select(key, F.lit(True).alias("__a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    right = b.select(key, F.lit(True).alias("__b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    first: Column = F.lit("same")
    for f in reversed(fields):
        first = F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)).otherwise(first)
    change = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").otherwise(first)
    return left.join(right, key, "full").withColumn("change", change)


def first_cause(old: DataFrame, new: DataFrame, action: str, path: str, digest: str) -> DataFrame:
    """Why the key of an action changed: the first path, in order, that is new or has
    another digest, else the first that is gone, else the command itself."""
    o = old.select(action, path, F.col(digest).alias("__old"))
    n = new.select(action, path, F.col(digest).alias("__new"))
    x = o.join(n, [action, path], "full")
    phase = F.when(F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("__old")), 0).when(F.col("__new").isNull(), 1)
    why = F.when(F.col("__old").isNull(), F.concat(F.lit("new input: "), path)).when(F.col("__new").isNull(), F.concat(F.lit("input removed: "), path)).otherwise(F.concat(F.lit("input changed: "), path))
    x = x.select(action, F.struct(phase.alias("phase"), F.col(path).alias("path"), why.alias("why")).alias("r"))
    best = x.groupBy(action).agg(F.min(F.when(F.col("r.phase").isNotNull(), F.col("r"))).alias("r"))
    return best.select(action, F.coalesce("r.why", F.lit("command or toolchain changed")).alias("reason"))


def holds(expected: DataFrame, actual: DataFrame, owner: str, path: str, digest: str) -> DataFrame:
    """Whether all of an owner's expected digests hold now; a path with two expectations
    never does, and a missing one has the digest MISSING."""
    now = actual.select(path, F.col(digest).alias("__now"))
    twice = expected.groupBy(path).agg((F.min(digest) != F.max(digest)).alias("__twice"))
    x = expected.join(now, path, "left").join(twice, path)
    return x.groupBy(owner).agg(F.bool_and((F.coalesce("__now", F.lit("MISSING")) == F.col(digest)) & ~F.col("__twice")).alias("cached"))


#: Decisions of a dry run, by number.
DECISIONS = ("cached", "would_run", "may_run", "failed", "skipped")


def decided(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, decision) of a dry run. own: (name, state) by itself: failed, dirty or clean.
    Skipped if a dependency failed or is skipped; may_run if one runs or may run; else its
    own state. Edges go from a node to what it needs. Decisions are numbered so that the
    largest one of the dependencies decides."""
    own_says = F.when(F.col("__state") == "failed", 3).when(F.col("__state") == "dirty", 1).otherwise(0)
    x = peeled(edges, own.select("name", F.col("state").alias("__state")), lambda worst: F.when(worst >= 3, 4).when(worst >= 1, 2).otherwise(own_says))
    return x.select("name", F.element_at(F.array(*[F.lit(d) for d in DECISIONS]), (F.col("value") + 1).cast("int")).alias("decision"))


def layered(settings: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """The value of the highest layer that sets a key, and which layer that is."""
    return settings.groupBy(key).agg(F.max_by(F.struct(value, priority), F.col(priority)).alias("v")).select(key, F.col(f"v.{value}").alias(value), F.col(f"v.{priority}").alias("layer"))


def admitted(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs (name, from_pkg, to_pkg) that some rule of name admits: the package itself,
    everywhere, exactly a package, or a package and those below it. Each kind of rule is
    an equi-join, a subtree by the ancestors of the asking package."""
    parts = F.split("from_pkg", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    same = pairs.filter(F.col("from_pkg") == F.col("to_pkg"))
    every = pairs.join(rules.filter("kind = 'all'").select("name").distinct(), "name", "left_semi")
    exact = pairs.join(rules.filter("kind = 'exact'").select("name", F.col("pkg").alias("from_pkg")).distinct(), ["name", "from_pkg"], "left_semi")
    under = pairs.withColumn("__up", F.explode(up)).join(rules.filter("kind = 'subtree'").select("name", F.col("pkg").alias("__up")).distinct(), ["name", "__up"], "left_semi").drop("__up")
    return reduce(DataFrame.unionByName, (every.select(same.columns), exact.select(same.columns), under.select(same.columns)), same).distinct()
