"""Reachability, paths and levels over edge tables (src, dst).

Three physical forms of reachability: rounds of joins over a frontier (large graphs,
shallow), a recursive query (paths), and one task (deep chains whose edges fit in it).
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.plans.lineage import cut

#: Edges that one task may hold for the in-task form (some 100 bytes each).
TASK_EDGES = 2_000_000


#: Names below this number may be broadcast: some 50 bytes each.
BROADCAST_NAMES = 500_000


def held(edges: DataFrame) -> DataFrame:
    """Edges written once, for plans that read them in every round."""
    if getattr(edges, "_held", False):
        return edges
    out = cut(edges)
    out._held = True
    return out


def flipped(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out._held = getattr(edges, "_held", False)
    return out


def _hint(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_NAMES else rows


def reachable(edges: DataFrame, roots: DataFrame, method: str = "rounds") -> DataFrame:
    """(name) of all nodes reachable from roots (name), these included. Semi-naive: a
    round joins only the nodes that the one before found new."""
    if method == "task":
        return _in_task(edges, roots)
    edges = held(edges)
    seen = frontier = cut(roots.select("name").distinct())
    new = found = frontier.count()
    while new:
        step = edges.join(_hint(frontier.withColumnRenamed("name", "src"), new), "src", "left_semi").select(F.col("dst").alias("name")).distinct()
        frontier = cut(step.join(_hint(seen, found), "name", "left_anti"))
        seen, new = seen.union(frontier), frontier.count()
        found += new
    return seen


#: Nodes of a closure that one row may hold, nodes that the rows of one batch hold in all,
#: and those that one task gets.
ROW_SET, BATCH_SETS, TASK_SETS = 1_000_000, 500_000_000, 20_000_000


def closure_sizes(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, size): the number of nodes that edges lead to from each root (None: node) with
    an edge. Level by level from the ends, a node's closure is made once, of those that its
    edges lead to, as an array of the 64-bit hashes of its nodes; it is kept only if an edge
    leads to the node. So many nodes go at a time that what is shuffled stays bounded.
    Nodes on or above cycles, or with closures too large for a row, go by pairs."""
    edges = held(edges)
    if roots is not None:
        roots = cut(roots.toDF("name").distinct())
        edges = held(edges.join(reachable(edges, roots).withColumnRenamed("name", "src"), "src", "left_semi"))
    none = edges.select(F.col("src").alias("name")).limit(0)
    done = _peel(edges, none, lambda best: F.coalesce(best + 1, F.lit(0)))[0]
    needed = edges.select(F.col("dst").alias("src")).distinct().withColumn("needed", F.lit(True))
    by = cut(edges.join(done.select(F.col("name").alias("src"), "level").join(needed, "src", "left"), "src"))
    known = cut(done.filter("level = 0").select("name", F.lit(0).alias("size"), F.array().cast("array<long>").alias("set")))
    for level in range(1, (by.agg(F.max("level")).first()[0] or 0) + 1):
        mine, so_far = by.filter(F.col("level") == level).select("src", "dst", "needed"), known
        need = cut(mine.join(so_far.select(F.col("name").alias("dst"), "size"), "dst", "left").groupBy("src").agg(F.sum(F.coalesce("size", F.lit(0)) + 1).alias("need"), F.bool_and(F.col("size").isNotNull()).alias("all")))
        fits = F.col("all") & (F.col("need") <= ROW_SET)
        total, left = need.agg(F.sum(F.when(fits, F.col("need"))), F.count_if(~fits)).first()
        batches = (total or 0) // BATCH_SETS + 1
        for i in range(batches if total else 0):
            x = mine.filter(F.pmod(F.xxhash64(F.lit(level), "src"), F.lit(batches)) == i)
            x = x.join(need.filter(fits).select("src"), "src", "left_semi") if left else x
            x = x.join(so_far.select(F.col("name").alias("dst"), "set"), "dst").select("src", "needed", F.array_append("set", F.xxhash64("dst")).alias("set"))
            x = x.repartition(total // batches // TASK_SETS + 1, "src").groupBy("src", "needed").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set"))
            known = known.union(cut(x.select(F.col("src").alias("name"), F.size("set").alias("size"), F.when(F.col("needed"), F.col("set")).alias("set"))))
    asked = edges.select(F.col("src").alias("name")).distinct()
    asked = asked if roots is None else asked.join(roots, "name", "left_semi")
    sizes = known.filter("size > 0").select("name", F.col("size").cast("long").alias("size"))
    open_roots = cut(asked.join(sizes, "name", "left_anti"))
    sizes = (sizes if roots is None else sizes.join(roots, "name", "left_semi")).withColumnRenamed("name", "root")
    return sizes if open_roots.isEmpty() else sizes.union(_closure_pairs(edges, open_roots.toDF("root")))


def _closure_pairs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """As closure_sizes(), of any graph. Semi-naive, as in reachable()."""
    step = roots.join(edges.withColumnRenamed("src", "root"), "root").select("root", F.col("dst").alias("name"))
    seen = frontier = cut(step.distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges.withColumnRenamed("src", "name"), "name").select("root", F.col("dst").alias("name")).distinct()
        frontier = cut(step.join(seen, ["root", "name"], "left_anti"))
        seen = seen.union(frontier)
    return seen.groupBy("root").agg(F.count("*").alias("size"))


def _in_task(edges: DataFrame, roots: DataFrame) -> DataFrame:
    edges = held(edges)  # what leaves edges out is done by many tasks, before one reads the rest
    if edges.count() > TASK_EDGES:
        raise ValueError("too many edges for one task; use method='rounds'")
    rows = edges.select("src", "dst").union(roots.select(F.lit(None).cast("string"), "name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, todo = defaultdict(list), deque()
        for x in batches:
            for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                todo.append(b) if a is None else after[a].append(b)
        seen = set(todo)
        while todo:
            for b in after.get(todo.popleft(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["name"])

    return rows.coalesce(1).mapInArrow(run, "name string")


def all_paths(edges: DataFrame, start: str, limit: int | None = 4096, ends: Column | None = None) -> tuple[DataFrame, bool]:
    """(path array, node) of the first ``limit`` simple paths (None: of all), in order, to
    nodes for which ends holds, and whether there are more. By rounds: paths of one length at a time."""
    spark = edges.sparkSession
    edges = held(edges)
    ends = F.lit(True) if ends is None else ends
    level = found = spark.createDataFrame([([start], start)], "path array<string>, node string")
    while not level.isEmpty():
        level = cut(level.join(edges, level.node == edges.src).filter(~F.array_contains("path", F.col("dst"))).select(
            F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("node")))
        found = found.union(level)
    if limit is None:
        return found.filter(ends), False
    first = cut(found.filter(ends).orderBy(F.array_join("path", "/")).limit(limit + 1))
    return first.orderBy(F.array_join("path", "/")).limit(limit), first.count() > limit


def known(edges: DataFrame, names: list[str]) -> None:
    """Raises for names that are no nodes of the graph."""
    asked = edges.sparkSession.createDataFrame([(n,) for n in names], "name string")
    nodes = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    missing = asked.join(nodes, "name", "left_anti").collect()
    if missing:
        raise ValueError("unknown target: " + ", ".join(sorted(r["name"] for r in missing)))


def some_path(edges: DataFrame, a: str, b: str) -> list[str]:
    """The first path of a depth-first search that takes edges in order of pos, or []. Spark
    narrows the graph to the nodes between both ends; the search then runs in one task, with
    a set of nodes seen, so that cycles end it like anything else."""
    spark = edges.sparkSession
    plain = held(edges.select("src", "dst"))
    useful = reachable(flipped(plain), spark.createDataFrame([(b,)], "name string"))
    mine = cut(reachable(plain, spark.createDataFrame([(a,)], "name string")).join(useful, "name"))
    kept = edges.join(mine.withColumnRenamed("name", "src"), "src", "left_semi").join(mine.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst", "pos")
    kept = cut(kept)
    if kept.count() > TASK_EDGES:
        raise ValueError("too many edges for one task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = defaultdict(list)
        for x in batches:
            for s, d, p in zip(*(x.column(i).to_pylist() for i in range(3))):
                after[s].append((p, d))
        path, seen, todo = [], set(), [(a, 0)]
        while todo:
            name, depth = todo.pop()
            if name in seen:
                continue
            seen.add(name)
            path[depth:] = [name]
            if name == b:
                break
            todo.extend((d, depth + 1) for _, d in sorted(after[name], reverse=True) if d not in seen)
        else:
            path = []
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.list_(pa.string()))], ["path"])

    rows = kept.coalesce(1).mapInArrow(run, "path array<string>").collect()
    return list(rows[0]["path"]) if rows else ([a] if a == b else [])


def peeled(edges: DataFrame, own: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
    """(name, level, value) of all nodes. A node is done once all nodes that it has edges to
    are done; its value is value(largest of theirs), which may use the columns of own
    (name, ...) and sees null at the ends. A round joins the nodes just done to their edges,
    so each edge is met once. Raises on a cycle."""
    done, left = _peel(edges, own, value)
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return done


def _peel(edges: DataFrame, own: DataFrame, value: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(name, level, value) of the nodes that peeled() can do, and (name, ...) of the others. A
    round with many nodes deals the edges by their ends and keeps those not met for the next."""
    edges = held(edges)
    left = edges.count()
    ends = edges.select(F.col("src").alias("name"), F.lit(1).alias("__n")).union(edges.select("dst", F.lit(0)))
    cols = [c for c in own.columns if c != "name"]
    state = cut(ends.groupBy("name").agg(F.sum("__n").alias("__left")).join(own, "name", "left").select("name", *cols, "__left", F.lit(None).cast("long").alias("__best")))
    done, level = None, 0
    while True:
        now = cut(state.filter("__left = 0").select("name", F.lit(level).cast("long").alias("level"), value(F.col("__best")).cast("long").alias("value")))
        n = now.count()
        done = now if done is None else done.union(now)
        state = state.filter("__left > 0")
        if not n or not left:
            return done, state
        met = now.select(F.col("name").alias("dst"), "value", F.lit(True).alias("__met"))
        if n <= BROADCAST_NAMES:
            hit = edges.join(F.broadcast(met), "dst")
        else:
            all_edges = cut(edges.join(met, "dst", "left"))
            hit, edges = all_edges.filter("__met"), all_edges.filter("__met is null").select("src", "dst")
        hit = cut(hit.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("__n"), F.max("value").alias("__v")))
        left -= hit.agg(F.sum("__n")).first()[0] or 0
        state = cut(state.join(_hint(hit, hit.count()), "name", "left").select(
            "name", *cols, (F.col("__left") - F.coalesce("__n", F.lit(0))).alias("__left"), F.greatest("__best", "__v").alias("__best")))
        level += 1


def levels(edges: DataFrame) -> DataFrame:
    """(name, level): the longest way to a node without outgoing edges. Raises on a cycle."""
    none = edges.select(F.col("src").alias("name")).limit(0)
    return peeled(edges, none, lambda best: F.coalesce(best + 1, F.lit(0))).select("name", "level")


def cyclic(edges: DataFrame) -> DataFrame:
    """(name) of nodes on or between cycles: what is left when nodes without incoming or
    without outgoing edges are taken away again and again."""
    left = cut(edges.select("src", "dst"))
    n = left.count()
    while True:
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        m = left.count()
        if m == n:
            return left.select(F.col("src").alias("name")).distinct()
        n = m


def longest(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, priority): own weight plus the largest priority of a node it has an edge to."""
    own = weights.select("name", F.col("weight").alias("__w"))
    x = peeled(edges, own, lambda best: F.coalesce("__w", F.lit(0)) + F.coalesce(best, F.lit(0)))
    return x.select("name", F.col("value").alias("priority"))
