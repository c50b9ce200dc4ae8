"""Scheduling what-ifs: estimates, list scheduling, sweeps over strategies and job counts."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "graph string, strategy string, jobs int, makespan long, work long, critical_path long"


def estimates(actions: DataFrame, history: DataFrame, by_kind: dict[str, int], default: int) -> DataFrame:
    """Four estimates of each action's duration: 1; its kind's constant; its last recorded
    duration; and that or else the upper median of its kind's. history: (id, kind, duration)."""
    n = history.groupBy("kind", "duration").agg(F.count("*").alias("c"))
    from pyspark.sql import Window as W

    w = W.partitionBy("kind")
    n = n.withColumns({"upto": F.sum("c").over(w.orderBy("duration")), "all": F.sum("c").over(w)})
    median = n.filter("upto > floor(all / 2)").groupBy("kind").agg(F.greatest(F.min("duration"), F.lit(1)).alias("median"))
    known = F.create_map(*[F.lit(x) for kv in by_kind.items() for x in kv])
    x = actions.select("id", "kind").join(history.select("id", F.col("duration").alias("last")), "id", "left").join(F.broadcast(median), "kind", "left")
    return x.select("id", F.lit(1).cast("long").alias("static"), F.coalesce(known[F.col("kind")], F.lit(default)).cast("long").alias("heuristic"),
                    F.coalesce("last", F.lit(1)).cast("long").alias("journal"), F.coalesce("last", "median", F.lit(1)).cast("long").alias("learned"))


def simulate(durations: list[int], needs: list[list[int]], priority: list[int], jobs: int) -> int:
    """The makespan of list scheduling: of the ready actions the one of highest priority,
    then lowest index, starts on a free worker."""
    return _simulate(durations, *_turned(needs), _places(priority), jobs)


def _turned(needs: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """How many actions each one needs, and those that need it."""
    after: list[list[int]] = [[] for _ in needs]
    waiting = []
    for i, n in enumerate(needs):
        own = set(n) if len(n) > 1 else n
        waiting.append(len(own))
        for j in own:
            after[j].append(i)
    return waiting, after


def _places(priority: list[int]) -> list[int]:
    """Actions in the order in which they start if all are ready."""
    return sorted(range(len(priority)), key=lambda i: (-priority[i], i))


def _simulate(durations: list[int], waiting: list[int], after: list[list[int]], order: list[int], jobs: int) -> int:
    """simulate() of a graph turned before; what is ready is kept as places in the order."""
    waiting, place = waiting.copy(), [0] * len(order)
    for k, i in enumerate(order):
        place[i] = k
    ready = [k for k, i in enumerate(order) if not waiting[i]]
    running: list[tuple[int, int]] = []
    now = 0
    while ready or running:
        while ready and len(running) < jobs:
            i = order[heapq.heappop(ready)]
            heapq.heappush(running, (now + durations[i], i))
        now, i = heapq.heappop(running)  # workers are filled again after each completion
        for j in after[i]:
            waiting[j] -= 1
            if not waiting[j]:
                heapq.heappush(ready, place[j])
    return now


def _lists(column: pa.Array) -> list[list]:
    """A column of lists as Python lists, its values made at once."""
    if pa.types.is_list(column.type.value_type):
        values = _lists(column.values)
    else:
        values = column.values.to_pylist() if column.values.null_count else column.values.to_numpy(zero_copy_only=False).tolist()
    at = column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def ranks(durations: list[int], needs: list[list[int]]) -> list[int]:
    """Own duration plus the largest rank of those that need it; needs point backwards."""
    out = list(durations)
    best = [0] * len(durations)
    for i in range(len(durations) - 1, -1, -1):
        out[i] = durations[i] + best[i]
        for j in needs[i]:
            best[j] = max(best[j], out[i])
    return out


def sweep(actions: DataFrame, strategies: tuple[str, ...], jobs: tuple[int, ...]) -> DataFrame:
    """A row of POINT for each graph, strategy and job count. actions: (graph, pos, duration,
    guess, needs array<int>), needs pointing to smaller pos. A graph is one build, which is
    one row of lists: a task simulates its graphs one after another."""
    listed = actions.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("pos", "duration", "guess", "needs"))).alias("a"))
    flat = listed.select("graph", F.col("a.duration").alias("duration"), F.col("a.guess").alias("guess"), F.col("a.needs").alias("needs"))
    fields = pa.schema([("graph", pa.string()), ("strategy", pa.string()), ("jobs", pa.int32()), ("makespan", pa.int64()), ("work", pa.int64()), ("critical_path", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            spans, work, path = [], [], []
            for d, guess, needs in zip(*(_lists(x.column(c)) for c in ("duration", "guess", "needs"))):
                rank = ranks(d, needs)
                work.append(sum(d))
                path.append(max(rank, default=0))
                # One worker is never idle, and as many as actions never wait for one another.
                plain = min(d, default=0) >= 0
                told = {n: work[-1] if n == 1 else path[-1] for n in jobs if plain and (n == 1 or n >= len(d))}
                turned = _turned(needs) if len(told) < len(set(jobs)) else None
                for strategy in strategies:
                    if turned:
                        order = _places({"fifo": lambda: [0] * len(d), "critical": lambda: rank if guess == d else ranks(guess, needs), "longest": lambda: guess}[strategy]())
                    spans.extend(told[n] if n in told else _simulate(d, *turned, order, n) for n in jobs)
            points, m = len(strategies) * len(jobs), len(work)
            each = np.repeat(np.arange(m), points)
            names = pa.array(strategies, pa.string()).take(pa.array(np.tile(np.repeat(np.arange(len(strategies)), len(jobs)), m)))
            cols = [x.column("graph").take(pa.array(each)), names, pa.array(np.tile(np.array(jobs, np.int32), m * len(strategies))), pa.array(spans, pa.int64()),
                    pa.array(work, pa.int64()).take(pa.array(each)), pa.array(path, pa.int64()).take(pa.array(each))]
            yield pa.RecordBatch.from_arrays(cols, schema=fields)

    return flat.mapInArrow(run, POINT)


def critical_chain(guess: list[int], needs: list[list[int]]) -> list[int]:
    """The actions that bound a build: of those that need nothing the one of the highest
    rank, then the highest of those that need it, and so on; of equal ones the last."""
    rank, after = ranks(guess, needs), defaultdict(list)
    for i, n in enumerate(needs):
        for j in set(n):
            after[j].append(i)
    out, open_now = [], [i for i, n in enumerate(needs) if not n]
    while open_now:
        out.append(max(open_now, key=lambda i: (rank[i], i)))
        open_now = after[out[-1]]
    return out


def walk(actions: DataFrame) -> DataFrame:
    """(graph, place, pos): the critical chain of each graph, places from 1. A graph is one
    build and goes to a task as one row of lists, as in sweep()."""
    listed = actions.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("pos", "guess", "needs"))).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(g, i, p) for g, d, n in zip(x.column("graph").to_pylist(), *(_lists(x.column(c)) for c in ("guess", "needs"))) for i, p in enumerate(critical_chain(d, n), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["graph", "place", "pos"])

    return listed.select("graph", F.col("a.guess").alias("guess"), F.col("a.needs").alias("needs")).mapInArrow(run, "graph string, place long, pos long")


def best(points: DataFrame) -> DataFrame:
    """The point of least makespan, then fewest jobs, then first strategy, of each graph."""
    return points.groupBy("graph").agg(F.min(F.struct("makespan", "jobs", "strategy")).alias("b")).select("graph", "b.strategy", "b.jobs", "b.makespan")
