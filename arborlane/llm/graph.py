"""Connected components over edges that never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm.common import checkpointed

#: Edges that one task reduces to a forest before the rounds.
PACK_EDGES = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node that they connect it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for t in batches:
        for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = np.fromiter((n for n in root if root[n] != n), np.int64)
    tops = np.fromiter((find(int(n)) for n in nodes), np.int64, len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tops)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of an edge (a, b): root is the smallest node of its
    component. Edges are packed, each pack becomes a forest in its task, and large-star
    and small-star steps (Kiveris et al.) connect the forests: each step an aggregation
    with a map-side minimum and one join, until nothing changes. Rounds grow with the
    logarithm of the number of edges; with a single pack there is nothing to connect."""
    given = checkpointed(edges.select("a", "b").filter("a <> b"))
    packs = -(-max(1, given.count()) // PACK_EDGES)
    now = checkpointed((given.coalesce(packs) if packs == 1 else given.repartition(packs)).mapInArrow(_forest, "a long, b long"))
    before = None
    while packs > 1:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.union(now.join(low, "a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = checkpointed(small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.col("b") % 1_000_003))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root")).groupBy("node").agg(F.min("root").alias("root"))
