"""Near duplicates by a metric-space join under the Jaccard distance.

A document is the set of its 5-word shingles; two link when the Jaccard distance of
their sets is at most 0.2. The join goes through ever smaller regions of the space:

1. Pivots of one shingle. The distance of a set to {s} is below 1 only if it holds s,
   so a set lies in the cells of its own shingles. Of two linked sets of at most n
   shingles, each lacks at most n / 5 of its own in the other: sets that share too few
   of their first shingles (in the order of hashes) with any other set are in no
   window of anyone and drop out. The rest replicate to the cells of their n / 5 + 1
   rarest shingles only, which every link must share one of; sets that meet in a cell
   are connected into regions.
2. Pivots that are documents. A region is split into the Voronoi cells of some of its
   sets; a set also enters the cells that the triangle inequality leaves open (its
   distance to that pivot is at most 0.4 above that to its own), and the cells are
   joined recursively, as long as that at least halves the pairs: in a tight cluster
   all windows are open, and every set would enter every cell. A region too large for
   one task is first split in this way by Spark itself, or, if it is such a cluster, by
   pairs of parts. What is left of a region is joined set by set: sets outside the
   largest component look for links through their rarest shingles, of which a linked
   set can lack only so many, and are compared with the few sets that have enough.

Voronoi cells alone can't start this join: almost all sets are at distance 1 from any
document that is a pivot, so all windows would be open. That is what step 1 is for.

The result is exact up to collisions of 64-bit hashes. Sets that are equal are one
class and go through once.

Defined cases: a null or empty text has no shingles and links with nothing; fewer words
than five are one shingle; rows of equal doc_id and text are in one class; a null
doc_id counts as larger than any other and is never a component's name unless alone;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm import blocks as B
from arborlane.llm.common import BROADCAST_ROWS, checkpointed, dealt, give_back, join_hot, own_names, release, small
from arborlane.llm.graph import components

SHINGLE = 5
NEAR, WIDE, FAR = 0.2, 0.4, 0.8

#: Shingles of a region that one task joins; larger regions are split first.
REGION_SHINGLES = 3_000_000
#: Sets of a region that are compared by single pivots instead of being split further.
LEAF = 200
PIVOTS = 16
#: Cells are joined one by one if they have at most this share of the pairs of what they split.
PAYS = 0.5
#: Entries of the index that a search may read, beyond those that it must.
POSTINGS = 20_000
#: Rounds in which Spark splits large regions by pivots, before it goes to pairs of parts.
SPLITS = 3


def shingles(tokens: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle keys of each document of a block."""
    every = B.sequence_keys(tokens, width)
    none = np.zeros(0, np.uint64)
    out = []
    for at, n in zip(starts.tolist(), lens.tolist()):
        if n >= width:
            out.append(np.unique(every[at : at + n - width + 1]))
        else:
            out.append(B.mixed(B.sequence_keys(tokens[at : at + n], n) + np.uint64(n)) if n else none)
    return out


def set_key(s: np.ndarray) -> int:
    """A key of the set, as a signed 64-bit number."""
    return int((B.mixed(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def _sets(row: dict) -> tuple[B.Block, list[np.ndarray]]:
    x = B.read_block(row)
    keys = B.word_keys(x.words)
    return x, shingles(keys[x.codes] if len(x.codes) else np.zeros(0, np.uint64), x.starts, x.lens)


def _lacking(n):
    """Most shingles of a set of n that a linked set can lack."""
    return n // 5


def _first(n):
    """Shingles looked at first, and how many of them a link must have in common: the
    j-th common shingle is among the first lacking + j of either set."""
    extra = _lacking(n) // 2 + 1
    return np.minimum(n, _lacking(n) + extra)


def _needed(n):
    least = -(-4 * n // 5)  # the size of the smallest set that can link
    return _lacking(least) // 2 + 1


INFO = "block long, place long, doc_id long, n long, set long"


def _info(row: dict) -> list[tuple]:
    x, sets = _sets(row)
    return [(row["block"], i, doc, len(s), set_key(s)) for i, (doc, s) in enumerate(zip(x.ids, sets))]


def _chosen(t: pa.Table) -> pa.Table:
    """The places in a block of the rows that stand for their class, as an answer."""
    places = np.sort(np.array(t.column("place").to_pylist(), np.int64))
    return B.table(B.ANSWER, [(t.column("block")[0].as_py(), -1, places.tobytes(), b"")])


def _beside(blocks: DataFrame, right: DataFrame, f, schema: str) -> DataFrame:
    """f(block row, sets that stand for their class, the other answers) for each block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.zeros(0, np.int64)
        counts = []
        for bucket, count in sorted(zip(right.column("bucket").to_pylist(), right.column("count").to_pylist())):
            if bucket < 0:
                own = np.frombuffer(count, np.int64)
            else:
                counts.append(np.frombuffer(count, np.uint8))
        rows = []
        for row in left.to_pylist():
            sets = _sets(row)[1]
            rows.extend(f(row, [sets[i] for i in own.tolist()], np.concatenate(counts) if counts else np.zeros(0, np.uint8)))
        return B.table(schema, rows)

    return blocks.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)


def _held(keys: np.ndarray, owner: np.ndarray):
    """Distinct keys, the number of records of each, and its smallest owner."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys))), owner[first]


def _flat(sets: list[np.ndarray], names: list[int]) -> tuple[np.ndarray, np.ndarray]:
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sets), np.repeat(np.array(names, np.int64), [len(s) for s in sets])


def _ask_first(buckets: int):
    """Count says whether one set of the block has the key, or more."""

    def f(row: dict, sets: list[np.ndarray], _) -> list[tuple]:
        if not sets:
            return []
        key, count = np.unique(np.concatenate([s[: _first(len(s))] for s in sets]), return_counts=True)
        return [(*r[:4], b"") for r in B.asks(row["block"], key, np.minimum(count, 2), np.zeros(len(key)), buckets)]

    return f


def _shared(t: pa.Table) -> pa.Table:
    """Of a bucket's keys: 1 where two sets or more have it."""
    keys, count = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint64), B.read_numbers(t.column("count").to_pylist())
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    many = np.empty(len(keys), np.uint8)
    many[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    many |= count > 1
    rows, at = [], 0
    for block, bucket, b in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), t.column("keys").to_pylist()):
        rows.append((block, bucket, many[at : at + len(b) // 8].tobytes(), b""))
        at += len(b) // 8
    return B.table(B.ANSWER, rows)


SETS = "set long, n int, keys binary"


def _survivors(row: dict, sets: list[np.ndarray], many: np.ndarray) -> list[tuple]:
    if not sets:
        return []
    keys = np.unique(np.concatenate([s[: _first(len(s))] for s in sets]))
    shared = keys[many > 0]
    return [
        (set_key(s), len(s), s.tobytes()) for s in sets
        if np.isin(s[: _first(len(s))], shared, assume_unique=True).sum() >= _needed(len(s))]


PACK = "block long, sets array<long>, lens binary, keys binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, names, sets, size = TaskContext.get().partitionId() << 32, [], [], 0

    def closed():
        row = (number, names, np.array([len(s) // 8 for s in sets], np.int32).tobytes(), b"".join(sets))
        return B.batch(PACK, [row])

    for x in batches:
        for name, keys in zip(x.column("set").to_pylist(), x.column("keys").to_pylist()):
            names.append(name), sets.append(keys)
            size += len(keys)
            if size > 2 * B.BLOCK_BYTES:
                yield closed()
                number, names, sets, size = number + 1, [], [], 0
    if names:
        yield closed()
    give_back()


def _unpack(row: dict) -> list[np.ndarray]:
    lens = np.frombuffer(row["lens"], np.int32)
    return np.split(np.frombuffer(row["keys"], np.uint64), np.cumsum(lens)[:-1])


def _ask_all(buckets: int):
    def f(row: dict) -> list[tuple]:
        key, count, low = _held(*_flat(_unpack(row), row["sets"]))
        return B.asks(row["block"], key, count, low, buckets)

    return f


#: Asks of the cells, edges within the block (bucket -1: keys are ends a, low ends b),
#: and the mean rarity of each set (bucket -2), by which pivots are chosen.
def _to_cells(buckets: int):
    def f(row: dict, found) -> list[tuple]:
        sets, names = _unpack(row), row["sets"]
        every = np.unique(np.concatenate(sets))
        cells, central = [], []
        for s in sets:
            df = found[0][np.searchsorted(every, s)]
            order = np.lexsort((s, df))[: _lacking(len(s)) + 1]
            cells.append(s[order][df[order] > 1])
            central.append(float(np.log(df).mean()))
        keys, owner = _flat(cells, names)
        key, _, low = _held(keys, owner)
        near = low[np.searchsorted(key, keys)] if len(keys) else owner
        pairs = np.unique(np.stack([owner, near], 1)[owner != near], axis=0)
        return B.asks(row["block"], key, np.ones(len(key)), low, buckets) + [
            (row["block"], -1, pairs[:, 0].tobytes(), b"", pairs[:, 1].tobytes()),
            (row["block"], -2, np.array(names, np.int64).tobytes(), b"", np.array(central).tobytes())]

    return f


EDGE = "a long, b long"


def _pairs_table(schema: str, a: np.ndarray, b: np.ndarray) -> pa.Table:
    (x, _), (y, kind) = (f.split() for f in schema.split(", "))
    return pa.table({x: pa.array(a, pa.int64()), y: pa.array(b, pa.int64() if kind == "long" else pa.float64())})


def _meet(t: pa.Table) -> pa.Table:
    """Edges between the blocks' representatives of a cell."""
    if t.column("bucket")[0].as_py() < 0:
        a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("keys", "low"))
        return _pairs_table(EDGE, a, b)
    sent = np.frombuffer(b"".join(t.column("low").to_pylist()), np.int64)
    _, _, low, index, _ = B.totals(t)
    pairs = np.unique(np.stack([sent, low[index]], 1)[sent != low[index]], axis=0)
    return _pairs_table(EDGE, pairs[:, 0], pairs[:, 1])


def _centre(t: pa.Table) -> pa.Table:
    names = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64)
    return _pairs_table("set long, central double", names, np.frombuffer(b"".join(t.column("low").to_pylist()), np.float64))


# ---- the join of one region ----------------------------------------------------------


class Region:
    """Sets of a region, their links so far, and distances between them, by an index from
    shingles to the sets that have them."""

    def __init__(self, names: list[int], sets: list[np.ndarray], central: list[float]):
        self.names, self.central = np.array(names, np.int64), np.array(central)
        self.n = np.array([len(s) for s in sets], np.int64)
        self.least = int(self.n.min())
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.owner = owner[order]
        self.first = np.flatnonzero(new)  # of each shingle's sets in owner
        self.df = np.diff(np.append(self.first, len(keys)))
        ids = np.empty(len(keys), np.int32)
        ids[order] = np.cumsum(new) - 1
        self.sets = np.split(ids, np.cumsum(self.n)[:-1])  # shingles by their number
        self.mark = np.zeros(len(self.first), bool)
        self.done = np.zeros(len(sets), bool)  # was a pivot: all its links are known
        self.root = np.arange(len(sets))  # the component of each set, by one of its sets
        self.links: list[tuple[int, int]] = []

    def _having(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets that have any of these shingles, and how many."""
        size = self.df[ids]
        met = self.owner[np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        if 8 * len(met) < len(self.sets):
            return np.unique(met, return_counts=True)
        has = np.bincount(met)
        met = np.flatnonzero(has)
        return met, has[met]

    def _link(self, pivot: int, near: np.ndarray) -> None:
        """Sets that link with a pivot join its component."""
        for r, i in zip(*np.unique(self.root[near], return_index=True)):
            if r != self.root[pivot]:
                self.links.append((int(self.names[near[i]]), int(self.names[pivot])))
                self.root[self.root == r] = self.root[pivot]

    def distances(self, pivot: int) -> np.ndarray:
        """Of a pivot to all sets; what is near joins its component."""
        self.done[pivot] = True
        common = np.zeros(len(self.sets), np.int64)
        met, has = self._having(self.sets[pivot])
        common[met] = has
        union = self.n[pivot] + self.n - common
        self._link(pivot, np.flatnonzero(100 * common >= 80 * union))
        return 1 - common / union

    def search(self, pivot: int) -> None:
        """Links a pivot with sets outside its component. Sets of n and m shingles that link
        have at least 4 (n + m) / 9 in common; so of any k of the pivot's, a linked set
        has all but n - 4 (n + m) / 9. Looked at are so many of the rarest that each linked
        set has one, and more while they are cheap; only sets with enough are compared."""
        self.done[pivot] = True
        ids = self.sets[pivot]
        n = len(ids)
        ids = ids[np.argsort(self.df[ids], kind="stable")]
        least = -(-4 * (n + max(self.least, -(-4 * n // 5))) // 9)
        cheap = np.searchsorted(np.cumsum(self.df[ids]), POSTINGS, side="right")
        k = min(n, max(n - least + 1, int(cheap)))
        met, has = self._having(ids[:k])
        needed = k - n - (-4 * (n + self.n[met]) // 9)
        left = met[(has >= needed) & (self.root[met] != self.root[pivot])]
        self.mark[ids] = True
        while len(left):
            some, left = left[:256], left[256:]
            common = np.add.reduceat(self.mark[np.concatenate([self.sets[i] for i in some])], np.cumsum(self.n[some]) - self.n[some], dtype=np.int64)
            self._link(pivot, some[100 * common >= 80 * (n + self.n[some] - common)])
            left = left[self.root[left] != self.root[pivot]]
        self.mark[ids] = False

    def join(self) -> list[tuple[int, int]]:
        self._join(np.arange(len(self.sets)))
        return self.links

    def _join(self, among: np.ndarray) -> None:
        if len(among) <= LEAF:
            return self._leaf(among)
        by_centre = among[np.argsort(-self.central[among], kind="stable")]
        step = max(1, len(among) // PIVOTS)
        pivots = np.unique(np.concatenate((by_centre[: PIVOTS // 2], by_centre[step // 2 :: step])))
        d = np.stack([self.distances(int(p))[among] for p in pivots])
        open_in = lambda part: len(part) > 1 and (self.root[part] != self.root[part[0]]).any()
        parts = [among[cell] for cell in cells_of(d) if open_in(among[cell])]
        if sum(len(p) ** 2 for p in parts) > PAYS * len(among) ** 2:
            return self._leaf(among)
        for part in parts:
            if open_in(part):
                self._join(part)

    def _leaf(self, among: np.ndarray) -> None:
        """Sets outside one component, the largest at the start, are pivots, the most
        central first: a set is passed over only while it is in that component, and two
        sets of different components are not both in it, so each link is seen from one end."""
        order = among[np.argsort(-self.central[among], kind="stable")]
        names, at, sizes = np.unique(self.root[order], return_index=True, return_counts=True)
        fixed = order[at[sizes.argmax()]]  # stays in its component, whatever that is called later
        while True:
            left = order[~self.done[order] & (self.root[order] != self.root[fixed])]
            if not len(left):
                return
            for p in left[:32].tolist():
                self.search(p)


def cells_of(d: np.ndarray) -> list[np.ndarray]:
    """Members of each pivot's cell and of the far cell. d: distances, pivots by sets.
    A set is at home with its nearest pivot if that is nearer than FAR, else far away.
    It enters another cell if its distance there is below 1 and at most WIDE above that
    to its own pivot, and the far cell if it is at least FAR - NEAR from its own."""
    own, best = d.argmin(0), d.min(0)
    home = best < FAR
    out = [np.flatnonzero(home & (own == i) | (d[i] < 1) & (d[i] <= best + WIDE)) for i in range(len(d))]
    return [*out, np.flatnonzero(best >= FAR - NEAR)]


def _join_region(t: pa.Table) -> pa.Table:
    r = Region(t.column("set").to_pylist(), [np.frombuffer(b, np.uint64) for b in t.column("keys").to_pylist()], t.column("central").to_pylist())
    links = np.array(r.join(), np.int64).reshape(-1, 2)
    return _pairs_table(EDGE, links[:, 0], links[:, 1])


PLACED = "region long, cell int, set long, d double, link long"


def _place(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Distances of some of a large region's sets to its pivots: links and cells."""
    order = np.argsort(pivots.column("set").to_pylist())
    names = [pivots.column("set")[int(i)].as_py() for i in order]
    keys = [np.frombuffer(pivots.column("keys")[int(i)].as_py(), np.uint64) for i in order]
    out = []
    for region, name, raw in zip(*(rows.column(c).to_pylist() for c in ("region", "set", "keys"))):
        s = np.frombuffer(raw, np.uint64)
        common = np.array([np.isin(s, p, assume_unique=True).sum() for p in keys])
        union = len(s) + np.array([len(p) for p in keys]) - common
        near = np.flatnonzero(100 * common >= 80 * union)
        d = (1 - common / union)[:, None]
        link = names[near[0]] if len(near) else name  # told once
        for cell, members in enumerate(cells_of(d)):
            if len(members):
                out.append((region, cell, name, float(d[cell, 0]) if cell < len(d) else 1.0, link))
                link = name
    return B.table(PLACED, out)


def _split(rows: DataFrame, large: DataFrame, found: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Large regions (region, set, n, keys, central) by the cells of their pivots, each
    region dealt over as many tasks as it has REGION_SHINGLES. What a pivot has linked
    stays only if a set outside may still link with it. Returns the cells, as regions, and,
    as they are, the regions whose cells would have too many pairs."""
    tasks = large.select("region", F.ceil(F.col("__n") / REGION_SHINGLES).cast("int").alias("tasks"))
    tasks = F.broadcast(tasks) if tasks.count() <= BROADCAST_ROWS else tasks
    few = rows.groupBy("region").agg(
        F.min_by("set", F.xxhash64("set")).alias("some"), F.max_by("set", F.struct("central", "set")).alias("top"),
        *[F.min_by("set", F.xxhash64(F.lit(k), "set")).alias(f"p{k}") for k in range(PIVOTS // 2)])
    picked = few.select("region", F.explode(F.array_distinct(F.array("some", "top", *[f"p{k}" for k in range(PIVOTS // 2)]))).alias("set"))
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    pivots = rows.join(picked, ["region", "set"]).select("region", "set", "keys").join(tasks, "region")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    pivots = pivots.select(*[F.col(c).alias(c) for c in pivots.columns])  # columns of their own, apart from those of rows
    parts = rows.select("region", "set", "keys").join(tasks, "region").withColumn("part", F.pmod(F.xxhash64("set"), F.col("tasks")).cast("int")).drop("tasks")
    placed = checkpointed(parts.groupBy("region", "part").cogroup(pivots.groupBy("region", "part")).applyInArrow(_place, PLACED))
    found.append(placed.filter("set <> link").select(F.col("set").alias("a"), F.col("link").alias("b")))
    open_at = placed.groupBy("region", "cell").agg(F.min(F.when(F.col("d") > NEAR, F.col("d"))).alias("out"))
    open_at = F.broadcast(open_at) if open_at.count() <= BROADCAST_ROWS else open_at
    left = placed.join(open_at, ["region", "cell"]).filter(F.col("out").isNotNull() & ((F.col("d") > NEAR) | (F.col("d") >= F.col("out") - NEAR - 1e-9)))
    left = left.select("region", "set", F.xxhash64("region", "cell").alias("next"))
    pairs = left.groupBy("region", "next").agg(F.count("*").cast("double").alias("c")).groupBy("region").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    tight = checkpointed(pairs.join(large, "region").filter(F.col("pairs") > PAYS * F.col("__c") * F.col("__c")).select("region"))
    left = left.join(F.broadcast(tight), "region", "left_anti")
    cells = checkpointed(left.join(rows, ["region", "set"]).select(F.col("next").alias("region"), "set", "n", "keys", "central"))
    return cells, rows.join(F.broadcast(tight), "region", "left_semi")


def _by_parts(rows: DataFrame) -> DataFrame:
    """Regions that pivots can't split, as pairs of parts small enough for one task:
    each part meets each other part of its region."""
    size = rows.groupBy("region").agg(F.ceil(F.sum("n") / (REGION_SHINGLES / 2)).cast("int").alias("parts"))
    x = rows.join(F.broadcast(size) if size.count() <= BROADCAST_ROWS else size, "region")
    x = x.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("region", F.least("part", "other"), F.greatest("part", "other"))
    return x.select(key.alias("region"), "set", "n", "keys", "central")


def _links(rows: DataFrame) -> DataFrame:
    """Links between the sets of each region (region, set, n, keys, central)."""
    found: list[DataFrame] = []
    small = lambda x, large: x.join(F.broadcast(large.select("region")), "region", "left_anti")
    leaves: list[DataFrame] = []
    for left in range(SPLITS, -1, -1):
        # at most the total over REGION_SHINGLES regions are large
        large = checkpointed(rows.groupBy("region").agg(F.sum("n").alias("__n"), F.count("*").alias("__c")).filter(f"__n > {REGION_SHINGLES} and __c > 2"))
        if large.isEmpty():
            leaves.append(rows)
            break
        leaves.append(small(rows, large))
        rows = rows.join(F.broadcast(large.select("region")), "region", "left_semi")
        if left:
            rows, tight = _split(rows, large, found)
            leaves.append(_by_parts(tight))
        else:
            leaves.append(_by_parts(rows))
    for x in leaves:
        found.append(x.groupBy("region").applyInArrow(_join_region, EDGE))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of every row. component_id is the
    smallest doc_id that links reach; class_id that of the rows with the same set."""
    spark = docs.sparkSession
    blocks = B.token_blocks(docs, True, doc_id, text)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    info = checkpointed(B.each_block(blocks, _info, INFO))
    # 1. cells of single shingles
    buckets = B.buckets_for(tokens // 3, spark)
    stands = info.filter("n > 0").groupBy("set").agg(F.min(F.struct("block", "place")).alias("k")).select("k.block", "k.place")
    stands = checkpointed(stands.groupBy("block").applyInArrow(_chosen, B.ANSWER))
    first = _beside(blocks, stands, _ask_first(buckets), B.ASK).groupBy("bucket").applyInArrow(_shared, B.ANSWER)
    kept = _beside(blocks, stands.unionByName(first), _survivors, SETS)
    packs = dealt(kept.mapInArrow(_pack, PACK), "block")
    del first, kept, blocks
    release(spark)
    many = packs.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = B.buckets_for(many // 8, spark)
    rarity = B.answers(B.each_block(packs, _ask_all(buckets), B.ASK))
    sent = checkpointed(B.with_answers(packs, rarity, _to_cells(buckets), B.ASK))
    meet = sent.filter("bucket <> -2").withColumn("bucket", F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("block"), F.lit(buckets))).cast("int"))
    regions = checkpointed(components(meet.groupBy("bucket").applyInArrow(_meet, EDGE)))
    # 2. pivots that are documents
    centre = sent.filter("bucket = -2").groupBy("block").applyInArrow(_centre, "set long, central double")
    flat = B.each_block(packs, lambda row: [(name, len(s), s.tobytes()) for name, s in zip(row["sets"], _unpack(row))], SETS)
    named = regions.select(F.col("node").alias("set"), F.col("root").alias("region")).join(centre, "set")
    release(spark)
    rows = checkpointed(flat.join(named, "set").select("region", "set", "n", "keys", "central"))
    links = checkpointed(_links(rows))
    roots = components(links).select(F.col("node").alias("set"), "root")
    # each class with its smallest doc_id, each component with that of its classes
    classes = checkpointed(info.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("__n")))
    linked = classes.join(roots, "set")
    least = linked.groupBy("root").agg(F.min("class_id").alias("component_id"))
    whole = classes.join(linked.join(least, "root").select("set", "component_id"), "set", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    out = join_hot(info, checkpointed(whole), ["set"], "__n")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with exactly one row of each component: the smallest doc_id's, a
    null one last. A row is known by a hash of doc_id and text; of rows that are equal in
    both, any one stays. Rows without words are in no component and all stay."""
    work, names = own_names(docs)
    row = F.xxhash64(names[doc_id], names[text])
    rows = work.select(row.alias("row"), F.col(names[doc_id]).alias("id"), F.col(names[text]).alias("text"))
    found = near_duplicates(rows, "row").filter("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))
    found = found.groupBy("row", "root").agg(F.count("*").alias("n"))
    found = checkpointed(found.join(rows.select("row", "id").distinct(), "row"))
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("s"), F.count("*").alias("rows")).filter("rows > 1").select("root", F.col("s.row").alias("stays"))
    gone = checkpointed(found.join(stays, "root").filter("row <> stays").select("row").distinct())
    again = checkpointed(found.filter("n > 1").select("row").distinct().join(gone, "row", "left_anti"))
    out = work.withColumn("row", row).join(small(gone), "row", "left_anti")
    if not again.isEmpty():
        again = small(again)
        out = out.join(again, "row", "left_anti").unionByName(out.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return out.drop("row").toDF(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
