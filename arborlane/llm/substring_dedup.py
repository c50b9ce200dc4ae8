"""Repeated passages by recompression.

Each block's words are named by hash, so that a name means the same everywhere. Rounds
then name runs of a symbol (every third round), and pairs whose first symbol falls in one half of the
alphabet and whose second in the other (a bit of the symbols' hashes, another one each
round): equal texts get equal symbols, but for a margin at their ends. A symbol is kept
with the words that decided it, so a symbol whose deciding words lie inside a window is
the same wherever that window occurs. The anchor of a window is the highest-level symbol
decided inside it (ties: smallest name): equal windows have equal anchors.

Blocks exchange the anchors. Windows whose anchor is in one document only are unique;
the others exchange a key of all their words and learn the smallest doc_id that has
that window. So nothing is lost by hot passages, runs or copies, and what is shuffled
is one record for a key and block.

Naming is by 64-bit hashes instead of a table of names: it is the same in all tasks
without a round of communication. Rounds are thus local to a block; the rounds that
Spark runs are the two exchanges.

Defined cases: a null text has no words; documents with fewer words than a window are
left as they are; rows of equal doc_id are one document for the rule "smaller doc_id";
a null doc_id counts as larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm import blocks as B
from arborlane.llm.common import dealt, release

WINDOW = 50
ROUNDS = 9
OUT = "doc_id long, n_words long, n_removed long, kept string"
NONE = np.iinfo(np.int64).max


def symbols(tokens: np.ndarray, starts: np.ndarray, window: int, rounds: int = ROUNDS):
    """Symbols of all levels whose deciding words fit in a window: arrays of level,
    name, first deciding word, end of the deciding words.

    A pair is decided by what decided its two symbols; a symbol that stays alone also by
    the neighbour that could have joined it, and a run by both neighbours. A symbol that
    only the end of its document has kept alone is decided by no words of a window."""
    n = len(tokens)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    name, lo, hi, first = tokens, np.arange(n), np.arange(n) + 1, edge[:-1].copy()
    found = [(np.zeros(n, np.int8), name, lo, hi)]
    far = np.int64(4 * window)
    passes = [(r, runs) for r in range(1, rounds + 1) for runs in ((True, False) if r % 3 == 1 else (False,))]
    for level, (r, runs) in enumerate(passes, 1):
        m = len(name)
        if m < 2:
            break
        bit = (B.mixed(name ^ np.uint64(r * 0x9E37)) & np.uint64(1)).astype(bool)
        join = (name[1:] == name[:-1]) if runs else ~bit[:-1] & bit[1:]
        at = np.flatnonzero(np.concatenate(([True], ~join | first[1:])))
        end = np.concatenate((at[1:], [m])) - 1
        size = end - at + 1
        both = name[at] * np.uint64(0xD6E8FEB86659FD93) + (size.astype(np.uint64) if runs else name[end]) + np.uint64(level)
        new = np.where(size > 1, B.mixed(both), name[at])
        # What decided the parts decides the symbol; so do neighbours that could have joined.
        nlo, nhi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        last = np.concatenate((first[1:], [True]))[end]
        by_left = np.ones(len(at), bool) if runs else (size == 1) & bit[at]
        by_right = np.ones(len(at), bool) if runs else (size == 1) & ~bit[at]
        left, right = np.maximum(at - 1, 0), np.minimum(end + 1, m - 1)
        for need, at_edge, other in ((by_left, first[at], left), (by_right, last, right)):
            near = need & ~at_edge
            nlo = np.where(near, np.minimum(nlo, lo[other]), nlo)
            nhi = np.where(near, np.maximum(nhi, hi[other]), nhi)
            nhi = np.where(need & at_edge, nhi + far, nhi)
        name, lo, hi, first = new, nlo, nhi, first[at]
        ok = hi - lo <= window
        found.append((np.full(int(ok.sum()), level, np.int8), name[ok], lo[ok], hi[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def anchors(tokens: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window, the name of its anchor. Symbols claim the windows
    that hold their deciding words, from the highest level and the smallest name on."""
    n = len(tokens)
    level, name, lo, hi = symbols(tokens, starts, window)
    out = np.zeros(max(0, n - window + 1), np.uint64)
    if not len(out):
        return out
    free = np.ones(len(out), bool)
    open_before = np.arange(len(out) + 1)
    for lev in np.unique(level)[::-1]:
        pick = np.flatnonzero(level == lev)
        begin, end = np.maximum(hi[pick] - window, 0), np.minimum(lo[pick], len(out) - 1)
        ok = (begin <= end) & (open_before[np.maximum(end, begin - 1) + 1] > open_before[begin])
        pick, begin, end = pick[ok], begin[ok], end[ok]
        if not len(pick):
            continue
        size = end - begin + 1
        cell = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        who = np.repeat(name[pick], size)
        keep = free[cell]
        cell, who = cell[keep], who[keep]
        best = np.full(len(out), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(best, cell, who)
        out[cell] = best[cell]
        free[cell] = False
        open_before = np.concatenate(([0], np.cumsum(free)))
        if not open_before[-1]:
            break
    return out


def _windows(x: B.Block, window: int):
    """Starts of the block's windows (each within one document), their anchors, and the
    document of each window."""
    keys = B.word_keys(x.words)
    tokens = keys[x.codes] if len(x.codes) else np.zeros(0, np.uint64)
    starts = x.starts
    doc = np.repeat(np.arange(len(x.lens)), np.maximum(x.lens - window + 1, 0))
    offset = np.concatenate(([0], np.cumsum(np.maximum(x.lens - window + 1, 0))))
    at = starts[doc] + np.arange(len(doc)) - offset[doc]
    named = anchors(tokens, starts[:-1][x.lens > 0], window)
    return tokens, at, named[at] if len(at) else np.zeros(0, np.uint64), doc


def _ids(x: B.Block) -> np.ndarray:
    return np.array([NONE if i is None else i for i in x.ids], np.int64)


def _once(key: np.ndarray, who: np.ndarray):
    """Distinct keys, the number of documents that have each, and the smallest of them."""
    if len(key):  # neighbours are often equal
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])))
        key, who = key[new], who[new]
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    fresh = new | np.concatenate(([True], who[1:] != who[:-1])) if len(key) else new
    first = np.flatnonzero(new)
    count = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else first
    return key[first], count, who[first]


def _ask_anchors(window: int, buckets: int):
    def f(row: dict) -> list[tuple]:
        x = B.read_block(row)
        _, _, named, doc = _windows(x, window)
        key, count, low = _once(named, _ids(x)[doc])
        return B.asks(x.block, key, count, low, buckets)

    return f


def _live(x: B.Block, window: int, found) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose anchor is in more than one document, and their keys."""
    tokens, at, named, doc = _windows(x, window)
    key = np.unique(named)
    live = found[0][np.searchsorted(key, named)] > 1 if len(named) else np.zeros(0, bool)
    at, doc = at[live], doc[live]
    every = B.sequence_keys(tokens, window)
    return at, doc, every[at] if len(at) else np.zeros(0, np.uint64), tokens


def _ask_windows(window: int):
    def f(row: dict, found) -> list[tuple]:
        x = B.read_block(row)
        at, doc, keys, _ = _live(x, window, found)
        return [(row["block"], B.packed(at), B.packed(doc.astype(np.int32)), keys.tobytes(), row["ids"])]

    return f


def _send_windows(buckets: int):
    def f(row: dict) -> list[tuple]:
        keys, doc = np.frombuffer(row["keys"], np.uint64), B.unpacked(row["doc"], np.int32)
        key, _, low = _once(keys, _doc_ids(row)[doc])
        return [(*r[:3], b"", r[4]) for r in B.asks(row["block"], key, np.zeros(len(key)), low, buckets)]

    return f


def _lower(t: pa.Table) -> pa.Table:
    """Of a bucket's windows: 1 where another block has a smaller document than the asking
    one. What else is to know of a window, its block knows by itself."""
    keys, low = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("keys", np.uint64), ("low", np.int64)))
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    least = np.empty(len(keys), np.int64)
    least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    other = (least < low).astype(np.uint8)
    rows, at = [], 0
    for block, bucket, k in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), t.column("keys").to_pylist()):
        n = len(k) // 8
        rows.append((block, bucket, other[at : at + n].tobytes(), b""))
        at += n
    return B.table(B.ANSWER, rows)


def _marked(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a block: the starts of the windows that a smaller doc_id also has."""
    other = np.frombuffer(b"".join(right.sort_by("bucket").column("count").to_pylist()), np.uint8)
    rows = []
    for row in left.to_pylist():
        keys, doc = np.frombuffer(row["keys"], np.uint64), B.unpacked(row["doc"], np.int32)
        ids = _doc_ids(row)[doc]
        key, _, low = _once(keys, ids)
        at = np.searchsorted(key, keys)
        gone = (other[at] > 0) | (low[at] < ids) if len(keys) else np.zeros(0, bool)
        rows.append((row["block"], 0, B.unpacked(row["at"], np.int64)[gone].tobytes(), b""))
    return B.table(B.ANSWER, rows)


def _doc_ids(row: dict) -> np.ndarray:
    return np.array([NONE if i is None else i for i in row["ids"]], np.int64)


def _cut(window: int, digest: bool):
    def f(row: dict, at: np.ndarray) -> list[tuple]:
        x = B.read_block(row)
        change = np.zeros(len(x.codes) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        keep = np.cumsum(change[:-1]) == 0
        words = np.array(x.words, object)
        out, starts = [], x.starts
        for i, doc in enumerate(x.ids):
            part = keep[starts[i] : starts[i + 1]]
            text = b" ".join(words[x.codes[starts[i] : starts[i + 1]][part]]) if len(part) else b""
            out.append((doc, len(part), int(len(part) - part.sum()), hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "surrogatepass")))
        return out

    return f


def without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space (or, with
    digest, their SHA-256), of every row."""
    spark = docs.sparkSession
    blocks = B.token_blocks(docs, False, doc_id, text)
    n = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = B.buckets_for(n // 8, spark)
    asked = B.each_block(blocks, _ask_anchors(window, buckets), B.ASK)
    live = dealt(B.with_answers(blocks, B.answers(asked), _ask_windows(window), "block long, at binary, doc binary, keys binary, ids array<long>"), "block")
    del asked
    release(spark)
    many = live.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = B.buckets_for(many // 8, spark)
    told = B.each_block(live, _send_windows(buckets), B.ASK).groupBy("bucket").applyInArrow(_lower, B.ANSWER)
    marks = live.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_marked, B.ANSWER)
    cut = _cut(window, digest)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(right.column("count").to_pylist()), np.int64)
        return B.table(OUT, [r for row in left.to_pylist() for r in cut(row, at)])

    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, OUT)


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
