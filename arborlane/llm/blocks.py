"""Token blocks and the exchange of keys between them.

A block holds some documents as a list of distinct words and, for each document, the
codes of its words: a lossless, compact form of all words of the texts. Blocks are
written once to the shared folder, dealt by block number, and stay where they are.

Operators that compare documents send only keys (64-bit hashes of words, shingles,
windows) with a number or two: each block sends a key once, however many of its
documents have it, so that a key which a third of all rows share costs one record for
each block. Keys are dealt to buckets by their leading bits, a bucket totals its keys,
and each block gets the totals of its keys back in the order in which it sent them.

64-bit keys: among n distinct keys, about n * n / 2^65 pairs collide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm.common import dealt, give_back, partitions, release, small_batches

#: A block closes at this many bytes of text or documents; one document is never split.
BLOCK_BYTES, BLOCK_DOCS = 1_500_000, 2_000

#: Keys that one bucket totals at a time.
BUCKET_KEYS = 400_000

BLOCK = "block long, n_tokens long, ids array<long>, lens binary, words binary, codes binary"
ASK = "block long, bucket int, keys binary, count binary, low binary"
ANSWER = "block long, bucket int, count binary, low binary"


class Block(NamedTuple):
    block: int
    ids: list[int | None]
    lens: np.ndarray
    words: list[bytes]
    codes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lens))).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpacked(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a record batch of a DDL schema of flat fields and lists of longs."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(schema, rows)])


def _make(lower: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        lens: list[int] = []
        vocabulary: dict[bytes, int] = {}
        codes: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            row = (number, len(flat), list(ids), packed(np.array(lens, np.int32)), zstandard.compress(b"\n".join(vocabulary), 1), packed(flat.astype(np.uint16 if len(vocabulary) <= 1 << 16 else np.int32)))
            ids.clear(), lens.clear(), vocabulary.clear(), codes.clear()
            return batch(BLOCK, [row])

        for x in batches:
            for doc, text in zip(x.column(0).to_pylist(), x.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = (raw.lower() if lower else raw).split()
                codes.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
                ids.append(doc), lens.append(len(words))
                size += len(raw)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield closed()
                    number, size = number + 1, 0
        if ids:
            yield closed()
        give_back()

    return run


def token_blocks(docs: DataFrame, lower: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of all rows of docs. A null text has no words; a null id stays null.
    Words are split at the six ASCII white-space characters, which bytes.split() does."""
    spark = docs.sparkSession
    small_batches(spark)
    out = dealt(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_make(lower), BLOCK), "block")
    release(spark)
    return out


def read_block(row: dict) -> Block:
    joined = zstandard.decompress(row["words"])
    words = joined.split(b"\n") if joined else []
    codes = unpacked(row["codes"], np.uint16 if len(words) <= 1 << 16 else np.int32).astype(np.int32)
    return Block(row["block"], row["ids"], unpacked(row["lens"], np.int32), words, codes)


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_keys(tokens: np.ndarray, width: int) -> np.ndarray:
    """A key for each run of width tokens: a polynomial of the tokens' keys, by doubling."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    power, length, out, done = tokens, 1, None, 0
    while width:
        if width & 1:
            if out is None:
                out, done = power, length
            else:
                m = min(len(out), len(power) - done)
                out = out[:m] * np.uint64(pow(base, length, 1 << 64)) + power[done : done + m]
                done += length
        width >>= 1
        if width:
            power = power[:-length] * np.uint64(pow(base, length, 1 << 64)) + power[length:]
            length *= 2
    return mixed(out[:n])


def numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the smallest type that holds all of them, which leads."""
    top = int(x.max(initial=0))
    kind = next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(d).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def read_numbers(parts: list[bytes]) -> np.ndarray:
    """The numbers of all parts, one after another."""
    found = [np.frombuffer(b, f"u{b[0]}", offset=1) for b in parts if b]
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def buckets_for(keys: int, spark) -> int:
    return max(partitions(spark), -(-keys // BUCKET_KEYS))


def asks(block: int, keys: np.ndarray, count: np.ndarray, low: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of ASK for a block. keys: sorted, distinct."""
    if not len(keys):
        return []
    at = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at)) + 1
    low = low.astype(np.int64)
    return [(block, int(at[i]), keys[i:j].tobytes(), numbers(count[i:j]), low[i:j].tobytes()) for i, j in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)])))]


def totals(t: pa.Table, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the asks of one bucket: distinct keys, their counts and lows, then for each
    key sent the index of its key, and the numbers of keys of the asks."""
    keys, sent = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("keys", np.uint64), ("low", np.int64)))
    count = read_numbers(t.column("count").to_pylist())
    low = sent if low is None else low
    sizes = np.array([len(b) // 8 for b in t.column("keys").to_pylist()])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    index = np.empty(len(keys), np.int64)
    index[order] = np.cumsum(np.concatenate(([False], keys[order][1:] != keys[order][:-1])))
    return keys[order][first], np.add.reduceat(count[order], first), np.minimum.reduceat(low[order], first), index, sizes


def _answer(t: pa.Table) -> pa.Table:
    _, count, low, index, sizes = totals(t)
    count, low = count[index], low[index]
    rows, at = [], 0
    for block, bucket, n in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), sizes):
        rows.append((block, bucket, numbers(count[at : at + n]), low[at : at + n].tobytes()))
        at += n
    return table(ANSWER, rows)


def answers(asked: DataFrame) -> DataFrame:
    """The asks' keys, answered: total count and lowest low of all blocks."""
    return asked.groupBy("bucket").applyInArrow(_answer, ANSWER)


def answered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers, in the order of its sorted keys."""
    t = t.sort_by("bucket")
    return read_numbers(t.column("count").to_pylist()), np.frombuffer(b"".join(t.column("low").to_pylist()), np.int64)


def with_answers(blocks: DataFrame, answer: DataFrame, f: Callable[[dict, tuple[np.ndarray, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """f(block row, answers) for each block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = answered(right)
        return table(schema, [r for row in left.to_pylist() for r in f(row, found)])

    return blocks.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(run, schema)


def each_block(blocks: DataFrame, f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """f(block row) for each block, one block in memory at a time."""

    def run(t: pa.Table) -> pa.Table:
        return table(schema, [r for row in t.to_pylist() for r in f(row)])

    return blocks.groupBy("block").applyInArrow(run, schema)
