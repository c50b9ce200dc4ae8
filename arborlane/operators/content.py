"""Content addressing: canonical keys, copies, chunk accounting, eviction, chunk bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def field(name: str, value: Column) -> Column:
    """name NUL length NUL value NUL, the length in bytes."""
    nul = F.chr(F.lit(0))
    return F.concat(F.lit(name), nul, F.octet_length(value).cast("string"), nul, value, nul)


def key_digest(*fields: tuple[str, Column]) -> Column:
    """The SHA-256 of the fields in the order given."""
    return F.sha2(F.concat(*[field(n, v) for n, v in fields]), 256)


def chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Chunks of ``size`` characters: key, seq, offset, length, chunk."""
    n = F.ceil(F.length(text) / size).cast("int")
    x = rows.select(key, text, F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).alias("seq", "chunk"))
    return x.select(key, "seq", (F.col("seq") * size).cast("long").alias("offset"), F.length("chunk").cast("long").alias("length"), "chunk")


def reuse(refs: DataFrame, digest: str, size: str) -> DataFrame:
    """Counts and bytes referenced and distinct, and the share of bytes reused."""
    one = refs.groupBy(digest).agg(F.count("*").alias("n"), F.max(size).alias("b"))
    x = one.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("logical_count"), F.coalesce(F.sum(F.col("n") * F.col("b")), F.lit(0)).cast("long").alias("logical_bytes"),
                F.count("*").alias("unique_count"), F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("unique_bytes"))
    return x.withColumn("reuse", F.round(F.coalesce(F.try_divide((F.col("logical_bytes") - F.col("unique_bytes")).cast("double"), F.col("logical_bytes")), F.lit(0.0)), 6))


def evicted(blobs: DataFrame, pool: str, age: str, key: str, size: str, cap: int) -> DataFrame:
    """Of each pool, what goes when the newest up to ``cap`` bytes stay."""
    w = W.partitionBy(pool).orderBy(F.desc(age), F.desc(key)).rowsBetween(W.unboundedPreceding, 0)
    return blobs.withColumn("__sum", F.sum(size).over(w)).filter(F.col("__sum") > cap).drop("__sum")


def sketch(rows: DataFrame, key: str, chunk: str, k: int = 8) -> DataFrame:
    """(key, h): the k smallest hashes of a row's chunks."""
    h = F.substring(F.sha2(F.col(chunk), 256), 1, 16)
    return rows.groupBy(key).agg(F.slice(F.array_sort(F.collect_set(h)), 1, k).alias("s")).select(key, F.explode("s").alias("h"))


def gear_table(seed: int = 20240607) -> np.ndarray:
    """256 random 64-bit numbers, one for each byte."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64, endpoint=False)


def boundaries(data: bytes, average: int, gear: np.ndarray, normal: int = 2) -> list[tuple[int, int]]:
    """Content-defined chunks (offset, length) of at least average / 4 and at most four
    averages: a cut where a rolling hash of the last 64 bytes has enough leading zeros,
    more of them before the average than after. The hash at a place is a sum over the 64
    bytes before it, so all places are computed at once by doubling; cuts are then picked."""
    n, bits = len(data), average.bit_length() - 1
    if average != 1 << bits or bits < normal + 5:
        raise ValueError("average must be a power of two, 2 ** (normal + 5) at least")
    low, high = average // 4, average * 4
    if n <= low:
        return [(0, n)] if n else []
    h = gear[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 64:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint64(width)
        h = h + moved
        width *= 2
    strict = np.flatnonzero(h >> np.uint64(64 - bits - normal) == 0)
    loose = np.flatnonzero(h >> np.uint64(64 - bits + normal) == 0)
    out, at = [], 0
    while at < n:
        if n - at <= low:
            end = n
        else:
            mid, last = min(at + average, n), min(at + high, n)
            i = np.searchsorted(strict, at + low)
            end = int(strict[i]) + 1 if i < len(strict) and strict[i] < mid else 0
            if not end:
                j = np.searchsorted(loose, mid)
                end = int(loose[j]) + 1 if j < len(loose) and loose[j] < last else last
        out.append((at, end - at))
        at = end
    return out


#: Rows that Spark hands to Python at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def content_chunks(rows: DataFrame, key: str, text: str, average: int = 256) -> DataFrame:
    """(key, seq, offset, length, digest) of the content-defined chunks of each text."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        for x in (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32)):
            out: dict[str, list] = {"key": [], "seq": [], "offset": [], "length": [], "digest": []}
            for k, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                data = (t or "").encode()
                for i, (at, n) in enumerate(boundaries(data, average, gear)):
                    for c, v in zip(out, (k, i, at, n, hashlib.sha256(data[at : at + n]).hexdigest())):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("seq", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]))

    # Few texts at a time: a batch of the usual 10,000 holds as much as its texts are long.
    conf = rows.sparkSession.conf
    conf.set(BATCH_ROWS, min(int(conf.get(BATCH_ROWS)) or 256, 256))
    found = rows.select(F.col(key).cast("long"), text).mapInArrow(run, "key long, seq int, offset long, length long, digest string")
    return found.withColumnRenamed("key", key)


def best_base(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """For each chunk of new the chunk of old (same key) with the largest overlap of
    places; of equal ones the last. Chunks have one size at most in old, so a chunk meets
    only the few of its key that its ends fall into."""
    o = old.select(key, F.col("seq").alias("base"), F.col("offset").alias("bo"), F.col("length").alias("bl"))
    x = new.join(o, key).filter((F.col("bo") < F.col("offset") + F.col("length")) & (F.col("offset") < F.col("bo") + F.col("bl")))
    overlap = F.least(F.col("offset") + F.col("length"), F.col("bo") + F.col("bl")) - F.greatest("offset", "bo")
    return x.groupBy(key, "seq").agg(F.max(F.struct(overlap.alias("overlap"), "base")).alias("m")).select(key, "seq", "m.base", "m.overlap")
