"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms: the shapes of its words (letters by case, digits, and other
characters as they are, runs shortened), the endings of words hashed to a fixed number
of terms, and how often words follow themselves or come again. Bags of a bounded sample
of labelled rows (at most SAMPLE of each label, the lowest hashes of doc_id) are weighted
by log frequency and rarity and reduced to DIMS dimensions by a singular value
decomposition. The sample's vectors and labels are broadcast: at most 2 * SAMPLE * DIMS
numbers. Every document is folded into that space; its cosines with all labelled vectors
are computed exactly, a block of documents at a time; the NEIGHBOURS nearest vote, each
with its similarity to the power SHARP times the share of its label that it stands for.

Defined cases: a null or empty text, or one without words, scores 0: nothing speaks for
it; a text like no labelled one scores the share of label 1; all neighbours as near as the
last of the nearest vote too; a doc_id labelled more than once counts with its smallest
label; null labels are no labels; with no labelled rows every score is 0.5; repeated rows
are scored each; an empty table gives an empty result. Labels, lang, source and doc_id
are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm.common import give_back, small_batches

SAMPLE = 1_000
DIMS, SHAPES, ENDINGS = 48, 1536, 384
NEIGHBOURS, SHARP = 15, 8.0
THRESHOLD = 0.7
FOLDS, HELD = 4, 2
TERMS = SHAPES + ENDINGS + 4
REMEMBER = 200_000

_RUNS = re.compile(r"(.)\1+", re.S)
_CASE = str.maketrans({c: "A" for c in map(chr, range(65, 91))} | {c: "a" for c in map(chr, range(97, 123))} | {c: "9" for c in "0123456789"})


def _term(word: str) -> tuple[int, int]:
    shape = _RUNS.sub(r"\1+", "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word.translate(_CASE)))[:12]
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES, SHAPES + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % ENDINGS


class Bags:
    """Weighted bags of texts; the terms of words are remembered, within a bound."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), TERMS), np.float32)
        for i, text in enumerate(texts):
            words = (text or "").split()
            if not words:
                continue
            for w in words:
                if w not in self.seen:
                    if len(self.seen) >= REMEMBER:
                        self.seen.clear()
                        for v in words:
                            self.seen[v] = _term(v)
                    self.seen[w] = _term(w)
            flat = np.array([self.seen[w] for w in words])
            n = len(words)
            counts = np.bincount(flat.ravel(), minlength=TERMS)[:TERMS].astype(np.float32)
            counts[SHAPES + ENDINGS] = 3 * sum(map(eq, words, words[1:]))
            lines = [x for x in text.split("\n") if x.strip()]
            counts[SHAPES + ENDINGS + 1] = n * (1 - len(set(lines)) / max(1, len(lines)))
            counts[SHAPES + ENDINGS + 2] = n * max(0.0, 1 - 1.5 * len(set(words)) / n - 0.25)
            out[i] = counts / n  # shares of the words, so that length does not matter
        return np.log1p(50 * out)


class Space:
    """The reduced space, and the labelled vectors in it."""

    def __init__(self, bags: np.ndarray, labels: np.ndarray, share: float):
        rarity = np.log((1 + len(bags)) / (1 + (bags > 0).sum(0))) + 0.5
        weight = rarity.copy()
        weight[SHAPES : SHAPES + ENDINGS] *= 0.15
        weight[SHAPES + ENDINGS :] *= 2.0
        self.weight = weight.astype(np.float32)
        x = bags * self.weight
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.base = np.ascontiguousarray(vectors[:, ::-1][:, : min(DIMS, len(bags))]).astype(np.float32)
        self.labels, self.share = labels.astype(np.float32), share
        self.vectors = self.fold(bags)
        ones = max(1, int(labels.sum()))
        zeros = max(1, len(labels) - int(labels.sum()))
        self.stands_for = np.where(labels == 1, share / ones, (1 - share) / zeros).astype(np.float32)

    def fold(self, bags: np.ndarray) -> np.ndarray:
        v = (bags * self.weight) @ self.base
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, bags: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.where(bags.any(axis=1), self.share, 0.0)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(bags), block):
            part = bags[at : at + block]
            cosine = self.fold(part) @ self.vectors.T
            least = np.partition(cosine, -k, axis=1)[:, -k]
            row, near = np.nonzero(cosine >= least[:, None])
            vote = np.maximum(cosine[row, near], 0.0) ** SHARP * self.stands_for[near]
            total = np.bincount(row, vote, len(part))
            some = part.any(axis=1) & (total > 0)
            out[at : at + block][some] = (np.bincount(row, vote * self.labels[near], len(part)) / np.maximum(total, 1e-30))[some]
        return out.clip(0.0, 1.0)


def labelled(labels: DataFrame, folds: int, held: int, label: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold != held))
    return known.groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))


def fitted(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE,
           doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Space | None:
    known = labelled(labels, folds, held, label)
    n = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    # twice the bound: some labelled rows may have no text
    pick = [known.filter(F.col("__label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample) for v in n]
    if not n:
        return None
    chosen = pick[0]
    for x in pick[1:]:
        chosen = chosen.unionByName(x)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen.withColumnRenamed("doc_id", "__id")), "__id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Bags()
        for x in batches:
            found = make(x.column("__text").to_pylist())
            sparse = [(np.flatnonzero(b).astype(np.int16).tobytes(), b[b != 0].tobytes()) for b in found]
            yield pa.RecordBatch.from_arrays([x.column("__id"), x.column("__label"), pa.array([a for a, _ in sparse], pa.binary()), pa.array([b for _, b in sparse], pa.binary())], ["id", "label", "at", "value"])

    small_batches(docs.sparkSession)
    made = rows.mapInArrow(bags, "id long, label int, at binary, value binary")
    made = made.groupBy("id", "label").agg(F.min(F.struct("at", "value")).alias("b")).select("id", "label", "b.*")  # one row of each id
    found = sorted((r["label"], zlib.crc32(str(r["id"]).encode()), r["id"], bytes(r["at"]), bytes(r["value"])) for r in made.collect())
    kept, seen = [], {}
    for y, _, _, at, value in found:
        if seen.setdefault(y, 0) < sample and at:
            seen[y] += 1
            kept.append((y, at, value))
    if not kept:
        return None
    x = np.zeros((len(kept), TERMS), np.float32)
    for i, (_, at, value) in enumerate(kept):
        x[i, np.frombuffer(at, np.int16)] = np.frombuffer(value, np.float32)
    return Space(x, np.array([y for y, _, _ in kept]), n.get(1, 0) / sum(n.values()))


def scored(docs: DataFrame, space: Space | None, text: str = "text", score: str = "__score") -> DataFrame:
    """docs, all columns, and the score."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    work = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    ddl = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, docs.columns))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, s = Bags(), shared.value
        for x in batches:
            out = np.full(x.num_rows, 0.5)
            for at in range(0, x.num_rows, 512):
                texts = x.column("__text").slice(at, 512).to_pylist()
                if s is not None:
                    out[at : at + 512] = s.scores(make(texts))
            yield pa.RecordBatch.from_arrays([*[x.column(n) for n in names], pa.array(out)], [*names, "__score"])
        del make
        give_back()

    done = work.mapInArrow(run, f"{ddl}, __score double")
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.col("__score").alias(score))


def judged(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE,
           doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """docs, all columns, and __score: how likely label 1 is, 0 to 1."""
    return scored(docs, fitted(docs, labels, folds, held, sample, doc_id, text, label), text)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    name = max(docs.columns, key=len) + "_score"  # longer than any name that docs has
    return scored(docs, fitted(docs, labels), score=name).filter(F.col(name) >= threshold).select(docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    out = judged(docs.select("doc_id", "text"), labels)
    return out.select(
        "doc_id", F.coalesce(fold == HELD, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
