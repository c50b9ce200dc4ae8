"""A hidden Markov language model, trained by Baum-Welch and scored exactly.

Words are emitted in two steps: a latent state emits a class, and the class emits one
of its words. A word with at least one in FREQUENT of all training tokens has a class
of its own; any other falls into one of TAILS classes by its ending and length. Within
a class a word has (c + 1) / (N_k + V_k + 1) of the class, with c its training count,
N_k and V_k the tokens and distinct words of the class in training; unseen words share
one part. So the model is a proper distribution over known words and "unseen".

All training tokens are counted (each block sends its words with their counts and
learns the totals). Baum-Welch improves a random start in ROUNDS rounds, each over all
training documents, whole, with the expected counts of all partitions added up; the
last one sets the model. The likelihood of a text is the scaled forward recursion over
its classes, plus the words' shares of their classes.

Defined cases: a null or empty text is the end token alone; held-out rows do not train;
with nothing to train on all counts are 0 and scores are those of uniform tables;
repeated rows count each; a null doc_id is in training (its remainder is null);
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.llm import blocks as B
from arborlane.llm.common import checkpointed, give_back, release

STATES = 8
FREQUENT = 4_000
TAILS = 1_500
ROUNDS = 8
FOLDS, HELD = 7, 2
#: Tokens of documents that a task holds at a time, vectors of a recursion that are kept at
#: a time, and steps from one scaling of them to the next. None changes what is computed.
GROUP, CELLS, SPAN = 4_000_000, 100_000, 8


def held_out(doc: int | None, folds: int = FOLDS, held: int = HELD) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == held


def tails(words: list[bytes]) -> np.ndarray:
    """The class of each word by its last four bytes and whether it is long."""
    return np.fromiter((zlib.crc32(w[-4:] + (b"+" if len(w) > 6 else b"-")) % TAILS for w in words), np.int64, len(words))


class Model:
    """Classes 0..TAILS-1 are tails, then the end, then the frequent words."""

    def __init__(self, frequent: np.ndarray, tokens: np.ndarray, kinds: np.ndarray, total: int, distinct: int, ends: int):
        self.frequent, self.tokens, self.kinds = frequent, tokens, kinds
        self.total, self.distinct, self.ends = total, distinct, ends
        self.classes = TAILS + 1 + len(frequent)

    def classify(self, keys: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return tail
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        return np.where(self.frequent[at] == keys, TAILS + 1 + at, tail)


ASK = "block long, bucket int, keys binary, count binary, tail binary"
#: A bucket's answers, and a row of block -1 with what the bucket knows of the corpus.
ANSWER = "block long, bucket int, count binary, low binary"


def _ask(buckets: int, folds: int, held: int):
    """Training counts of a block's words, and the words' tail classes."""

    def f(row: dict) -> list[tuple]:
        x = B.read_block(row)
        train = np.repeat([not held_out(i, folds, held) for i in x.ids], x.lens)
        count = np.bincount(x.codes[train], minlength=len(x.words))
        keys, first = np.unique(B.word_keys(x.words), return_index=True)
        rows = B.asks(x.block, keys, count[first], tails(x.words)[first], buckets)
        return [(*r[:4], np.frombuffer(r[4], np.int64).astype(np.uint16).tobytes()) for r in rows]

    return f


def _answer(least: int):
    """Totals of a bucket's words; of the corpus: the bucket's frequent words, and tokens
    and distinct words of each tail."""

    def f(t: pa.Table) -> pa.Table:
        tail = np.frombuffer(b"".join(t.column("tail").to_pylist()), np.uint16).astype(np.int64)
        t = t.append_column("low", pa.array([b""] * t.num_rows, pa.binary()))
        keys, count, tail, index, sizes = B.totals(t, tail)
        rows, at, sent = [], 0, count[index]
        for block, bucket, n in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), sizes):
            rows.append((block, bucket, B.numbers(sent[at : at + n]), b""))
            at += n
        often, seen = count >= least, count > 0
        stats = [keys[often].view(np.int64), count[often], tail[often], np.bincount(tail[seen], count[seen], TAILS).astype(np.int64), np.bincount(tail[seen], minlength=TAILS).astype(np.int64)]
        rows.append((-1, rows[0][1], np.concatenate(stats).tobytes(), np.int64(often.sum()).tobytes()))
        return B.table(ANSWER, rows)

    return f


def _sum_stats(batches):
    """One row of a partition's statistics: frequent words side by side, the rest added."""
    words, rest = [], np.zeros(2 * TAILS, np.int64)
    for x in batches:
        for stats, n in zip(x.column("count").to_pylist(), x.column("low").to_pylist()):
            v, n = np.frombuffer(stats, np.int64), int(np.frombuffer(n, np.int64)[0])
            words.append(v[: 3 * n].reshape(3, n))
            rest = rest + v[3 * n :]
    joined = np.concatenate(words, 1) if words else np.zeros((3, 0), np.int64)
    yield B.batch("count binary, low binary", [(np.concatenate((joined.ravel(), rest)).tobytes(), np.int64(joined.shape[1]).tobytes())])


# ---- forward and backward ------------------------------------------------------------


def side_by_side(kinds: np.ndarray, lens: np.ndarray, use: np.ndarray):
    """Documents as sequences of classes, each closed by the end class, one beside the
    other, longest first: the documents, the classes step by step, and the number of
    documents that are still running at each step. kinds: of all documents in a row."""
    starts = np.cumsum(lens, dtype=np.int64) - lens
    order = use[np.argsort(-lens[use], kind="stable")]
    n = lens[order].astype(np.int64)
    live = len(order) - np.searchsorted(n[::-1] + 1, np.arange(int(n.max(initial=-1)) + 1), side="right")
    at = np.cumsum(live) - live
    table = np.full(int(live.sum()), TAILS, np.int32)
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    where = at[step] + np.repeat(np.arange(len(order)), n)
    table[where] = kinds[np.repeat(starts[order], n) + step]
    return order, table, live


def lanes(x: B.Block, kinds: np.ndarray, use: np.ndarray):
    """A block's documents side by side."""
    if len(use):
        yield side_by_side(kinds[x.codes] if len(x.codes) else np.zeros(0, np.int64), x.lens, use)


def _stretches(live: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where each step begins, and the steps in stretches of about CELLS vectors."""
    steps, at, bounds = len(live), np.concatenate(([0], np.cumsum(live))), [0]
    while bounds[-1] < steps:
        bounds.append(max(bounds[-1] + 1, int(np.searchsorted(at, at[bounds[-1]] + CELLS, side="right")) - 1))
    return at, list(zip(bounds, bounds[1:]))


def _first_scaled(step: int, live: list[int]) -> int:
    """The first sequence whose vector is scaled to a sum of one at a step: those that end
    with it, and all of them at each SPAN-th step. In between no vector can vanish."""
    return 0 if (step + 1) % SPAN == 0 or step + 1 == len(live) else live[step + 1]


def likelihood(table, live, pi, a, b):
    """Scaled forward recursion: log10 of the probability of each sequence. Vectors are
    rows, a column for each state."""
    out, sums = np.zeros(live[0]), np.ones(len(pi))
    (at, stretches), live, x = _stretches(live), live.tolist(), None
    for begin, end in stretches:
        alpha = b.take(table[at[begin] : at[end]], axis=0)
        ends = (at[begin : end + 1] - at[begin]).tolist()
        for t, lo, hi in zip(range(begin, end), ends, ends[1:]):
            now = alpha[lo:hi]
            now *= pi if x is None else x[: hi - lo] @ a
            first = _first_scaled(t, live)
            if first < hi - lo:
                s = now[first:] @ sums
                now[first:] *= (1 / s)[:, None]
                out[first : hi - lo] += np.log10(s)
            x = now
    return out


def expected(table, live, pi, a, b):
    """Expected counts of starts, transitions and (state, class) emissions, and log10 of the
    likelihood. Only the forward vectors at the bounds of stretches of CELLS are kept; each
    stretch runs again on the way back, so nothing is cut."""
    width, k = int(live[0]), len(pi)
    back, sums = np.ascontiguousarray(a.T), np.ones(k)
    (at, stretches), live = _stretches(live), live.tolist()

    def forward(begin: int, end: int, x):
        alpha = b.take(table[at[begin] : at[end]], axis=0)
        ends = (at[begin : end + 1] - at[begin]).tolist()
        scale, ll = {}, 0.0
        for t, lo, hi in zip(range(begin, end), ends, ends[1:]):
            now = alpha[lo:hi]
            now *= pi if x is None else x[: hi - lo] @ a
            first = _first_scaled(t, live)
            if first < hi - lo:
                s = now[first:] @ sums
                ll += float(np.log10(s).sum())
                scale[t] = first, (1 / s)[:, None]
                now[first:] *= scale[t][1]
            x = now
        return alpha, scale, x.copy(), ll

    enter, x, ll = [], None, 0.0
    for begin, end in stretches:
        enter.append(x)
        alpha, scale, x, part = forward(begin, end, x)
        ll += part
    beta = np.ones((width, k))  # the backward vectors, of sequences that end as ones
    pairs, emitted, y = np.zeros((k, k)), np.zeros((k, b.shape[0])), None
    for (begin, end), x in zip(reversed(stretches), reversed(enter)):
        if end != len(live):
            alpha, scale, _, _ = forward(begin, end, x)
        kinds = table[at[begin] : at[end]].astype(np.int64)
        emit = b.take(kinds, axis=0)
        ends = (at[begin : end + 1] - at[begin]).tolist()
        for t, lo, hi in zip(range(end - 1, begin - 1, -1), ends[-2::-1], ends[:0:-1]):
            now = alpha[lo:hi]
            if y is not None:  # of the step after
                pairs += now[: len(y)].T @ y
                np.matmul(y, back, out=beta[: len(y)])
            y = emit[lo:hi]
            if t in scale:
                first, s = scale[t]
                y[first:] *= s
            y *= beta[: hi - lo]
            now *= beta[: hi - lo]
        y = y.copy()
        for s in range(k):
            emitted[s] += np.bincount(kinds, alpha[:, s], b.shape[0])
    return alpha[:width].sum(0), pairs * a, emitted, ll


CLASSED = "block long, ids array<long>, lens binary, kinds binary"


def _classed(model: Model):
    """A block's documents as classes, which all rounds of training read."""

    def f(row: dict) -> list[tuple]:
        x = B.read_block(row)
        kinds = model.classify(B.word_keys(x.words), tails(x.words)).astype(np.uint16)
        return [(x.block, x.ids, B.packed(x.lens), B.packed(kinds[x.codes] if len(x.codes) else kinds[:0]))]

    return f


def _together(batches):
    """Blocks of a partition, up to about GROUP tokens at a time: their numbers, their ids,
    and the classes and lengths of their documents in a row."""
    numbers, ids, kinds, lens, size = [], [], [], [], 0
    for x in batches:
        for block, i, n, k in zip(*(x.column(c).to_pylist() for c in ("block", "ids", "lens", "kinds"))):
            numbers.append(block), ids.append(i)
            kinds.append(B.unpacked(k, np.uint16)), lens.append(B.unpacked(n, np.int32))
            size += len(kinds[-1]) + len(i)
            if size >= GROUP:
                yield numbers, ids, np.concatenate(kinds), np.concatenate(lens)
                numbers, ids, kinds, lens, size = [], [], [], [], 0
    if size:
        yield numbers, ids, np.concatenate(kinds), np.concatenate(lens)


PART = "part int, counts binary"


def _expect(params, folds: int, held: int):
    """Counts of the training documents of a partition's blocks."""
    pi, a, b = params

    def f(batches):
        out = np.zeros(len(pi) * (1 + len(pi) + b.shape[0]) + 1)
        for _, ids, kinds, lens in _together(batches):
            train = np.flatnonzero([not held_out(d, folds, held) for i in ids for d in i])
            if len(train):
                _, table, live = side_by_side(kinds, lens, train)
                p, q, e, ll = expected(table, live, pi, a, b)
                out += np.concatenate((p, q.ravel(), e.ravel(), [ll]))
        yield B.batch(PART, [(0, out.tobytes())])
        give_back()

    return f


def _likelihoods(params):
    """A row for each block, among the answers to it: its documents' likelihoods."""

    def f(batches):
        for numbers, ids, kinds, lens in _together(batches):
            order, table, live = side_by_side(kinds, lens, np.arange(len(lens)))
            found = np.zeros(len(lens))
            found[order] = likelihood(table, live, *params)
            cuts = np.cumsum([len(i) for i in ids])[:-1]
            yield B.batch(ANSWER, [(n, -1, b"", v.tobytes()) for n, v in zip(numbers, np.split(found, cuts))])
        give_back()

    return f


def _folded(batches):
    """One row of counts for each partition, then for the driver's sum: few rows."""
    total = None
    for x in batches:
        for b in x.column("counts").to_pylist():
            v = np.frombuffer(b)
            total = v.copy() if total is None else total + v
    if total is not None:
        yield B.batch(PART, [(0, total.tobytes())])


def _round(classed: DataFrame, model: Model, params, folds: int, held: int):
    """One round of Baum-Welch: counts of partitions, of 16 groups of them."""
    counts = classed.mapInArrow(_expect(params, folds, held), PART)
    counts = counts.repartition(16).mapInArrow(_folded, PART)
    rows = [np.frombuffer(bytes(r["counts"])) for r in counts.select("counts").collect()]
    k, c = STATES, model.classes
    x = np.sum(rows, 0) if rows else np.zeros(k * (1 + k + c) + 1)
    pi = x[:k] + 0.1
    a = x[k : k + k * k].reshape(k, k) + 0.1
    e = x[k + k * k : -1].reshape(k, c)
    background = (e.sum(0) + 0.5) / (e.sum() + 0.5 * c)
    e = e + 200.0 * background  # a state falls back on the classes' shares in all states
    return (pi / pi.sum(), a / a.sum(1, keepdims=True), np.ascontiguousarray((e / e.sum(1, keepdims=True)).T)), float(x[-1])


def _start(model: Model, top: np.ndarray, seed: int = 11):
    rng = np.random.default_rng(seed)
    share = np.concatenate((model.tokens, [model.ends], top)).astype(float) + 0.5
    b = share[:, None] * rng.gamma(1.0, 1.0, (model.classes, STATES)) + 1e-9
    a = np.full((STATES, STATES), 0.3 / STATES) + np.eye(STATES) * 0.7
    return np.full(STATES, 1 / STATES), a / a.sum(1, keepdims=True), b / b.sum(0)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model, folds: int, held: int):
    n, v = model.total, model.distinct

    def f(row: dict, found) -> list[tuple]:
        x = B.read_block(row)
        word = B.word_keys(x.words)
        keys = np.unique(word)
        count = found[0][np.searchsorted(keys, word)] if len(word) else np.zeros(0, np.int64)
        tail = tails(x.words)
        kinds = model.classify(word, tail)
        base = np.log10((count + 1) / (n + v + 1))
        share = np.where(kinds < TAILS, np.log10((count + 1) / (model.tokens[tail] + model.kinds[tail] + 1)), 0.0)
        of = lambda w: np.add.reduceat(np.append(w[x.codes], 0), x.starts[:-1]) * (x.lens > 0) if len(x.lens) else w
        end = math.log10((model.ends + 1) / (n + v + 1))
        known, base_of, share_of = of((count > 0).astype(np.int64)), of(base) + end, of(share)
        ll = found[1].view(np.float64)
        return [
            (d, held_out(d, folds, held), int(x.lens[i]) + 1, int(known[i]) + int(model.ends > 0), n, float(base_of[i]), float(ll[i] + share_of[i]))
            for i, d in enumerate(x.ids)]

    return f


def scored(docs: DataFrame, folds: int = FOLDS, held: int = HELD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of SCORES for each row of docs."""
    spark = docs.sparkSession
    blocks = B.token_blocks(docs, True, doc_id, text)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    ends = blocks.select(F.explode("ids").alias("i")).filter(
        (F.pmod(F.crc32(F.col("i").cast("string")), F.lit(folds)) != held) | F.col("i").isNull()).count()
    buckets = B.buckets_for(tokens // 4, spark)
    least = max(2, -(-tokens // FREQUENT))
    found = checkpointed(B.each_block(blocks, _ask(buckets, folds, held), ASK).groupBy("bucket").applyInArrow(_answer(least), ANSWER))
    release(spark)
    # at most FREQUENT words and a row for each of 16 partitions
    stats = found.filter("block < 0").select("count", "low").coalesce(16).mapInArrow(_sum_stats, "count binary, low binary")
    words, rest = [np.zeros((3, 0), np.int64)], np.zeros(2 * TAILS, np.int64)
    for r in stats.collect():
        v, n = np.frombuffer(bytes(r["count"]), np.int64), int(np.frombuffer(bytes(r["low"]), np.int64)[0])
        words.append(v[: 3 * n].reshape(3, n))
        rest = rest + v[3 * n :]
    keys, top, kind = np.concatenate(words, 1)
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    keys, top, kind = keys[order], top[order], kind[order]
    in_tail, of_tail = rest[:TAILS], rest[TAILS:]
    total, distinct = int(in_tail.sum()) + ends, int(of_tail.sum()) + (ends > 0)
    in_tail = in_tail - np.bincount(kind, top, TAILS).astype(np.int64)
    of_tail = of_tail - np.bincount(kind, minlength=TAILS)
    model = Model(keys, in_tail, of_tail, total, distinct, ends)
    params = _start(model, top)
    classed = checkpointed(B.each_block(blocks, _classed(model), CLASSED))
    for _ in range(ROUNDS):
        params, _ = _round(classed, model, params, folds, held)
    ll = checkpointed(classed.mapInArrow(_likelihoods(params), ANSWER))
    del classed
    release(spark)
    return B.with_answers(blocks, found.filter("block >= 0").unionByName(ll), _score(model, folds, held), SCORES)


def query(docs: DataFrame) -> DataFrame:
    return scored(docs)
