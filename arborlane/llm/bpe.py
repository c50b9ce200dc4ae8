"""BPE encoding and decoding with a public tokenizer, long unsplit text by tree concatenation.

A text of more than LONG characters is long: it is encoded as one run of text, not word
by word. It is cut into leaves at any place, also within a word; leaves are encoded each
for itself, then neighbours are joined pairwise, level by level of a tree. At a join the
text in a window around it is encoded again: if the window's encoding begins with a token
of the left part and, after the join, has a token of the right part (same place, same
id), the left part up to the one, the window's tokens and the right part from the other
make the encoding of both. Otherwise the window grows, up to both parts. That is exact:
an encoding by merges is valid if and only if each two neighbouring tokens are an
encoding of their own text, every neighbouring pair of the result is a neighbouring pair
of one of the three encodings, and from a token that is agreed upon the splitter goes on
alike, as it has no look at what was before. Tokens that end a word have ids of their
own, so that a word that goes on over the join is not taken for one that ends there.

A long text's tree is climbed by the task that holds the text. A text of more than SPREAD
characters is dealt: its leaves go to all tasks, and each level of the tree is a round.

Shorter texts are many, and are the concatenation of their words: this tokenizer's
splitter drops white space, and no token, normalization or special token reaches across
ASCII white space. Arrow numbers the words of a batch; each different one is encoded
once, or looked up if the task has met it before. So it is in leaves, where a word is
what stands between the blanks that normalization leaves.

Strings of special tokens in a text are recognised by the library as such; a long text
is first split at them and then normalized, as the library does.

Defined cases: a null or empty text has no tokens and decodes to the empty text;
repeated rows are encoded each; other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborlane.llm.common import checkpointed, give_back, small_batches

#: Characters of a text that is encoded by its tree, and of one whose tree is dealt to all tasks.
LONG = 20_000
SPREAD = 65_536
LEAF = 8_192
WINDOW = 64
#: Characters of the words in a generation of a task's memory of words.
REMEMBER = 1_000_000

_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple[Tokenizer, Tokenizer, dict[str, int]]:
    """The tokenizer, one without its normalizer, and its special tokens."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        whole.no_truncation(), whole.no_padding()
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "truncation": None, "padding": None, "added_tokens": []}))
        _loaded[path] = whole, bare, {t["content"]: t["id"] for t in spec["added_tokens"]}
    return _loaded[path]


def pieces(path: str, text: str) -> list[tuple[int | None, str]]:
    """A text as special tokens (id, "") and normalized text (None, text)."""
    whole, _, special = load(path)
    found = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
    normal = whole.normalizer.normalize_str if whole.normalizer else str
    return [(special[t], "") if k % 2 else (None, normal(t)) for k, t in enumerate(found) if t]


class Coded:
    """Text with its tokens: ids, and where each begins and ends."""

    def __init__(self, text: str, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        self.text, self.ids, self.begins, self.ends = text, ids, begins, ends


def _of(text: str, e) -> Coded:
    at = np.fromiter(chain.from_iterable(e.offsets), np.int32, 2 * len(e)).reshape(-1, 2)
    return Coded(text, np.array(e.ids, np.int32), at[:, 0], at[:, 1])


def encode_bare(path: str, text: str) -> Coded:
    return _of(text, load(path)[1].encode(text, add_special_tokens=False))


def joined(path: str, a: Coded, b: Coded, window: int = WINDOW) -> Coded:
    """The encoding of both texts."""
    text, cut = a.text + b.text, len(a.text)
    if not len(a.ids) or not len(b.ids):
        return encode_bare(path, text)
    while True:
        i = int(np.searchsorted(a.ends, cut - window))  # the window starts with token i of a
        start = int(a.begins[i]) if 0 < i < len(a.ids) else 0
        i = i if start else 0
        stop = min(len(text), cut + window)
        w = encode_bare(path, text[start:stop])
        if start == 0 and stop == len(text):
            return Coded(text, w.ids, w.begins, w.ends)
        begins, ends = w.begins + start, w.ends + start
        head = start == 0 or (len(w.ids) > 0 and w.ids[0] == a.ids[i] and begins[0] == start and ends[0] == a.ends[i] and ends[0] <= cut)
        if head:
            k, j = (len(w.ids) - 1, len(b.ids) - 1) if stop == len(text) else _agreed(w.ids, begins, ends, b, cut)
            if j >= 0:
                parts = zip((a.ids[:i], a.begins[:i], a.ends[:i]), (w.ids, begins, ends), (b.ids, b.begins + cut, b.ends + cut))
                return Coded(text, *[np.concatenate((x, y[: k + 1], z[j + 1 :])) for x, y, z in parts])
        window *= 2


def _agreed(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, b: Coded, cut: int) -> tuple[int, int]:
    """The last token but one or earlier of a window that is also one of b, not its first:
    its number in the window and in b, or -1 twice."""
    for k in range(len(ids) - 2, -1, -1):  # the last token may feel the window's end
        if begins[k] < cut:
            break
        j = int(np.searchsorted(b.ends, ends[k] - cut))
        if 0 < j < len(b.ids) and b.ends[j] == ends[k] - cut and b.begins[j] == begins[k] - cut and b.ids[j] == ids[k]:
            return k, j
    return -1, -1


class Memory:
    """What words were encoded as, in two generations: words met again move to the young
    one, which becomes the old one when it is full."""

    def __init__(self, code: Callable[[list[str]], Iterable[bytes]]):
        self.code, self.young, self.old, self.size = code, {}, {}, 0

    def of(self, words: list[str]) -> dict[str, bytes]:
        """A dictionary that has all of the words, which differ."""
        if self.size > REMEMBER:
            self.young, self.old, self.size = {}, self.young, 0
        young, old = self.young, self.old
        new = []
        for w in words:
            if w in young:
                continue
            self.size += len(w)
            if w in old:
                young[w] = old[w]
            else:
                new.append(w)
        for w, e in zip(new, self.code(new)):
            young[w] = e
        return young


def word_ids(path: str) -> Memory:
    """Words as bytes of 32-bit numbers: the ids of their tokens."""
    whole = load(path)[0]
    return Memory(lambda words: (array("i", e.ids).tobytes() for e in whole.encode_batch_fast(words, add_special_tokens=False)))


def word_places(path: str) -> Memory:
    """Normalized words as bytes of 32-bit numbers: of each token id, begin and end."""
    bare = load(path)[1]
    return Memory(lambda words: (np.array([(i, *at) for i, at in zip(e.ids, e.offsets)], np.int32).tobytes() for e in bare.encode_batch(words, add_special_tokens=False)))


def looked_up(memory: Memory, words: pa.Array, width: int) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words numbered by what they are, how many tokens each has, and the tokens of all
    words in a row, each of width numbers."""
    numbered = words.dictionary_encode()
    different = numbered.dictionary.to_pylist()
    known = memory.of(different)
    coded = [known[w] for w in different]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // (4 * width)
    at = numbered.indices.to_numpy()
    count, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
    take = np.repeat(first - (np.cumsum(count) - count), count)
    take += np.arange(len(take))
    return numbered, count, np.frombuffer(b"".join(coded), np.int32).reshape(-1, width)[take]


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def encode_leaves(places: Memory, texts: list[str]) -> list[Coded]:
    """Each text as encode_bare would, through words. Other white space than blanks does
    not divide here: the encoder sees to it."""
    split = pc.split_pattern(pa.array(texts, pa.string()), " ")
    cuts = split.offsets.to_numpy()
    numbered, count, tokens = looked_up(places, split.flatten(), 3)
    after = pc.utf8_length(numbered.dictionary).to_numpy().astype(np.int64)[numbered.indices.to_numpy()] + 1
    starts = _sums(after)
    first = (starts[:-1] - np.repeat(starts[cuts[:-1]], np.diff(cuts))).astype(np.int32)
    tokens[:, 1:] += np.repeat(first, count)[:, None]
    bounds = _sums(count)[cuts]
    return [Coded(t, *np.ascontiguousarray(tokens[i:j].T)) for t, i, j in zip(texts, bounds, bounds[1:])]


def encode_words(ids: Memory, texts: pa.Array) -> list[np.ndarray]:
    """Ids of each text, through words."""
    split = pc.ascii_split_whitespace(texts)
    _, count, tokens = looked_up(ids, split.flatten(), 1)
    bounds = _sums(count)[split.offsets.to_numpy()]
    return [tokens[i:j, 0] for i, j in zip(bounds, bounds[1:])]


def encode_tree(path: str, text: str, leaf: int = LEAF, places: Memory | None = None) -> Coded:
    """Encoding of a normalized text by its leaves, joined level by level."""
    places = places or word_places(path)
    level = encode_leaves(places, [text[i : i + leaf] for i in range(0, max(1, len(text)), leaf)])
    while len(level) > 1:
        level = [joined(path, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def encode_long(path: str, text: str, leaf: int = LEAF, places: Memory | None = None) -> list[int]:
    """Ids of a long text, in one task."""
    places = places or word_places(path)
    return list(chain.from_iterable([special] if special is not None else encode_tree(path, t, leaf, places).ids.tolist() for special, t in pieces(path, text)))


_strings: dict[str, pa.Array | None] = {}


def decode(path: str, ids: pa.ListArray) -> pa.Array:
    """Each as the library's decode(ids, skip_special_tokens=False). Without a decoder that
    is the tokens' strings joined by spaces; one call for each text would cost more."""
    whole = load(path)[0]
    if path not in _strings:
        _strings[path] = pa.array([whole.id_to_token(i) or "" for i in range(whole.get_vocab_size())], pa.string()) if whole.decoder is None else None
    strings = _strings[path]
    if strings is None:
        return pa.array([whole.decode(i, skip_special_tokens=False) for i in ids.to_pylist()], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, strings.take(ids.values)), " ")


def _id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    return pa.ListArray.from_arrays(pa.array(_sums([len(i) for i in ids]), pa.int32()), pa.array(flat))


def _in_task(path: str, long: int, leaf: int, names: list[str]):
    """Rows with ids and decoded added."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, places = word_ids(path), word_places(path)
        for x in batches:
            texts = pc.fill_null(x.column("__text"), "")
            is_long = pc.greater(pc.utf8_length(texts), long)
            ids = encode_words(ids_of, pc.if_else(is_long, "", texts))
            for k in np.flatnonzero(is_long.to_numpy(zero_copy_only=False)):
                ids[k] = np.array(encode_long(path, texts[k].as_py(), leaf, places), np.int32)
            coded = _id_lists(ids)
            yield pa.RecordBatch.from_arrays([*[x.column(n) for n in names], coded, decode(path, coded)], [*names, "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)  # whose memories are gone before memory is given back
        give_back()

    return run


def _leaves(path: str, leaf: int):
    """Special tokens and leaves of texts that are dealt."""
    fields = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("node", pa.int32()), ("special", pa.int32()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row, text in zip(x.column("__row").to_pylist(), x.column("__text").to_pylist()):
                out = []
                for place, (special, part) in enumerate(pieces(path, text)):
                    starts = [0] if special is not None else range(0, max(1, len(part)), leaf)
                    out.extend((row, place, k, special, part[i : i + leaf]) for k, i in enumerate(starts))
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r)) for r in out], fields)

    return run


CODED = "row long, place int, node int, text string, ids binary, begins binary, ends binary"


def _table(rows: list[tuple[int, int, int, Coded]]) -> pa.Table:
    kinds = [("row", pa.int64()), ("place", pa.int32()), ("node", pa.int32()), ("text", pa.string()), *[(n, pa.binary()) for n in ("ids", "begins", "ends")]]
    whole = [(*at, c.text, *[np.ascontiguousarray(v, np.int32).tobytes() for v in (c.ids, c.begins, c.ends)]) for *at, c in rows]
    cols = list(zip(*whole)) if whole else [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds)], [n for n, _ in kinds])


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = word_places(path)
        for x in batches:
            rows = []
            for r in x.to_pylist():
                if r["special"] is not None:
                    c = Coded("", np.array([r["special"]], np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32))
                else:
                    c = encode_leaves(places, [r["part"]])[0]
                rows.append((r["row"], r["place"], r["node"], c))
            yield from _table(rows).to_batches()

    return run


def _coded(r: dict) -> Coded:
    return Coded(r["text"], *[np.frombuffer(r[n], np.int32) for n in ("ids", "begins", "ends")])


def _join_two(path: str):
    """Neighbouring nodes 2k and 2k+1 of one level: node k of the next."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["node"])
        if len(rows) == 2:
            c = joined(path, _coded(rows[0]), _coded(rows[1]))
        else:
            c = _coded(rows[0])
        return _table([(rows[0]["row"], rows[0]["place"], rows[0]["node"] // 2, c)])

    return run


def _gather(path: str):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["place"])
        coded = _id_lists([np.concatenate([np.frombuffer(r["ids"], np.int32) for r in rows])])
        return pa.Table.from_arrays([pa.array([rows[0]["row"]], pa.int64()), coded, decode(path, coded)], ["__row", "ids", "decoded"])

    return run


def encoded(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, long: int = LONG, spread: int = SPREAD, leaf: int = LEAF) -> DataFrame:
    """The columns keep of docs (default: all), with ids array<int> and decoded string,
    which take the place of columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    work = [f"__c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(w) for c, w in zip(keep, work)], F.col(text).alias("__text"))
    ddl = ", ".join(f"{w} {f.dataType.simpleString()}" for w, f in zip(work, fields))
    back = [F.col(w).alias(c) for c, w in zip(keep, work)]
    is_spread = F.length(F.coalesce("__text", F.lit(""))) > spread
    spread_rows = checkpointed(rows.filter(is_spread).withColumn("__row", F.monotonically_increasing_id()))
    in_task = rows.filter(~is_spread).mapInArrow(_in_task(path, long, leaf, work), f"{ddl}, ids array<int>, decoded string")
    if spread_rows.isEmpty():
        return in_task.select(*back, "ids", "decoded")
    leaves = spread_rows.select("__row", "__text").mapInArrow(_leaves(path, leaf), "row long, place int, node int, special int, part string")
    leaves = checkpointed(leaves)
    most = leaves.agg(F.max("node")).first()[0] or 0
    level = checkpointed(leaves.repartition("row", "place", "node").mapInArrow(_encode_leaves(path), CODED))
    while most > 0:
        level = level.groupBy("row", "place", F.floor(F.col("node") / 2).alias("up")).applyInArrow(_join_two(path), CODED)
        most //= 2
    done = level.groupBy("row").applyInArrow(_gather(path), "__row long, ids array<int>, decoded string")
    return in_task.select(*work, "ids", "decoded").unionByName(spread_rows.join(done, "__row").select(*work, "ids", "decoded")).select(*back, "ids", "decoded")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame) -> DataFrame:
    with_ids = encoded(docs, vocabulary(), keep=["doc_id"])
    return with_ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
