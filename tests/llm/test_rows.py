"""Repeated rows, null ids, clashing names and ties, each against brute force."""

import collections
import random

import numpy as np
import pytest

from arborlane.llm import exact_dedup, mixing, ngram_join, quality_classifier, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(n, rnd):
    return " ".join(f"w{rnd.randrange(500)}" for _ in range(n))


@pytest.mark.parametrize("copies", [300, 40])
def test_mix_of_repeats_meets_target(spark, copies):
    """A row that repeats is taken as often as the target asks, not always or never."""
    rnd = random.Random(3)
    rows = [(i, _words(rnd.randrange(5, 40), rnd), "en", "a", 0) for i in range(40)]
    rows += [(900, _words(17, rnd), "en", "a", 0)] * copies + [(1000 + i, _words(30, rnd), "en", "b", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.sampled(docs).collect()
    assert len(got) == len(rows)
    for source in {r["source_size"] for r in got}:
        mine = [r for r in got if r["source_size"] == source]
        longest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= longest
    taken = collections.Counter()
    for r in got:
        taken[r["doc_id"]] += r["copies"]
    rows_out = collections.Counter(r["doc_id"] for r in mixing.mix(docs.withColumnRenamed("n_chars", "__size")).collect())
    assert rows_out == +taken
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.sampled(docs.repartition(2)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in got)


def test_one_of_each_component(spark):
    rnd = random.Random(4)
    base = _words(100, rnd)
    near = base.rsplit(" ", 1)[0] + " other"
    rows = [(5, base, "en", "a", 1), (3, near, "en", "a", 2), (None, base, "en", "a", 3), (None, near, "en", "a", 4), (5, base, "en", "a", 1), (8, _words(90, rnd), "en", "a", 5), (8, near, "en", "a", 6)]
    rows += [(20, None, "en", "a", 7), (21, "", "en", "a", 8), (30, base + " x", "en", "b", 9)] + [(40, _words(60, random.Random(9)), "en", "b", 10)] * 3
    got = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "row").repartition(3)).collect()
    assert sorted((r["doc_id"], r["row"]) for r in got) == [(3, 2), (8, 5), (20, 7), (21, 8), (40, 10)]


def test_one_of_each_in_a_large_cluster(spark, monkeypatch):
    """A cluster of texts too large for a task was written to the cells of its pivots again and again."""
    monkeypatch.setattr(ngram_join, "REGION_SHINGLES", 6_000)
    most, rnd = [], random.Random(3)
    monkeypatch.setattr(ngram_join, "checkpointed", lambda df, f=ngram_join.checkpointed: (out := f(df), most.append(out.count()))[0])
    base, rows, plain = [f"w{i}" for i in range(104)], [], []
    for i in range(200):
        words = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3, 4, 6])):
            words[rnd.randrange(104)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        plain.append({tuple(words[j : j + 5]) for j in range(100)})
    root = list(range(200))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(200):
        for j in range(i):
            if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == sorted({find(i) for i in range(200)})
    assert 1 < len(got) < 200 and max(most) <= 200 * 11


def test_exact_dedup_keeps_columns(spark):
    """Columns of the operator's own names come back as they were; a row of equal id and
    another text is no copy."""
    rows = [(1, "a b", "en", "x", 1), (2, "a b", "en", "x", 2), (2, "c", "en", "x", 3), (None, "a b", "en", "x", 4), (7, "z", "en", "x", 5), (7, "z", "en", "x", 5), (9, None, "en", "x", 6), (8, "", "en", "x", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for a, b, c in (("__h", "__len", "__sha"), ("id", "sha", "same"), ("c0", "c1", "row")):
        got = exact_dedup.drop_exact_copies(docs.withColumnsRenamed({"lang": a, "source": b, "n_chars": c}))
        assert got.columns == ["doc_id", "text", a, b, c]
        assert sorted((r[0], r[2], r[3], r[4]) for r in got.collect()) == [(2, "en", "x", 2), (2, "en", "x", 3), (7, "en", "x", 5), (9, "en", "x", 6)]


def test_votes_by_brute_force():
    rng = np.random.default_rng(1)
    bags = rng.random((120, quality_classifier.TERMS)).astype(np.float32) * (rng.random((120, quality_classifier.TERMS)) < 0.05)
    bags[60:70] = bags[50]  # ties at the last of the nearest
    labels = (rng.random(120) < 0.6).astype(int)
    space = quality_classifier.Space(bags, labels, 0.6)
    asked = np.concatenate((bags[45:75], rng.random((5, quality_classifier.TERMS)).astype(np.float32), np.zeros((1, quality_classifier.TERMS), np.float32)))
    got = space.scores(asked, block=7)
    vectors = space.fold(bags)
    for q, score in zip(asked, got):
        if not q.any():
            assert score == 0.0
            continue
        cosine = [float(c) for c in space.fold(q[None])[0] @ vectors.T]
        least = sorted(cosine)[-quality_classifier.NEIGHBOURS]
        votes = [(max(c, 0.0) ** quality_classifier.SHARP * (0.6 / labels.sum() if y else 0.4 / (120 - labels.sum())), y) for c, y in zip(cosine, labels) if c >= least - 1e-6]
        assert score == pytest.approx(sum(v for v, y in votes if y) / sum(v for v, _ in votes), abs=2e-3)


def test_cascade_by_brute_force(spark):
    """kept is what all rules say together, and measures that are no columns stand in the
    cascade only."""
    rnd = random.Random(6)
    rows = [(i, "\n".join(_words(rnd.randrange(1, 9), rnd).upper() if rnd.random() < 0.3 else _words(6, rnd) for _ in range(rnd.randrange(1, 30))) + "!" * rnd.choice([0, 0, 90])) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a b c\n" * 40), (103, "# $ " * 60), (104, "Q" * 3000 + " w" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.query(docs).collect()}
    for i, text in rows:
        text = text or ""
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        windows = collections.Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        cover = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        n, chars = len(words), sum(map(len, words))
        bad = [n < 50, 100 * len(cover) > 50 * n, 100 * sum(c in "#*$%&|<>" for c in text) > 30 * n, chars < 2 * n or chars > 20 * n, 100 * (len(lines) - len(set(lines))) > 30 * len(lines),
               100 * sum(c.isupper() for c in text) > 50 * chars, 100 * sum(c in "!?" for c in text) > 60 * n]
        assert got[i]["kept"] == (not any(bad)) and got[i]["n_repeat_words"] == len(cover)
    plan = quality_rules.measured(docs)._jdf.queryExecution().analyzed().toString()
    assert "n_upper" not in plan and "AS n_lines" not in plan
