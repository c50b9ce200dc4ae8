"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pytest

from arborlane.llm import blocks, language_model, ngram_join, private_data


def _roots(sets):
    """The component of each set under J >= 0.8, by brute force."""
    plain = [{*s.tolist()} for s in sets]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b]):
                root[find(a)] = find(b)
    return [find(i) for i in range(len(sets))]


def _same(got, want):
    pairs = set(zip(got, want))
    return len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})


def _linked(region):
    """Components from the links that a region returns."""
    root = list(range(len(region.sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in region.links:
        root[find(a)] = find(b)
    return [find(i) for i in range(len(root))]


def _window(at, size=40):
    return set(range(1000 + at, 1000 + at + size))


def test_leaf_keeps_bridge():
    """A chain of 100 overtakes the 71 copies that were largest; one pair joins the two,
    and neither of its sets is ever a pivot if both components are passed over."""
    chain = [_window(2 * i) for i in range(100)]
    bridge, hub = _window(202), _window(206)
    copies = [hub, *[hub - {1206 + i % 40} | {9000 + i} for i in range(69)]]
    sets = [np.array(sorted(s), np.uint64) for s in [*chain, bridge, *copies]]
    first = [101, *range(3, 100, 5), *range(5, 99, 5), *[i for i in range(20, 90) if i % 5 not in (0, 3)]]
    central = np.zeros(len(sets))
    central[first] = np.arange(len(first), 0, -1)
    region = ngram_join.Region(list(range(len(sets))), sets, central.tolist())
    region.join()
    want = _roots(sets)
    assert len(set(want)) == 1
    assert _same(_linked(region), want) and _same(region.root.tolist(), want)


@pytest.mark.parametrize("seed", range(4))
def test_leaf_of_hundreds(seed):
    """Chains, tight clusters and bridges among several hundred sets, in one leaf."""
    rnd = random.Random(seed)
    sets, at = [], 0
    for _ in range(8):
        for _ in range(rnd.randrange(10, 50)):
            sets.append(_window(at))
            at += rnd.choice([2, 4, 4])
        hub = _window(at)
        sets += [hub - {rnd.choice(sorted(hub))} | {9000 + rnd.randrange(500)} for _ in range(rnd.randrange(10, 50))]
        at += rnd.choice([4, 6, 8])
    sets = [np.array(sorted(s), np.uint64) for s in sets]
    region = ngram_join.Region(list(range(len(sets))), sets, [rnd.random() for _ in sets])
    region._leaf(np.arange(len(sets)))
    assert len(sets) > 300 and _same(_linked(region), _roots(sets))


def _cluster(n, seed=5):
    """Near copies of one set with few or many changes: a large component and many sets alone."""
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        s = _window(0, 100)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8])):
            at = rnd.randrange(95)
            s = s - {*range(1000 + at, 1005 + at)} | {rnd.randrange(10_000, 1_000_000) for _ in range(5)}
        out.add(frozenset(s))
    return [np.array(sorted(s), np.uint64) for s in sorted(out, key=sorted)]


def test_tight_cluster_is_joined_by_few_pivots(monkeypatch):
    """Sets alone were pivots, each compared with the whole region."""
    sets, seen = _cluster(600), []
    monkeypatch.setattr(ngram_join.Region, "distances", lambda self, p, f=ngram_join.Region.distances: (seen.append(p), f(self, p))[1])
    region = ngram_join.Region(list(range(600)), sets, [float(len(s)) for s in sets])
    region.join()
    want = _roots(sets)
    assert 100 < len(set(want)) < 500
    assert _same(_linked(region), want) and _same(region.root.tolist(), want)
    assert len(seen) < 60


def test_tight_cluster_is_not_spread(spark, monkeypatch):
    """A cluster too large for a task entered almost all cells of its pivots, in each split anew."""
    monkeypatch.setattr(ngram_join, "REGION_SHINGLES", 6_000)
    most = []
    monkeypatch.setattr(ngram_join, "checkpointed", lambda df, f=ngram_join.checkpointed: (out := f(df), most.append(out.count()))[0])
    sets = _cluster(200)
    rows = [(7, i, len(s), s.tobytes(), float(len(s))) for i, s in enumerate(sets)]
    links = ngram_join._links(spark.createDataFrame(rows, "region long, set long, n int, keys binary, central double")).collect()
    region = ngram_join.Region(list(range(200)), sets, [0.0] * 200)
    region.links = [(r.a, r.b) for r in links]
    assert _same(_linked(region), _roots(sets))
    assert max(most) <= 200 * 11


@pytest.mark.parametrize("cells", [250_000, 70])
def test_training_carries_state(spark, monkeypatch, cells):
    """Training sees a long document as one chain: its likelihood is that of scoring, and
    its expected transitions are one fewer than its tokens."""
    monkeypatch.setattr(language_model, "CELLS", cells)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(n))) for i, n in enumerate((900, 500, 193, 20, 1, 0))]
    row = blocks.token_blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), True).collect()[0].asDict()
    x = blocks.read_block(row)
    count = np.zeros(language_model.TAILS, np.int64)
    model = language_model.Model(np.zeros(0, np.uint64), count, count, 0, 0, 0)
    rng = np.random.default_rng(0)
    k = language_model.STATES
    pi, a, b = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k) / 9, k), rng.dirichlet(np.ones(model.classes), k).T.copy()
    classed = blocks.batch(language_model.CLASSED, language_model._classed(model)(row))
    out = np.frombuffer(next(language_model._expect((pi, a, b), 7, -1)([classed])).column("counts")[0].as_py())
    kinds = model.classify(blocks.word_keys(x.words), language_model.tails(x.words))
    want = sum(language_model.likelihood(table, live, pi, a, b).sum() for _, table, live, *_ in language_model.lanes(x, kinds, np.arange(len(x.ids))))
    assert abs(out[-1] - want) < 1e-6
    assert abs(out[:k].sum() - len(rows)) < 1e-6 and abs(out[k : k + k * k].sum() - x.lens.sum()) < 1e-6
    assert abs(out[k + k * k : -1].sum() - x.lens.sum() - len(rows)) < 1e-6


def test_scores_of_blocks_side_by_side(monkeypatch):
    """Scoring takes the documents of all blocks of a task through one recursion, and gives
    each block its own; vectors between two scalings do not vanish."""
    rng = np.random.default_rng(3)
    k = language_model.STATES
    pi, a, b = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(language_model.TAILS + 1), k).T.copy()
    b[:20] *= 1e-30
    lens = [[0, 300, 5], [], [41, 0], [8, 7, 1]]
    kinds = [rng.integers(0, 40, sum(n)).astype(np.uint16) for n in lens]
    rows = [(i, [*range(len(n))], blocks.packed(np.array(n, np.int32)), blocks.packed(c)) for i, (n, c) in enumerate(zip(lens, kinds))]
    calls, real = [], language_model.likelihood
    monkeypatch.setattr(language_model, "likelihood", lambda *x: (calls.append(1), real(*x))[1])
    parts = list(language_model._likelihoods((pi, a, b))([blocks.batch(language_model.CLASSED, [r]) for r in rows]))
    got = {r["block"]: np.frombuffer(r["low"]) for p in parts for r in p.to_pylist()}
    assert len(calls) == 1
    for i, (n, c) in enumerate(zip(lens, kinds)):
        assert len(got[i]) == len(n)
        for j, size in enumerate(n):
            at, x, want = sum(n[:j]), None, 0.0
            for t in [*c[at : at + size], language_model.TAILS]:
                x = (pi if x is None else x @ a) * b[t]
                want, x = want + np.log10(x.sum()), x / x.sum()
            assert abs(got[i][j] - want) < 1e-8


def test_every_round_trains_on_all_blocks(spark, monkeypatch):
    rows = [(i, f"w{i} a b c") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    seen, real = [], language_model._round
    monkeypatch.setattr(language_model, "_round", lambda b, *rest: (seen.append(sum(len(r["ids"]) for r in b.select("ids").collect())), real(b, *rest))[1])
    assert language_model.scored(docs).count() == 60
    assert len(seen) == 8 and set(seen) == {60}


def test_private_data_learns_on(spark):
    """Generations after the first, numbers across separators, and context after a word
    that is itself a candidate."""
    rows = [(i, f"please write to mailbox user{i}@site{i}.example.org about item") for i in range(6)]
    rows += [(20 + i, f"please write to mailbox root@host{chr(97 + i)} about item") for i in range(4)]
    rows += [(30 + i, f"the operator desk root@host{chr(97 + i)} knows") for i in range(4)]
    rows += [(40, "the operator desk chief@tower knows"), (41, "line2 mailbox 2 chief@gate about item")]
    rows += [(50 + i, f"my telephone number +1 555 123 456{i} is new") for i in range(6)] + [(60, "my telephone number (555) 123 4567 is new")]
    rows += [(70 + i, f"at level2 user{i}@site{i}.example.org sits") for i in range(6)] + [(80, "at level2 boss@home sits")]
    got = {r["doc_id"]: r["spans"] for r in private_data.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20].startswith("email:24:") and got[40] == "email:18:29"
    assert got[60] == "phone:20:34" and got[80] == "email:10:19"
