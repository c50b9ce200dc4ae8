"""The ten corpus operators against brute force on small tables: nulls, empty and very
long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from arborlane.llm import bpe, exact_dedup, graph, language_model, mixing, ngram_join, private_data, quality_classifier, quality_rules, substring_dedup, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RND = random.Random(17)
WORDS = [f"w{i}" for i in range(400)] + ["Été", "a", "the", "THE", "x&y", "#", "中文"]


def _text(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def _docs():
    rnd = random.Random(5)
    base = _text(300, rnd).split(" ")
    out = [None, "", " \n\t ", "one", "one two three", _text(49, rnd), _text(50, rnd), "a " * 300, "ab " * 120 + "cd " * 80, "x" * 30_000, _text(6_000, rnd)]
    out += [_text(rnd.randrange(1, 260), rnd) for _ in range(25)]
    for _ in range(12):  # near copies
        w = list(base)
        for _ in range(rnd.randrange(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        out.append(" ".join(w))
    passage = _text(70, rnd)
    out += [_text(rnd.randrange(0, 60), rnd) + "\n" + passage + " " + _text(rnd.randrange(0, 60), rnd) for _ in range(8)]
    out += [out[20], out[20], out[21], out[11].upper(), out[12].replace(" ", "  \n")]
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    rows = [(i, t, "en", rnd.choice(["a", "b", "c", None]), len(t or "")) for i, t in zip(ids, out)]
    return rows + [rows[-1], rows[-1], rows[15]]


ROWS = _docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns named like what the operators use themselves."""
    return docs.withColumns({k: F.lit("?") for k in ("kept", "n", "host", "key", "score", "set", "block", "ids", "part", "node", "__score", "label", "__n", "copies")})


def _split(text):
    return (text or "").encode().split()


# 1 ------------------------------------------------------------------------------------


def test_mixing(docs):
    got = [r.asDict() for r in mixing.sampled(docs).collect()]
    assert len(got) == len(ROWS)
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in mixing.sampled(docs).collect())
    source = {r[0]: r[3] for r in ROWS}
    size = collections.Counter()
    for i, t, _, s, _ in ROWS:
        size[s] += len(_split(t))
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while free:  # share out, stop the full, share again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in full} if full else share
        free = free - full if full else set()
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(_split(next(t for i, t, *_ in ROWS if i == r["doc_id"])))
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert abs(sum(target.values()) - total) < 1e-6
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.25 * target[s] + 50


def test_mixing_targets(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (1, "b"), (1, "c"), (50, None)])]
    got = {r["doc_id"]: r["target"] for r in mixing.sampled(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] == 3 and got[2] == 3 and abs(got[0] - 73) < 1e-9 and abs(got[3] - 73) < 1e-9


def test_mix_rows(docs, clashing, none):
    copies = collections.Counter()  # rows that repeat are taken one by one
    for r in mixing.sampled(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    n = collections.Counter(r["doc_id"] for r in mixing.mix(clashing).collect())
    assert n == +copies
    assert mixing.mix(clashing).columns == clashing.columns
    assert mixing.mix(none).isEmpty() and mixing.sampled(none).isEmpty()


# 2 ------------------------------------------------------------------------------------


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(rows):
    sets = {i: _shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs):
    want = _components(ROWS)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_near_duplicates_split(docs, monkeypatch):
    """The same result when every region is too large: cells by Spark, then pairs of parts."""
    monkeypatch.setattr(ngram_join, "REGION_SHINGLES", 600)
    monkeypatch.setattr(ngram_join, "SPLITS", 1)
    got = ngram_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _components(ROWS)


def test_region_cells(monkeypatch):
    """Voronoi cells with windows lose no link of a region."""
    import numpy as np

    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    rnd = random.Random(3)
    for _ in range(20):
        sets = []
        for _ in range(4):
            base = set(rnd.sample(range(300), 40))
            for _ in range(6):
                sets.append(np.array(sorted(base - set(rnd.sample(sorted(base), rnd.randrange(6))) | set(rnd.sample(range(300), rnd.randrange(6)))), np.uint64))
        region = ngram_join.Region(list(range(len(sets))), sets, [rnd.random() for _ in sets])
        region.join()
        plain = [{*s.tolist()} for s in sets]
        root = list(range(len(sets)))

        def find(i):
            return i if root[i] == i else find(root[i])

        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b]):
                    root[find(a)] = find(b)
        for a in range(len(sets)):
            for b in range(a):
                assert (find(a) == find(b)) == (region.root[a] == region.root[b])


def test_one_of_each(clashing, none):
    want = _components(ROWS)
    kept = ngram_join.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}
    assert ngram_join.near_duplicates(none).isEmpty()


@pytest.mark.parametrize("pack", [250_000, 40])
def test_components(spark, monkeypatch, pack):
    monkeypatch.setattr(graph, "PACK_EDGES", pack)
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rnd.randrange(90), 100 + rnd.randrange(90)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 3 ------------------------------------------------------------------------------------

URLS = [None, "", "no scheme.com/en/", "http://a.COM/en/x?q", "https://sub.a.com/EN/x", "http://example.com/en/77#f", "http://www.example.com/en/8", "http://xexample.com/en/7", "http://com/en/", "ftp://n.example.net/de/8/9",
        "http://net/de/", "http://org/es", "http://org/es/", "http://x.org/es/?", "http://h", "http:///en/", "a://b://com/en/", "http://a.com/en/x?q", "http://.com/en/1"]


def _judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.split(r"[?#]", rest[len(host) :])[0]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)] + [(3, URLS[3])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(map(tuple, url_filters.query(df).collect()), key=repr)
    assert got == sorted(((i, *_judge(u, url_filters.RULES)) for i, u in rows), key=repr)
    assert url_filters.query(df.limit(0)).isEmpty()
    extra = df.withColumns({k: F.lit("?") for k in ("host", "rule", "verdict", "key", "__n", "len")})
    same = url_filters.judged(extra, url_filters.rule_table(spark, url_filters.RULES))
    assert sorted(map(tuple, same.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == got
    assert same.filter("key = '?' and __n = '?' and len = '?'").count() == len(rows)


def test_urls_many_rules(spark):
    rnd = random.Random(9)
    hosts = ["a.b.c", "b.c", "c", "x.c", "d.e", "e"]
    rules = [(rnd.choice(hosts), "/" + "".join(rnd.choice("ab/") for _ in range(rnd.randrange(6))), rnd.choice(["allow", "block"])) for _ in range(60)]
    table = url_filters.rule_table(spark, rules)
    rules = [(r["host"], r["path"], r["verdict"]) for r in table.collect()]
    rows = [(i, f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}/{''.join(rnd.choice('ab/') for _ in range(rnd.randrange(9)))}") for i in range(300)]
    got = url_filters.judged(spark.createDataFrame(rows, "page_id long, url string"), table).collect()
    for r in got:
        want = _judge(r["url"], rules)
        assert (r["host"], r["path"]) == want[:2] and len(r["rule"] or "") == len(want[2] or "")


# 4 ------------------------------------------------------------------------------------


def test_language_model(docs, none):
    got = language_model.scored(docs).collect()
    assert len(got) == len(ROWS)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter()
    for i, t, *_ in ROWS:
        if not held(i):
            count.update((t or "").encode().lower().split())
            count[None] += 1
    n, v = sum(count.values()), len(count)
    text = {i: (t or "").encode().lower().split() for i, t, *_ in ROWS}
    for r in got:
        w = [*text[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert language_model.scored(none).isEmpty()


def test_forward_is_exact():
    """The scaled recursion, pieces of lanes and all, against sums over all state paths."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    pi, a, b = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T
    table = np.array([[0, 1, 2], [1, 1, 2], [2, 0, 2], [0, 2, 2]], np.int32)
    live = np.array([3, 2, 2, 1])
    flat = np.concatenate([table[t, :n] for t, n in enumerate(live)])
    got = language_model.likelihood(flat, live, pi, a, b)
    starts, pairs, emitted, ll = language_model.expected(flat, live, pi, a, b)
    want = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for lane, size in enumerate((4, 3, 1)):
        chance = {s: np.prod([pi[s[0]] * b[table[0, lane], s[0]], *(a[s[t - 1], s[t]] * b[table[t, lane], s[t]] for t in range(1, size))]) for s in itertools.product((0, 1), repeat=size)}
        for s, p in chance.items():
            p /= sum(chance.values())
            want[0][s[0]] += p
            for t in range(size):
                want[2][s[t], table[t, lane]] += p
                if t:
                    want[1][s[t - 1], s[t]] += p
        total = sum(np.prod([pi[s[0]] * b[table[0, lane], s[0]], *(a[s[t - 1], s[t]] * b[table[t, lane], s[t]] for t in range(1, size))]) for s in itertools.product((0, 1), repeat=size))
        assert abs(got[lane] - math.log10(total)) < 1e-9
    assert abs(ll - got.sum()) < 1e-9
    assert all(np.abs(x - y).max() < 1e-9 for x, y in zip((starts, pairs, emitted), want))


# 5 ------------------------------------------------------------------------------------


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe(docs, clashing, none, spark):
    t = _library()
    odd = [(10_000, "x" * 25_000 + " b <|endoftext|>c " + "abcde!?'s" * 3_000), (10_001, "Z<|startoftext|>" * 2_000 + "İ"), (10_002, "A b\x1cd H\u0331 e\u0301"), (10_003, "don't" * 6_000 + "\u00a0q"), (10_004, "the cat's  1é <|endoftext|>\n" * 700), (10_005, " " * 9_000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    whole = bpe.encoded(df, bpe.vocabulary(), long=500, leaf=70).collect()
    dealt = bpe.encoded(df, bpe.vocabulary(), long=500, spread=5_000, leaf=700).collect()
    assert len(whole) == len(dealt) == len(ROWS) + len(odd)
    for r in whole + dealt:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)
    same = bpe.encoded(clashing, bpe.vocabulary())
    assert same.columns == [*[c for c in clashing.columns if c != "ids"], "ids", "decoded"] and same.count() == len(ROWS)
    assert bpe.query(none).isEmpty()


def test_bpe_joins():
    """Trees of small leaves against the encoding of the whole."""
    path, rnd = bpe.vocabulary(), random.Random(1)
    for _ in range(150):
        letters = rnd.choice(["abcdefghij", "aab", "a'streldm!?.", "abé1!中é", "0123a", "'sre"])
        text = bpe.load(path)[0].normalizer.normalize_str("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 500))))
        assert bpe.encode_tree(path, text, rnd.choice([3, 17, 40])).ids.tolist() == bpe.load(path)[1].encode(text, add_special_tokens=False).ids


def test_bpe_long_texts():
    """Texts with white space, marks and special tokens, cut at any place, against the library."""
    path, rnd, t = bpe.vocabulary(), random.Random(2), _library()
    for _ in range(600):
        letters = rnd.choice(["a'streldm!?. ", "abé1!中é ", "the cat's ", "İ\u0301a '  b", "🙂\u200d🙂ab'll ", "Σσς! \x1c\u00a0"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 300)))
        text = text.replace("a", "<|endoftext|>") if rnd.random() < 0.2 else text
        assert bpe.encode_long(path, text, rnd.choice([1, 2, 7, 17, 40])) == t.encode(text, add_special_tokens=False).ids
    assert bpe.encode_long(path, " " * 100, 7) == []


# 6 ------------------------------------------------------------------------------------

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def _private(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, f in FORMS.items() for m in re.finditer(f, text or "") if _passes(k, m.group())]


def test_private_data(spark, docs, none):
    rnd = random.Random(5)
    parts = ["a@b.co", "_x@y.z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", " ", "\n", "é", "foo", "12", ".", "-", "@", "+", "0001.002.3.4", "😀", "9" * 20, "%", "__"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(200)]
    rows += [(900, None), (901, "1 " * 3000), (902, "a" * 20_000 + " " + "1." * 5_000 + "@" * 3_000), (903, "a@" + "b." * 12_000 + "c")]
    got = private_data.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    for r in got:
        want = _private(text[r["doc_id"]])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == r["base_sha256"]
        assert set(want) <= set(r["spans"].split(",")) or not want
        assert [r[f"n_{k}"] for k in FORMS] == [sum(w.startswith(k) for w in want) for k in FORMS]
    assert private_data.query(docs).count() == len(ROWS) and private_data.query(none).isEmpty()


def test_private_data_learns(spark):
    """Addresses after the same words teach the context of one without a full form."""
    rows = [(i, f"please write to mailbox user{i}@site{i}.example.org about item") for i in range(6)] + [(90, "please write to mailbox admin@localhost about item"), (91, "the admin@otherhost never")]
    got = {r["doc_id"]: r for r in private_data.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90]["n_added"] == 1 and got[90]["spans"] == "email:24:39"
    assert got[91]["n_added"] == 0 and got[0]["n_added"] == 0


# 7 ------------------------------------------------------------------------------------


def test_classifier(spark, none):
    rnd = random.Random(4)
    clean = lambda: " ".join(rnd.choice(["Then", "over", "river", "and,", "walking", "home.", "slowly", "the"]) for _ in range(60))
    junk = lambda: " ".join(rnd.choice(["AB!!", "CD###", "EF$$$", "GH&&&"]) for _ in range(60))
    rows = [(i, clean() if i % 3 else junk(), "?") for i in range(240)] + [(900, None, "?"), (901, "", "?"), (902, "word", "?"), (5, clean(), "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __score string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(200)] + [(None, 1, 0), (3, None, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.query(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] < 240 and r["doc_id"] != 5:
            assert r["predicted"] == int(bool(r["doc_id"] % 3))
    assert {r["score"] for r in quality_classifier.query(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.query(docs.limit(0), labels).isEmpty()
    left = quality_classifier.accepted(docs, labels)
    assert left.columns == docs.columns and {r["__score"] for r in left.collect()} == {"?"}
    assert {r["doc_id"] for r in left.collect()} >= {i for i in range(240) if i % 3}
    held = quality_classifier.query(docs, labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, got))  # held-out labels teach nothing


# 8 ------------------------------------------------------------------------------------


def test_rules(docs, none):
    for r in quality_rules.query(docs).collect():
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"]) or ""
        w = [x.decode() for x in _split(text)]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.query(none).isEmpty()


def test_cascade_order(docs, clashing):
    """The verdict is that of all rules, whatever their order."""
    want = {(r["doc_id"], r["kept"]) for r in quality_rules.measured(docs).collect()}
    m = quality_rules.measures(F.col("text"))
    for order in (list(quality_rules.RULES), list(quality_rules.RULES)[::-1]):
        assert {(r["doc_id"], r["k"]) for r in docs.select("doc_id", quality_rules.verdict(m, order).alias("k")).collect()} == want
    assert {(r["doc_id"], r["kept"]) for r in quality_rules.judged(clashing).collect()} == want
    found = quality_rules.ordered_rules(docs)
    assert {x[0] for x in found} == set(quality_rules.RULES) and all(0 <= x[2] <= 1 for x in found)


# 9 ------------------------------------------------------------------------------------


def test_exact(docs, clashing, none):
    group = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        group[t or ""].append(i)
    text = {i: t or "" for i, t, *_ in ROWS}
    got = exact_dedup.query(docs).collect()
    assert len(got) == len(ROWS)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(group)
    for r in got:
        t = text[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (max(group[t]), len(group[t]), hashlib.sha256(t.encode()).hexdigest())
    left = exact_dedup.drop_exact_copies(clashing)
    assert left.columns == clashing.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(max(v) for v in group.values())
    assert exact_dedup.query(none).isEmpty() and exact_dedup.drop_exact_copies(none).isEmpty()


def test_exact_same_prefix(spark):
    """Equal lengths and prefixes, other endings."""
    rows = [(i, "p" * 300 + str(i % 4)) for i in range(12)] + [(None, "p" * 300 + "0")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"]) for r in got) == sorted([(i, 8 + i % 4, 3 + (i % 4 == 0)) for i in range(12)] + [(-1, 8, 4)])


# 10 -----------------------------------------------------------------------------------


def test_substrings(docs, none):
    low = {}
    words = {i: _split(t) for i, t, *_ in ROWS}
    for i, w in words.items():
        for k in range(len(w) - 49):
            s = tuple(w[k : k + 50])
            low[s] = min(low.get(s, i), i)
    got = substring_dedup.query(docs).collect()
    assert len(got) == len(ROWS) and any(r["n_removed"] for r in got)
    for r in got:
        w = words[r["doc_id"]]
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if low[tuple(w[k : k + 50])] < r["doc_id"]:
                keep[k : k + 50] = [False] * 50
        left = b" ".join(x for x, y in zip(w, keep) if y)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), keep.count(False), hashlib.sha256(left).hexdigest())
    assert substring_dedup.query(none).isEmpty()


def test_anchors_agree():
    """Equal windows have equal anchors, whatever stands around them."""
    import numpy as np

    from arborlane.llm import blocks

    rnd = random.Random(1)
    some = lambda n, v: [b"w%d" % rnd.randrange(v) for _ in range(n)]
    shared = [some(80, 50) for _ in range(4)] + [[b"a"] * 200, [b"a", b"b"] * 60]
    seen = {}
    for _ in range(12):
        found = []
        for _ in range(10):
            d = some(rnd.randrange(80), rnd.choice([2, 50, 1000]))
            for _ in range(rnd.randrange(3)):
                d += rnd.choice(shared)[rnd.randrange(20) :] + some(rnd.randrange(5), 50)
            found.append(d)
        lens = np.array([len(d) for d in found])
        names = substring_dedup.anchors(blocks.word_keys([w for d in found for w in d]), (np.cumsum(lens) - lens)[lens > 0], 50)
        at = 0
        for d in found:
            for k in range(len(d) - 49):
                assert seen.setdefault(tuple(d[k : k + 50]), names[at + k]) == names[at + k]
            at += len(d)
