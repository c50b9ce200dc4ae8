"""Cases in which a query once did less than its whole job."""

import random


def test_closure_sizes_of_every_node(spark, sf_dir):
    """Orders and parts have closures too; its SQL is checked with all others."""
    from arborlane.plans import catalog

    got = {r["root"][0] for r in catalog.queries()["closure_sizes_all"](spark, sf_dir).select("root").collect()}
    assert got == set("opcsn")


def test_content_sketch_reads_whole_texts(spark):
    """Texts that differ only after the first 64 characters of a chunk differ in sketch."""
    import types

    from arborlane.plans import content_queries

    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(512))
    docs = spark.createDataFrame([(1, text), (2, text[:64] + text[64:][::-1]), (3, text)], "doc_id long, text string")
    got = {}
    for r in content_queries.content_sketch(types.SimpleNamespace(documents=docs)).collect():
        got.setdefault(r["doc_id"], set()).add(r["h"])
    assert got[1] == got[3] and got[1] != got[2]


def test_sketch_reads_whole_chunks(spark):
    """As above, for chunks of fixed length."""
    import types

    from arborlane.plans import content_queries

    docs = spark.createDataFrame([(1, "a" * 511 + "b"), (2, "a" * 511 + "c"), (3, "a" * 511 + "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["h"] for r in content_queries.sketch(types.SimpleNamespace(documents=docs)).collect()}
    assert got[1] == got[3] != got[2]


def _spied(monkeypatch, module, seen):
    """Counts rows of what a module cuts."""
    cut = module.cut

    def spy(df):
        out = cut(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", spy)


def test_closure_sizes_do_not_write_all_pairs(spark, monkeypatch):
    """400 roots that reach 60 nodes each have 24,000 pairs."""
    from arborlane.operators import graph as G

    rows = [(f"a{i}", f"b{j}") for i in range(400) for j in range(3)] + [(f"b{j}", f"c{k}") for j in range(3) for k in range(57)]
    seen = []
    _spied(monkeypatch, G, seen)
    got = {r["root"]: r["size"] for r in G.closure_sizes(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {f"a{i}": 60 for i in range(400)} | {f"b{j}": 57 for j in range(3)}
    assert sum(seen) < 10_000


def test_closure_sizes_of_any_graph(spark, monkeypatch):
    """Cycles, repeated edges, and limits that are reached, against a plain search."""
    from arborlane.operators import graph as G

    monkeypatch.setattr(G, "BATCH_SETS", 40, raising=False)
    monkeypatch.setattr(G, "TASK_SETS", 7, raising=False)
    monkeypatch.setattr(G, "ROW_SET", 9, raising=False)
    monkeypatch.setattr(G, "BROADCAST_NAMES", 3)
    rnd = random.Random(5)
    for back in (0, 3):
        e = [(a, (a // 8 + 1) * 8 + rnd.randrange(8)) for a in range(24) for _ in range(2)] + [(rnd.randrange(16, 24), rnd.randrange(8, 16)) for _ in range(back)]
        after = {}
        for a, b in e:
            after.setdefault(f"n{a}", set()).add(f"n{b}")
        sizes = {}
        for a in after:
            found, todo = set(), [a]
            while todo:
                for b in after.get(todo.pop(), ()):
                    if b not in found:
                        found.add(b)
                        todo.append(b)
            sizes[a] = len(found)
        df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in e + e[:5]], "src string, dst string")
        assert {r["root"]: r["size"] for r in G.closure_sizes(df).collect()} == sizes
        some = spark.createDataFrame([("n1",), ("n20",), ("n31",)], "root string")
        assert {r["root"]: r["size"] for r in G.closure_sizes(df, some).collect()} == {r: sizes[r] for r in ("n1", "n20")}


def test_cut_is_in_columns(spark):
    from arborlane.plans.lineage import cut

    x = cut(spark.range(10).repartition(3))
    assert "parquet" in x._jdf.queryExecution().toString() and x.count() == 10


def test_one_task_reads_the_closure_only(spark):
    """edges are left out by many tasks, not by the one that walks the rest."""
    from pyspark.sql import functions as F

    from arborlane.operators import graph as G

    e = spark.range(1000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("src"), F.lit("b").alias("dst")).filter("src like 'a9%'")
    got = G.reachable(e, spark.createDataFrame([("a9",)], "name string"), method="task")
    assert "LIKE" not in got._jdf.queryExecution().toString() and "StartsWith" not in got._jdf.queryExecution().toString()
    assert sorted(r[0] for r in got.collect()) == ["a9", "b"]


def test_distinct_tasks_grow_with_the_table(spark, sf_dir, monkeypatch):
    """F4, F13 to F15: a task holds TASK_ROWS rows or so."""
    from arborlane.sources import domain as D

    t = D.Tables(spark, sf_dir)
    whole = {n: sorted(map(tuple, f(t).collect())) for n, f in (("edges", D.edges), ("targets", D.all_targets))}
    monkeypatch.setattr(D, "TASK_ROWS", 500)
    for n, f in (("edges", D.edges), ("targets", D.all_targets)):
        assert "REPARTITION_BY_NUM" in f(t)._jdf.queryExecution().toString()
        assert sorted(map(tuple, f(t).collect())) == whole[n]
    assert whole["targets"] == sorted(map(tuple, D.targets(D.edges(t)).collect()))


def test_targets_of_missing_keys(spark):
    import types

    from arborlane.sources import domain as D

    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    t = types.SimpleNamespace(
        lineitem=f([(1, 2, None), (None, None, 3), (1, 2, None)], "l_orderkey long, l_partkey long, l_suppkey long"), orders=f([(1, None), (4, 5)], "o_orderkey long, o_custkey long"),
        customer=f([(5, None)], "c_custkey long, c_nationkey int"), supplier=f([(3, 1)], "s_suppkey long, s_nationkey int"), nation=f([(1, 0)], "n_nationkey int, n_regionkey int"))
    key = lambda x: sorted(repr(tuple(r)) for r in x.collect())
    assert key(D.all_targets(t)) == key(D.targets(D.edges(t)))


def test_sweep_is_simulation(spark):
    """shortcuts for one worker and for as many as actions give what a simulation gives."""
    from arborlane.operators import schedule as S

    rnd = random.Random(8)
    graphs = {f"g{g}": [(i, rnd.randrange(0, 9), rnd.randrange(0, 9), sorted({rnd.randrange(i) for _ in range(rnd.randrange(3))}) if i else []) for i in range(rnd.randrange(1, 9))] for g in range(40)}
    df = spark.createDataFrame([(g, *a) for g, x in graphs.items() for a in x], "graph string, pos int, duration long, guess long, needs array<int>")
    got = {tuple(r) for r in S.sweep(df, ("fifo", "critical", "longest"), (1, 2, 4, 8)).collect()}
    want = set()
    for g, x in graphs.items():
        d, guess, needs = ([a[k] for a in x] for k in (1, 2, 3))
        for s, p in (("fifo", [0] * len(d)), ("critical", S.ranks(guess, needs)), ("longest", guess)):
            want |= {(g, s, n, S.simulate(d, needs, p, n), sum(d), max(S.ranks(d, needs))) for n in (1, 2, 4, 8)}
    assert got == want


def test_chunks_go_to_python_in_small_batches(spark):
    """F16."""
    from arborlane.operators import content as C

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = C.content_chunks(spark.range(70).selectExpr("id as doc_id", "repeat('ab', 100) as text"), "doc_id", "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    assert {r["doc_id"] for r in got.collect()} == set(range(70))
