"""Readers, sinks and lowering, on texts made from the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.operators import graph as G
from arborlane.operators import lowering as L
from arborlane.plans.lineage import cut, shared_dir
from arborlane.plans.registry import EDGES, JOURNAL, RESULTS, query
from arborlane.sources import domain as D
from arborlane.sources import formats as R
from arborlane.sources import sinks as S


@query("read_manifests", "select 'pkg' || s_nationkey as package, 's' || s_suppkey as name, 'library' as kind, 's' || s_suppkey || '.c' as src, '//core:base' as dep from supplier")
def manifests(t):
    one = F.format_string('[library.s%d]\nsrcs = ["s%d.c"]\ndeps = ["//core:base"]\n', "s_suppkey", "s_suppkey")
    texts = t.supplier.select(F.concat(F.lit("pkg"), F.col("s_nationkey").cast("string")).alias("package"), one.alias("text"))
    m = R.manifests(texts, "package", "text")
    return m.select("package", "name", "kind", F.col("srcs")[0].alias("src"), F.col("deps")[0].alias("dep"))


@query("read_events", "with l as (select user_id as log, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as m, event_id % 50 = 0 as broken, event_id % 7 = 0 as other from events) select log, cast(count(*) filter (not broken and not other) as bigint) as events, cast(count(*) filter (broken and n < m) as bigint) as bad_middle, bool_or(broken and n = m) as truncated from l group by log having count(*) filter (broken or not other) > 0")
def events(t):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    good = F.to_json(F.struct(F.when(F.col("event_id") % 7 == 0, "other/9").otherwise("events/1").alias("schema"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.lit("x").alias("id")))
    lines = t.events.select(F.col("user_id").alias("log"), n.alias("n"), F.when(F.col("event_id") % 50 == 0, F.lit('{"schema": "events/1", "se')).otherwise(good).alias("text"))
    e = R.events(lines, "log", "n", "text")
    return e.groupBy("log").agg(F.count_if(F.col("bad").isNull()).alias("events"), F.count_if(F.col("bad") == "middle").alias("bad_middle"), F.bool_or(F.coalesce(F.col("bad") == "last", F.lit(False))).alias("truncated"))


@query("import_ninja", f"with {EDGES} select src as target, 'link' as rule, dst as input, exists (select 1 from edges f where f.src = e.dst) as is_dep from edges e")
def ninja(t):
    e = D.edges(t)
    lines = e.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("i")).select(F.format_string("build %s: link %s", "src", "i").alias("text"))
    return R.ninja(lines, "text")


@query("import_npm", f"with recursive {EDGES}, w as (select 's1' as name union select dst from edges join w on src = name) select name from w where name <> 's1'")
def npm(t):
    """The texts are written once, as the importer reads them twice."""
    named = D.edges(t).select(F.col("src").alias("name"), "dst").union(D.all_targets(t).select("name", F.lit(None).cast("string")))
    one = named.groupBy("name").agg(F.collect_list("dst").alias("dsts"))
    deps = F.when(F.size("dsts") > 0, F.map_from_arrays("dsts", F.transform("dsts", lambda _: F.lit("*"))))
    texts = cut(one.select(F.to_json(F.struct("name", deps.alias("dependencies"))).alias("text")))
    return G.reachable(R.npm(texts, "text"), t.spark.createDataFrame([("s1",)], "name string")).filter("name <> 's1'")


@query("read_gcov", "select 's' || l_suppkey as file, cast(l_partkey % 50 as bigint) as line, cast(sum(cast(l_quantity as bigint)) as bigint) as count from lineitem group by 1, 2")
def gcov(t):
    line = F.struct((F.col("l_partkey") % 50).alias("line_number"), F.col("l_quantity").cast("long").alias("count"))
    f = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(line).alias("lines"))
    texts = f.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(D.node("s", "l_suppkey").alias("file"), "lines")).alias("files"))).alias("text"))
    return R.gcov(texts, "text").groupBy("file", "line").agg(F.sum("count").alias("count"))


@query("read_settings", "with s as (select o_custkey % 30 as k, o_orderkey % 3 as layer, o_orderkey as n, case when o_orderkey % 11 = 0 then 'false' else o_orderpriority end as v from orders), r as (select *, row_number() over (partition by k order by layer desc, n desc) as i from s) select 'k' || k as key, v as value, layer, n as line from r where i = 1 and v <> 'false'")
def settings(t):
    value = F.when(F.col("o_orderkey") % 11 == 0, "false").otherwise(F.col("o_orderpriority"))
    lines = t.orders.select((F.col("o_orderkey") % 3).alias("layer"), F.col("o_orderkey").alias("n"), F.concat(F.lit("build --k"), (F.col("o_custkey") % 30).cast("string"), F.lit("="), value).alias("text"))
    return R.settings(lines, "layer", "n", "text")


@query("sink_journal", f"with {JOURNAL}, r as (select *, row_number() over (partition by id order by seq desc) as k from journal) select id, seq, duration from r where k = 1")
def sink_journal(t):
    at = f"{shared_dir(t.spark)}/journal-{uuid.uuid4().hex}"
    j = D.journal(t).select("id", "seq", "duration")
    S.append(j.filter("seq % 2 = 0"), f"{at}/log")
    S.append(j.filter("seq % 2 = 1"), f"{at}/log")
    return S.compacted(t.spark, f"{at}/log", f"{at}/compact").select("id", "seq", "duration")


@query("sink_put_new", "select cast(count(*) as bigint) as stored from (select distinct user_id from events)")
def sink_put(t):
    at = f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}"
    rows = t.events.select("user_id", "props")
    S.put_new(rows.filter("user_id % 2 = 0"), at, "user_id")
    return t.spark.createDataFrame([(S.put_new(rows, at, "user_id"),)], "stored long")


@query("sink_json_lines", """select '{"seq":' || (row_number() over (partition by user_id order by event_id) - 1) || ',"event":"' || event_type || '","detail":' || case when event_type = 'error' then '"e' || event_id || '"' else 'null' end || '}' as line from events""")
def sink_json(t):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return S.json_lines(t.events.select(n.alias("seq"), F.col("event_type").alias("event"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("detail")))


@query("sink_junit", f"""with {RESULTS}, s as (select kind, count(*) as n, count(*) filter (outcome = 'failed') as f, count(*) filter (outcome = 'skipped') as k, cast(sum(duration) as bigint) as ms from results group by kind)
  select '<testsuite name="' || kind || '" tests="' || n || '" failures="' || f || '" errors="0" skipped="' || k || '" time="' || (ms // 1000) || '.' || lpad(cast(ms % 1000 as varchar), 3, '0') || '"/>' as line from s""")
def sink_junit(t):
    o = F.col("outcome")
    s = D.results(t).groupBy(F.col("kind").alias("suite")).agg(F.count("*").alias("tests"), F.count_if(o == "failed").alias("failures"), F.lit(0).alias("errors"), F.count_if(o == "skipped").alias("skipped"), F.sum("duration").alias("ms"))
    return S.junit_xml(s)


@query("sink_dot", f"""with {EDGES} select '  "' || src || '" -> "' || dst || '";' as line from edges""")
def sink_dot(t):
    return S.dot(D.edges(t))


_KIND = "case p_partkey % 4 when 0 then 'library' when 1 then 'program' when 2 then 'rule' else 'test' end"


@query("lower_targets", f"""with t as (select 'p' || p_partkey as name, {_KIND} as kind, ['a' || p_partkey || '.c', 'b' || p_size || '.c'] as srcs, p_size % 4 as shards from part),
  e as (select name, unnest(srcs) as src from t where kind in ('library', 'program')),
  s as (select name, srcs, shards, unnest(range(0, greatest(shards, 1))) as i from t where kind = 'test')
  select 'compile:' || name || ':' || src as id, 'compile' as kind, name as target, src as input, src || '.o' as output from e
  union all select case kind when 'library' then 'archive:' else 'link:' end || name, case kind when 'library' then 'archive' else 'link' end, name, srcs[1] || '.o ' || srcs[2] || '.o', name || case kind when 'library' then '.a' else '' end from t where kind in ('library', 'program')
  union all select 'rule:' || name, 'rule', name, srcs[1] || ' ' || srcs[2], name || '.out' from t where kind = 'rule'
  union all select 'test:' || name || case when shards > 1 then '#' || i || '/' || shards else '' end, 'test', name, srcs[1] || ' ' || srcs[2], 'test:' || name || case when shards > 1 then '#' || i || '/' || shards else '' end || '.log' from s""")
def lower(t):
    m = F.col("p_partkey") % 4
    kind = F.when(m == 0, "library").when(m == 1, "program").when(m == 2, "rule").otherwise("test")
    srcs = F.array(F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit(".c")), F.concat(F.lit("b"), F.col("p_size").cast("string"), F.lit(".c")))
    return L.lowered(t.part.select(D.node("p", "p_partkey").alias("name"), kind.alias("kind"), srcs.alias("srcs"), (F.col("p_size") % 4).alias("shards")))


@query("platform_overlay", "select p_partkey as id, case when p_size % 2 = 0 then 'x' || p_size else 's' || p_size end as srcs, case when p_size % 2 = 0 then '-O,-m' || p_size else '-O' end as flags from part")
def platform(t):
    size = F.col("p_size").cast("string")
    base = t.part.select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("s"), size)).alias("srcs"), F.array(F.lit("-O")).alias("flags"))
    over = t.part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("x"), size)).alias("srcs"), F.array(F.concat(F.lit("-m"), size)).alias("flags"))
    x = L.overlaid(base, over, "id", ["srcs"], ["flags"])
    return x.select("id", F.array_join("srcs", ",").alias("srcs"), F.array_join("flags", ",").alias("flags"))


@query("test_options", f"select p_partkey as id, 'run' || case when {_KIND} = 'test' then ',-v' else '' end as argv, case when {_KIND} = 'test' then 'HOME=h,MODE=ci' else 'HOME=h' end as env, case when {_KIND} = 'test' then 'PATH' else 'MODE,PATH' end as pass_env from part")
def test_options(t):
    m = F.col("p_partkey") % 4
    a = t.part.select(F.col("p_partkey").alias("id"), F.when(m == 3, "test").otherwise("other").alias("kind"), F.array(F.lit("run")).alias("argv"), F.create_map(F.lit("HOME"), F.lit("h")).alias("env"), F.array(F.lit("MODE"), F.lit("PATH")).alias("pass_env"))
    x = L.with_test_options(a, ["-v"], {"MODE": "ci"})
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("env")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return x.select("id", F.array_join("argv", ",").alias("argv"), shown.alias("env"), F.array_join("pass_env", ",").alias("pass_env"))


@query("delta_gate")
def delta_gate(t):
    w = W.partitionBy("source", "lang").orderBy("doc_id")
    x = t.documents.select("doc_id", F.lag("text").over(w).alias("old"), F.col("text").alias("new"))
    return L.deltas(x, "doc_id", "old", "new")


@query("stable_ids", "select o_orderkey as id, o_orderkey || '@linux@' || case when o_orderkey % 2 = 0 then 'debug' else 'release' end as journal_id from orders")
def ids(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat_ws("@", F.col("o_orderkey").cast("string"), F.lit("linux"), F.when(F.col("o_orderkey") % 2 == 0, "debug").otherwise("release")).alias("journal_id"))


@query("affected_by_sources", f"with recursive {EDGES}, w as (select 's1' as name union select src from edges join w on dst = name) select name from w where name in (select 'o' || o_orderkey from orders where o_orderstatus = 'F')")
def affected(t):
    w = G.reachable(G.flipped(D.edges(t)), t.spark.createDataFrame([("s1",)], "name string"))
    return w.join(t.orders.filter("o_orderstatus = 'F'").select(D.node("o", "o_orderkey").alias("name")), "name", "left_semi")


@query("closure_sizes", f"with recursive {EDGES}, w as (select src as root, dst as name from edges where src like 'c%' or src like 's%' union select root, dst from edges join w on src = name) select root, cast(count(*) as bigint) as size from w group by root")
def closure_sizes(t):
    e = G.held(D.edges(t))
    return G.closure_sizes(e, e.filter("src like 'c%' or src like 's%'").select(F.col("src").alias("root")))


@query("closure_sizes_all", f"with recursive {EDGES}, w as (select src as root, dst as name from edges union select root, dst from edges join w on src = name) select root, cast(count(*) as bigint) as size from w group by root")
def closure_sizes_all(t):
    """Of every node with an edge: closure_sizes has the customers and suppliers only."""
    return G.closure_sizes(D.edges(t))
