"""Queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.operators import graph as G
from arborlane.plans.registry import ACTIONS, EDGES, TARGETS, query
from arborlane.sources import domain as D

WALK_UP = f"with recursive {EDGES}, {TARGETS}, w as (select 'r0' as name union select src from edges join w on dst = name)"
WALK_DOWN = f"with recursive {EDGES}, {TARGETS}, w as (select 'o1' as name union select dst from edges join w on src = name)"


def _root(t, name):
    return t.spark.createDataFrame([(name,)], "name string")


def _edges(t):
    """The edges, written once for all that a query asks of them."""
    return G.held(D.edges(t))


def _up(t, e=None):
    e = e or _edges(t)
    return G.reachable(G.flipped(e), _root(t, "r0"))


@query("graph_deps", WALK_DOWN + " select name from w")
def deps(t):
    return G.reachable(D.edges(t), _root(t, "o1"))


@query("graph_rdeps", WALK_UP + " select name from w")
def rdeps(t):
    return _up(t)


@query("graph_rdeps_kinds", WALK_UP + " select kind, cast(count(*) as bigint) as n from w join targets using (name) group by kind")
def rdeps_kinds(t):
    return _up(t).groupBy(D.kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


@query("graph_rdeps_kind", WALK_UP + " select name from w where name like 's%'")
def rdeps_kind(t):
    return _up(t).filter(D.kind(F.col("name")) == "s")


@query("graph_deps_task", WALK_DOWN + " select name from w")
def deps_task(t):
    e = _edges(t)
    start = G.reachable(e, _root(t, "o1"))  # edges of the closure only
    return G.reachable(e.join(start.withColumnRenamed("name", "src"), "src", "left_semi"), _root(t, "o1"), method="task")


@query("graph_attr_deps", f"with {EDGES} select distinct src as name from edges where regexp_matches(dst, '^p1[^/]*$')")
def attr_deps(t):
    return D.edges(t).filter(F.regexp_like("dst", F.lit("^p1[^/]*$"))).select(F.col("src").alias("name")).distinct()


@query("graph_owners", f"with {ACTIONS} select distinct target from actions where regexp_matches(path, '^p[12][0-9]$')")
def owners(t):
    return D.actions(t).filter(F.regexp_like("path", F.lit("^p[12][0-9]$"))).select("target").distinct()


@query("graph_targets", f"with {EDGES}, {TARGETS} select name, kind from targets")
def targets(t):
    return D.all_targets(t)


@query("graph_kind_counts", f"with {EDGES}, {TARGETS} select kind, cast(count(*) as bigint) as n from targets group by kind")
def kinds(t):
    return D.all_targets(t).groupBy("kind").agg(F.count("*").alias("n"))


PATHS = f"""with recursive {EDGES}, p as (
  select 'o1' as node, ['o1'] as path union all select dst, list_append(path, dst) from edges join p on src = node where not list_contains(path, dst))"""


@query("graph_allpaths", PATHS + " select array_to_string(path, '/') as path from p where node like 'r%' order by path limit 4096")
def allpaths(t):
    e = _edges(t)
    near = G.reachable(e, _root(t, "o1"))
    sub = e.join(near.withColumnRenamed("name", "src"), "src", "left_semi")
    return G.all_paths(sub, "o1", 4096, F.startswith("node", F.lit("r")))[0].select(F.array_join("path", "/").alias("path"))


@query("graph_allpaths_members", PATHS + " select distinct m as name from (select unnest(path) as m from p where node like 'r%') where m like 's%'")
def allpaths_members(t):
    e = _edges(t)
    near = G.reachable(e, _root(t, "o1"))
    sub = e.join(near.withColumnRenamed("name", "src"), "src", "left_semi")
    p = G.all_paths(sub, "o1", None, F.startswith("node", F.lit("r")))[0]
    return p.select(F.explode(F.filter("path", lambda x: F.startswith(x, F.lit("s")))).alias("name")).distinct()


@query("graph_somepath", f"""with recursive {EDGES}, p as (
  select 'o1' as node, ['o1'] as path union all select dst, list_append(path, dst) from edges join p on src = node where not list_contains(path, dst)),
  goal as (select min(node) as r from p where node like 'r%')
  select array_to_string(path, '/') as path from p, goal where node = goal.r order by path limit 1""")
def somepath(t):
    e = _edges(t)
    near = G.reachable(e, _root(t, "o1"))
    goal = near.filter(F.startswith("name", F.lit("r"))).agg(F.min("name")).first()[0]
    ordered = e.withColumn("pos", F.col("dst"))
    path = G.some_path(ordered, "o1", goal) if goal else []
    return t.spark.createDataFrame([("/".join(path),)] if path else [], "path string")


@query("graph_levels", f"""with recursive {EDGES}, d as (
  select dst as name, 0 as k from edges where dst not in (select src from edges) union select src, k + 1 from edges join d on dst = name)
  select name, cast(max(k) as bigint) as level from d group by name""")
def levels(t):
    return G.levels(D.edges(t))


BACK = f"""with recursive {EDGES}, back as (select 'r' || r_regionkey as src, 's' || (r_regionkey + 1) as dst from region where r_regionkey < 2), a as (select * from edges union select * from back),
  near as (select dst as name from back union select a.dst from a join near on src = name), g as (select src, dst from a where src in (select name from near))"""


@query("graph_cycles", BACK + """, w as (select src as a, dst as b from g union select a, dst from w join g on src = b)
  select distinct a as name from w x where exists (select 1 from w y where y.a = x.b and y.b = y.a) and exists (select 1 from w z where z.b = x.a and z.a = z.b) or a = b""")
def cycles(t):
    """All edges, and two that lead back (every cycle goes through one of these)."""
    back = t.region.filter("r_regionkey < 2").select(D.node("r", "r_regionkey").alias("src"), F.concat(F.lit("s"), (F.col("r_regionkey") + 1).cast("string")).alias("dst"))
    return G.cyclic(D.edges(t).union(back))


@query("graph_unreachable", f"with recursive {EDGES}, {TARGETS}, w as (select name from targets where name like 'o%1' union select dst from edges join w on src = name) select name from targets where name not in (select name from w)")
def unreachable(t):
    e = _edges(t)
    names = D.all_targets(t).select("name")
    return names.join(G.reachable(e, names.filter(F.col("name").like("o%1"))), "name", "left_anti")


@query("graph_induced_edges", WALK_UP + " select '\"' || src || '\" -> \"' || dst || '\"' as line from edges where src in (select name from w) and dst in (select name from w)")
def induced(t):
    e = _edges(t)
    up = _up(t, e)
    both = e.join(up.withColumnRenamed("name", "src"), "src", "left_semi").join(up.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return both.select(F.format_string('"%s" -> "%s"', "src", "dst").alias("line"))


@query("graph_label_kind", f"with {EDGES}, {TARGETS} select kind || ' target ' || name as line from targets")
def label_kind(t):
    return D.all_targets(t).select(F.format_string("%s target %s", "kind", "name").alias("line"))


@query("graph_query_json", WALK_DOWN + """ select '{"query":"deps","targets":["' || string_agg(name, '","' order by name) || '"]}' as line from w""")
def query_json(t):
    w = G.reachable(D.edges(t), _root(t, "o1"))
    return w.agg(F.array_sort(F.collect_list("name")).alias("targets")).select(F.to_json(F.struct(F.lit("deps").alias("query"), "targets")).alias("line"))


@query("graph_multi_producer", f"with {ACTIONS} select path, cast(count(distinct target) as bigint) as producers from actions group by path having count(distinct target) > 1")
def multi_producer(t):
    return D.actions(t).select("path", "target").groupBy("path").agg(F.countDistinct("target").alias("producers")).filter("producers > 1")


@query("graph_action_closure", f"""with recursive {ACTIONS}, {EDGES}, w as (select 'o1' as name union select 'o2' union select dst from edges join w on src = name)
  select id from actions where target in (select name from w)""")
def action_closure(t):
    roots = t.spark.createDataFrame([("o1",), ("o2",)], "name string")
    near = G.reachable(D.edges(t), roots)
    a = D.actions(t)
    mine = a.join(near.withColumnRenamed("name", "target"), "target", "left_semi")
    return mine.select("id")


@query("graph_direct_deps", f"with {EDGES} select src as name, cast(count(*) as bigint) as deps, min(dst) as first from edges group by src")
def direct(t):
    return D.edges(t).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("deps"), F.min("dst").alias("first"))


@query("graph_volatile_poison", f"with {EDGES} select distinct e.src as name from edges e join edges f on f.src = e.dst where e.src like 'o%' and f.dst like 's%5'")
def poison(t):
    e = D.edges(t)
    hot = e.filter(F.col("dst").like("s%5")).select(F.col("src").alias("dst")).distinct()
    return e.filter(F.startswith("src", F.lit("o"))).join(hot, "dst", "left_semi").select(F.col("src").alias("name")).distinct()


@query("graph_path_overlap", """with d as (select distinct regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as dir from pages)
  select a.dir as outer_dir, b.dir as inner_dir from d a join d b on starts_with(b.dir, a.dir || '/') and a.dir <> b.dir""")
def overlap(t):
    """A directory inside another is one of its ancestors: an equi-join, not all pairs."""
    d = t.pages.select(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inner = d.filter(F.size(parts) > 1).select(F.col("dir").alias("inner_dir"), F.explode(up).alias("dir"))
    return inner.join(d, "dir").select(F.col("dir").alias("outer_dir"), "inner_dir")


@query("sched_waiting", f"with {EDGES} select src as name, cast(count(distinct dst) as bigint) as waiting from edges group by src")
def waiting(t):
    return D.edges(t).groupBy(F.col("src").alias("name")).agg(F.countDistinct("dst").alias("waiting"))


WEIGHT = "case substr(name, 1, 1) when 'o' then 10 when 'p' then 20 when 's' then 30 when 'c' then 5 when 'n' then 50 else 7 end + length(name)"
PRIORITY = f"""with recursive {EDGES}, {TARGETS}, wt as (select name, {WEIGHT} as weight from targets), d as (
  select name, weight as p from wt where name not in (select src from edges) union select e.src, w.weight + d.p from edges e join d on e.dst = d.name join wt w on w.name = e.src)"""


def _priority(t, e=None):
    e = e or _edges(t)
    name = F.col("name")
    by_kind = F.create_map(*[F.lit(x) for k in (("o", 10), ("p", 20), ("s", 30), ("c", 5), ("n", 50), ("r", 7)) for x in k])
    w = D.all_targets(t).select("name", (by_kind[D.kind(name)] + F.length("name")).cast("long").alias("weight"))
    return G.longest(e, w)


@query("sched_priority", PRIORITY + " select name, cast(max(p) as bigint) as priority from d group by name")
def priority(t):
    return _priority(t)


@query("sched_critical_path", PRIORITY + ", m as (select name, max(p) as p from d group by name) select cast(max(p) as bigint) as critical_path, (select cast(sum(weight) as bigint) from wt) as work from m")
def critical(t):
    e = _edges(t)
    by_kind = F.create_map(*[F.lit(x) for k in (("o", 10), ("p", 20), ("s", 30), ("c", 5), ("n", 50), ("r", 7)) for x in k])
    w = D.all_targets(t).select((by_kind[D.kind(F.col("name"))] + F.length("name")).cast("long").alias("weight"))
    return _priority(t, e).agg(F.max("priority").alias("critical_path")).crossJoin(F.broadcast(w.agg(F.sum("weight").alias("work"))))


@query("graph_events_chain", """with c as (select user_id, event_id, lag(event_id) over (partition by user_id order by ts, event_id) as prev from events)
  select user_id, cast(count(*) as bigint) as nodes, cast(count(prev) as bigint) as chained from c group by user_id""")
def events_chain(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    c = t.events.select("user_id", "event_id", F.lag("event_id").over(w).alias("prev"))
    return c.groupBy("user_id").agg(F.count("*").alias("nodes"), F.count("prev").alias("chained"))
