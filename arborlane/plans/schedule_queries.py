"""Scheduling analytics: each order is a small build of its line items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.operators import journal as J
from arborlane.operators import schedule as S
from arborlane.plans.registry import ACTIONS, JOURNAL, query
from arborlane.sources import domain as D

KINDS = {"click": 10, "purchase": 100, "view": 20, "error": 50}


@query("sched_estimates", f"""with {JOURNAL}, h as (select * from (select id, kind, duration, row_number() over (partition by id order by seq desc) as k from journal) where k = 1 and duration % 3 <> 0),
  s as (select kind, list_sort(list(duration)) as d, count(*) as n from h group by kind), m as (select kind, greatest(d[n // 2 + 1], 1) as median from s), a as (select distinct id, kind from journal)
  select a.id, cast(1 as bigint) as static, cast(case a.kind when 'click' then 10 when 'purchase' then 100 when 'view' then 20 when 'error' then 50 else 40 end as bigint) as heuristic,
    coalesce(h.duration, 1) as journal, coalesce(h.duration, m.median, 1) as learned from a left join h on h.id = a.id left join m on m.kind = a.kind""")
def estimates(t):
    j = D.journal(t)
    h = J.fold(j.select("id", "seq", "kind", "duration")).filter("duration % 3 <> 0").select("id", "kind", "duration")
    return S.estimates(j.select("id", "kind").distinct(), h, KINDS, 40)


def builds(t):
    """Line items of an order as a build: every third one needs the two before it."""
    a = D.actions(t).withColumn("pos", (F.col("pos") - 1).cast("int"))
    needs = F.when((F.col("pos") % 3 == 2), F.array(F.col("pos") - 2, F.col("pos") - 1)).otherwise(F.array().cast("array<int>"))
    return a.select(F.col("target").alias("graph"), "pos", "duration", F.col("duration").alias("guess"), needs.alias("needs"))


@query("sched_sim_serial", f"with {ACTIONS} select target as graph, cast(sum(duration) as bigint) as makespan from actions group by target")
def serial(t):
    return S.sweep(builds(t), ("critical",), (1,)).select("graph", "makespan")


@query("sched_sim_unbounded", f"with {ACTIONS}, x as (select target, (pos - 1) % 3 as m, (pos - 1) // 3 as g, duration from actions), y as (select target, g, coalesce(max(duration) filter (m < 2), 0) as a, coalesce(max(duration) filter (m = 2), 0) as b from x group by target, g) select target as graph, max(a + b) as makespan from y group by target")
def unbounded(t):
    return S.sweep(builds(t), ("fifo",), (64,)).select("graph", "makespan")


@query("sched_sweep")
def sweep(t):
    return S.sweep(builds(t), ("fifo", "critical", "longest"), (2, 4))


@query("sched_best")
def best(t):
    return S.best(S.sweep(builds(t), ("fifo", "critical"), (1, 2, 4)))


@query("sched_over_critical", f"with {ACTIONS}, x as (select target, (pos - 1) % 3 as m, (pos - 1) // 3 as g, duration from actions), y as (select target, g, coalesce(max(duration) filter (m < 2), 0) as a, coalesce(max(duration) filter (m = 2), 0) as b from x group by target, g), c as (select target, max(a + b) as cp from y group by target), w as (select target, sum(duration) as work from actions group by target) select target as graph, round(100.0 * (cast(work as double) - cp) / cp, 4) as over from w join c using (target)")
def over(t):
    p = S.sweep(builds(t), ("critical",), (1,))
    return p.select("graph", F.round(100.0 * (F.col("makespan").cast("double") - F.col("critical_path")) / F.col("critical_path"), 4).alias("over"))


@query("sched_chain", f"with {ACTIONS}, r as (select *, row_number() over (partition by target order by duration desc, pos) as k, sum(duration) over (partition by target order by duration desc, pos rows unbounded preceding) as upto from actions) select target, id, cast(k as bigint) as place, duration, cast(upto as bigint) as upto from r where k <= 3")
def chain(t):
    w = W.partitionBy("target").orderBy(F.desc("duration"), "pos")
    r = D.actions(t).withColumns({"place": F.row_number().over(w).cast("long"), "upto": F.sum("duration").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return r.filter("place <= 3").select("target", "id", "place", "duration", "upto")
