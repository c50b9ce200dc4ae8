"""Selections, decisions, keys and findings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.operators import rules as R
from arborlane.operators import schedule as S
from arborlane.plans.registry import ACTIONS, JOURNAL, query
from arborlane.plans.schedule_queries import builds
from arborlane.sources import domain as D


def _targets(t):
    return D.actions(t).select("target").distinct()


@query("attr_srcs", f"with {ACTIONS} select distinct target from actions where pos % 4 <> 0 and regexp_matches(path, '^p1[^/]*$')")
def srcs(t):
    """Every fourth action's path is an order-only input, which does not count."""
    a = D.actions(t)
    return R.having(_targets(t), a.select("target", "path", F.when(F.col("pos") % 4 == 0, "order").otherwise("input").alias("role")), "p1*", "input")


@query("attr_outputs", f"with {ACTIONS}, x as (select target, target || '.out' as path from actions union all select target, id || '.o' from actions) select distinct target from x where regexp_matches(path, '^o[^/]*7\\.out$') or regexp_matches(path, '^o[^/]*#5\\.o$')")
def outputs(t):
    a = D.actions(t)
    made = a.select("target", F.concat("target", F.lit(".out")).alias("path")).union(a.select("target", F.concat("id", F.lit(".o"))))
    return R.having(_targets(t), made, "o*7.out").union(R.having(_targets(t), made, "o*#5.o")).distinct()


@query("attr_sandbox", f"with {ACTIONS} select distinct target from actions where kind like '%F'")
def sandbox(t):
    return R.having_flag(_targets(t), D.actions(t).withColumn("sandbox", F.col("kind").like("%F")), "sandbox", True)


@query("test_selection", f"with {ACTIONS} select id from actions where kind = 'RF'")
def tests(t):
    return R.of_kind(D.actions(t), "RF").select("id")


@query("segment_prefix", "with p as (select page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) as path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as dir from pages) select page_id from p where path = dir or starts_with(path, dir || '/')")
def prefix(t):
    p = t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("dir"))
    return p.filter(R.inside(F.col("path"), F.col("dir"))).select("page_id")


_FACTS = """facts as (select event_id, case when event_id % 13 = 0 then 'u' || user_id end as upstream_failed, case when event_id % 11 = 0 then 'd' || user_id end as upstream_dirty,
  event_type = 'view' as test, event_id % 7 = 0 as volatile, user_id % 5 <> 0 as known, event_id % 3 <> 0 as same_key, event_id % 17 <> 0 as same_outputs,
  case when event_id % 4 = 0 then 'f' || event_id end as bad_output, event_id % 8 = 0 as restorable, event_id % 19 = 0 as remote, 'input changed: f' || (event_id % 11) as cause from events)"""


def _facts(t):
    e, at = t.events, F.col("event_id")
    some = lambda every, prefix, c: F.when(at % every == 0, F.concat(F.lit(prefix), F.col(c).cast("string")))
    return e.select(
        "event_id", some(13, "u", "user_id").alias("upstream_failed"), some(11, "d", "user_id").alias("upstream_dirty"), (F.col("event_type") == "view").alias("test"),
        (at % 7 == 0).alias("volatile"), (F.col("user_id") % 5 != 0).alias("known"), (at % 3 != 0).alias("same_key"), (at % 17 != 0).alias("same_outputs"),
        some(4, "f", "event_id").alias("bad_output"), (at % 8 == 0).alias("restorable"), (at % 19 == 0).alias("remote"), F.concat(F.lit("input changed: f"), (at % 11).cast("string")).alias("cause"))


def _decision_sql(no_cache: bool, runs: int) -> str:
    return f"""with {_FACTS}, d as (select *, case when upstream_failed is not null then 0 when upstream_dirty is not null then 1 when test and {no_cache} then 2 when volatile then 3 when test and {runs} > 1 then 4
    when known and same_key and same_outputs and (bad_output is null or restorable) then 5 when known and same_key and same_outputs then 6 when remote then 7 when known then 8 else 9 end as k from facts)
  select event_id, ['skipped', 'may_run', 'would_run', 'would_run', 'would_run', 'cached', 'would_run', 'cached', 'would_run', 'would_run'][k + 1] as outcome,
    case k when 0 then 'upstream failed: ' || upstream_failed when 1 then 'depends on output of ' || upstream_dirty || ', which would run' when 2 then 'test cache disabled' when 3 then 'volatile stamp value'
      when 4 then 'running {runs} times' when 6 then 'output missing or modified: ' || bad_output when 8 then cause when 9 then 'not built before' else '' end as reason from d"""


@query("decision_order", _decision_sql(False, 1))
def decision(t):
    return _facts(t).select("event_id", R.decision().alias("d")).select("event_id", "d.*")


@query("decision_order_tests", _decision_sql(True, 3))
def decision_tests(t):
    return _facts(t).select("event_id", R.decision(True, 3).alias("d")).select("event_id", "d.*")


@query("argv_tagged", r"""with x as (select p_partkey, ['cc', p_name] || case when p_size % 3 = 0 then [chr(0) || 'stamp', 'VERSION', p_brand] else [] end || case when p_size % 5 = 0 then [chr(0) || 'preserve-outputs'] else [] end
  || case when p_size % 7 = 0 then [chr(0) || 'clean-dir', 'gen'] else [] end || case when p_size % 11 = 0 then [chr(0) || 'next-command', 'strip', p_type] else [] end as a from part)
  select p_partkey, replace(array_to_string(a, '|'), chr(0), '^') as argv from x""")
def argv(t):
    size = F.col("p_size")
    some = lambda every, value, kind: F.when(size % every == 0, F.array(value)).otherwise(F.array().cast(kind))
    a = R.tagged(
        F.array(F.lit("cc"), "p_name"), some(3, F.struct(F.lit("VERSION").alias("key"), F.col("p_brand").alias("value")), "array<struct<key:string,value:string>>"), size % 5 == 0,
        some(7, F.lit("gen"), "array<string>"), some(11, F.array(F.lit("strip"), "p_type"), "array<array<string>>"))
    return t.part.select("p_partkey", F.translate(F.array_join(a, "|"), "\0", "^").alias("argv"))


@query("fnv_ids", """with x as (select p_partkey, list_transform(string_split(p_name, ''), lambda c: ord(c)) as b from part),
  y as (select p_partkey, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(b, lambda c: c::hugeint)), lambda h, c: (xor(h, c) * 1099511628211::hugeint) % 18446744073709551616::hugeint) as h from x)
  select p_partkey, lpad(lower(hex(h::ubigint)), 16, '0') as fnv from y""")
def fnv(t):
    return R.fnv_hex(t.part.select("p_partkey", "p_name"), "p_name").select("p_partkey", "fnv")


@query("toolchain_fingerprint", "select n_regionkey, sha256(string_agg(n_name || '=' || sha256(n_name || n_nationkey), chr(10) order by n_name)) as fingerprint from nation group by n_regionkey")
def toolchain(t):
    return R.fingerprint(t.nation.withColumn("digest", F.sha2(F.concat("n_name", F.col("n_nationkey").cast("string")), 256)), "n_regionkey", "n_name", "digest")


@query("coverage_pairs", "select 'c' || o_orderkey as counter, 'n' || c_custkey as note, c_custkey is null as warned from orders left join (select c_custkey from customer where c_custkey % 3 <> 0) on c_custkey = o_custkey")
def coverage(t):
    """Counters with the notes of their stem; those without are kept, with a warning."""
    notes = t.customer.filter("c_custkey % 3 <> 0").select("c_custkey")
    x = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(notes.withColumn("found", F.lit(True)), "c_custkey", "left")
    return x.select(D.node("c", "o_orderkey").alias("counter"), F.when(F.col("found"), D.node("n", "c_custkey")).alias("note"), F.col("found").isNull().alias("warned"))


@query("watch_proof", """with a as (select o_orderkey as id, o_orderpriority as p, o_orderstatus as s from orders where o_orderkey % 10 <> 0),
  b as (select o_orderkey as id, case when o_orderkey % 7 = 0 then o_orderpriority || '!' else o_orderpriority end as p, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as s from orders where o_orderkey % 10 <> 1)
  select coalesce(a.id, b.id) as id, a.id is not null and b.id is not null and a.p is not distinct from b.p and a.s is not distinct from b.s as valid from a full join b on a.id = b.id""")
def proof(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    now = o.filter("id % 10 <> 1").select("id", F.when(F.col("id") % 7 == 0, F.concat("p", F.lit("!"))).otherwise(F.col("p")).alias("p"), F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("s")).alias("s"))
    env = lambda x, turned: x.select("id", F.create_map(*([F.lit("B"), F.lit("1"), F.lit("P"), F.col("p")] if turned else [F.lit("P"), F.col("p"), F.lit("B"), F.lit("1")])).alias("env"), "s")
    return R.proven(env(o.filter("id % 10 <> 0"), False), env(now, True), "id", ["env"], ["s"])


@query("remote_counters", f"""with {JOURNAL} select cast(count(*) filter (kind = 'click') as bigint) as action_hits, cast(count(*) filter (kind = 'view') as bigint) as action_misses, cast(count(*) filter (kind = 'purchase') as bigint) as blobs_downloaded,
  cast(coalesce(sum(duration) filter (kind = 'purchase'), 0) as bigint) as bytes_downloaded, cast(count(*) filter (kind = 'signup') as bigint) as blobs_uploaded, cast(coalesce(sum(duration) filter (kind = 'signup'), 0) as bigint) as bytes_uploaded,
  cast(count(*) filter (kind = 'error' and duration % 2 = 0) as bigint) as rejected, cast(count(*) filter (kind = 'error' and duration % 2 <> 0) as bigint) as errors from journal""")
def counters(t):
    j, kind = D.journal(t), F.col("kind")
    size = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("duration"))), F.lit(0)).cast("long")
    return j.agg(
        F.count_if(kind == "click").alias("action_hits"), F.count_if(kind == "view").alias("action_misses"), F.count_if(kind == "purchase").alias("blobs_downloaded"), size("purchase").alias("bytes_downloaded"),
        F.count_if(kind == "signup").alias("blobs_uploaded"), size("signup").alias("bytes_uploaded"), F.count_if((kind == "error") & (F.col("duration") % 2 == 0)).alias("rejected"), F.count_if((kind == "error") & (F.col("duration") % 2 != 0)).alias("errors"))


@query("closest_label", """with a as (select distinct substr(n_name, 1, 3) || substr(n_name, 5) || case when n_nationkey % 3 = 0 then 'QQQQQ' else '' end as input from nation),
  x as (select input, n_name as name, levenshtein(input, n_name) as d, n_nationkey as pos from a, nation), b as (select input, name, d, row_number() over (partition by input order by d, pos) as k from x)
  select input, name as suggestion from b where k = 1 and d <= 1 + length(input) // 3""")
def label(t):
    n = t.nation
    cut = F.concat(F.substring("n_name", 1, 3), F.substr("n_name", F.lit(5)), F.when(F.col("n_nationkey") % 3 == 0, "QQQQQ").otherwise(""))
    return R.closest(n.select(cut.alias("input")).distinct(), n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos")))


@query("lint_findings", """with x as (select 'c' || c_custkey as target, 'volatile-pass-env' as rule, unnest(['HOME', c_mktsegment]) as value from customer), y as (select 'c' || c_custkey as target, 'missing-include-dir' as rule, 'd' || (c_custkey % 10) as value from customer)
  select * from x where value in ('BUILDING', 'MACHINERY') union all select * from y where value not in (select 'd' || n_nationkey from nation where n_nationkey < 5)""")
def lint(t):
    c = t.customer.select(D.node("c", "c_custkey").alias("target"), F.array(F.lit("HOME"), "c_mktsegment").alias("pass_env"), F.array(F.concat(F.lit("d"), (F.col("c_custkey") % 10).cast("string"))).alias("includes"))
    return R.findings(c, ["BUILDING", "MACHINERY"], t.nation.filter("n_nationkey < 5").select(D.node("d", "n_nationkey").alias("dir")))


@query("relative_paths", r"""with x as (select page_id, case page_id % 7 when 0 then '' when 1 then '/a' when 2 then 'a//b' when 3 then 'a/../b' when 4 then './.' when 5 then 'a\b' else './x/./' || page_id end as raw from pages),
  p as (select *, string_split(raw, '/') as parts from x), k as (select *, list_filter(parts, lambda v: v <> '.') as kept from p),
  e as (select *, case when raw = '' then 'empty path' when contains(raw, '\') then 'not forward slashes' when starts_with(raw, '/') then 'absolute' when list_contains(parts, '') then 'empty component' when list_contains(parts, '..') then 'escapes' when len(kept) = 0 then 'no file' end as error from k)
  select page_id, case when error is null then array_to_string(kept, '/') end as path, error from e""")
def relative(t):
    n = F.col("page_id")
    raw = F.lit("")
    for i, v in {1: "/a", 2: "a//b", 3: "a/../b", 4: "./.", 5: "a\\b"}.items():
        raw = F.when(n % 7 == i, v).otherwise(raw)
    raw = F.when(n % 7 == 6, F.concat(F.lit("./x/./"), n.cast("string"))).otherwise(raw)
    return t.pages.select("page_id", R.relative_path(raw).alias("r")).select("page_id", "r.*")


@query("declarations", r"select doc_id from documents where len(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(ltrim(x), '^(//|#|\*)') and contains(x, 'icense'))) > 0")
def declarations(t):
    return t.documents.filter(R.declares(F.col("text"), "icense")).select("doc_id")


@query("all_cached_cases", """with e as (select user_id, event_id, event_type from events where user_id % 3 <> 0 or event_type <> 'purchase') select user_id, 'a' || event_id as id, 'passed' as result from e where event_type = 'purchase'
  union all select distinct user_id, 'test:all cached', 'cached' from e where event_type = 'view' and user_id not in (select user_id from e where event_type = 'purchase')""")
def all_cached(t):
    e = t.events.filter("user_id % 3 <> 0 or event_type <> 'purchase'").select(
        "user_id", D.node("a", "event_id").alias("id"), F.lit("passed").alias("result"), (F.col("event_type") == "purchase").alias("test"), (F.col("event_type") == "view").alias("all_cached"))
    return R.cases(e, "user_id")


@query("watch_changes", """with e as (select event_id, case event_id % 4 when 0 then '.git/x' when 1 then 'gen/' || user_id when 2 then 'genx/' || user_id else 'src/' || user_id end as path, case event_type when 'click' then 'access' when 'view' then 'modify' when 'error' then 'remove' else 'create' end as kind from events)
  select event_id, path from e where kind <> 'access' and not starts_with(path, '.git/') and not starts_with(path, 'gen/') and path not in (select 'src/' || c_custkey from customer where c_custkey % 2 = 0)""")
def watch(t):
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    path = F.when(n % 4 == 0, ".git/x").when(n % 4 == 1, F.concat(F.lit("gen/"), u)).when(n % 4 == 2, F.concat(F.lit("genx/"), u)).otherwise(F.concat(F.lit("src/"), u))
    kind = F.when(F.col("event_type") == "click", "access").when(F.col("event_type") == "view", "modify").when(F.col("event_type") == "error", "remove").otherwise("create")
    made = t.customer.filter("c_custkey % 2 = 0").select(D.node("src/", "c_custkey").alias("path"))
    return R.changes(t.events.select("event_id", path.alias("path"), kind.alias("kind")), made, ["gen"]).select("event_id", "path")


_WALK = f"""{ACTIONS}, x as (select target, pos, id, kind, duration, (pos - 1) % 3 as m, (pos - 1) // 3 as g from actions), y as (select a.*, c.pos as last, coalesce(c.duration, 0) as tail from x a left join x c on c.target = a.target and c.g = a.g and c.m = 2 where a.m < 2),
  s as (select * from (select *, row_number() over (partition by target order by duration + tail desc, pos desc) as k from y) where k = 1),
  w as (select target, 1 as place, pos from s union all select target, 2, last from s where last is not null)"""


@query("sched_walk", f"with {_WALK} select target as graph, cast(place as bigint) as place, cast(pos - 1 as bigint) as pos from w")
def walk(t):
    return S.walk(builds(t))


@query("critical_path_table", f"""with {_WALK}, j as (select w.target, w.place, a.id, a.kind, a.duration from w join actions a on a.target = w.target and a.pos = w.pos)
  select target, cast(place as bigint) as place, id, case when kind <> 'AF' then duration end as duration, cast(sum(duration) over (partition by target) as bigint) as estimated, cast(coalesce(sum(case when kind <> 'AF' then duration end) over (partition by target), 0) as bigint) as measured from j""")
def critical_table(t):
    """The chain that bounds each build, what was expected of it and what it took: actions of
    one kind were not run."""
    w = S.walk(builds(t)).select(F.col("graph").alias("target"), "place", (F.col("pos") + 1).alias("pos"))
    j = w.join(D.actions(t), ["target", "pos"]).withColumn("ran", F.when(F.col("kind") != "AF", F.col("duration")))
    own = W.partitionBy("target")  # a window, as a join of totals would walk every build twice
    total = j.withColumns({"estimated": F.sum("duration").over(own), "measured": F.coalesce(F.sum("ran").over(own), F.lit(0).cast("long"))})
    return total.select("target", "place", "id", F.col("ran").alias("duration"), "estimated", "measured")
