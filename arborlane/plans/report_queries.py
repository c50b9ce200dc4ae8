"""Tallies, rates, reasons, tails, traces and other reports over results."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.operators import report as R
from arborlane.plans.registry import ACTIONS, RESULTS, query
from arborlane.sources import domain as D


@query("report_outcomes", f"""with {RESULTS} select user_id % 5 as build, cast(count(*) filter (outcome in ('executed', 'flaky')) as bigint) as executed,
  cast(count(*) filter (outcome = 'cached') as bigint) as cached, cast(count(*) filter (outcome = 'failed') as bigint) as failed, cast(count(*) filter (outcome = 'skipped') as bigint) as skipped,
  bool_and(outcome in ('executed', 'flaky', 'cached', 'wouldrun', 'mayrun')) as success, cast(coalesce(sum(duration) filter (outcome in ('executed', 'flaky')), 0) as bigint) as busy from results group by 1""")
def outcomes(t):
    return R.outcome_counts(D.results(t).withColumn("build", F.col("user_id") % 5), "build")


@query("report_tally_by_kind", f"""with {RESULTS}, k as (select kind, cast(count(*) filter (outcome = 'executed') as bigint) as ran, cast(count(*) filter (outcome = 'flaky') as bigint) as flaky,
  cast(count(*) filter (outcome = 'cached') as bigint) as cached, cast(count(*) filter (outcome = 'failed') as bigint) as failed, cast(count(*) filter (outcome = 'skipped') as bigint) as skipped,
  cast(sum(duration) as bigint) as ms from results group by kind)
  select *, round(100.0 * cached / nullif(ran + flaky + cached + failed, 0), 4) as hit_rate from k""")
def tally(t):
    return R.tally(D.results(t), "kind")


@query("report_reasons", f"""with {RESULTS}, e as (select split_part(reason, ': ', 1) || ' ' || kind as head, split_part(reason, ': ', 2) as detail, pos from results where outcome = 'executed'),
  n as (select head, cast(count(*) as bigint) as n from e group by head), d as (select head, detail, row_number() over (partition by head order by pos) as k from e where detail <> '')
  select head, n, string_agg(detail, ',' order by k) filter (k <= 3) as examples from n join d using (head) group by head, n""")
def reasons(t):
    e = D.results(t).filter("outcome = 'executed'").select(
        F.concat_ws(" ", F.substring_index("reason", ": ", 1), F.col("kind")).alias("head"), F.substring_index("reason", ": ", -1).alias("detail"), "pos")
    return R.first_examples(e, "head", "detail", "pos", 3)


@query("report_slowest", f"with {RESULTS} select id, outcome, duration, pos from results where outcome in ('executed', 'flaky') order by duration desc, pos limit 20")
def slowest(t):
    return D.results(t).filter(F.col("outcome").isin("executed", "flaky")).select("id", "outcome", "duration", "pos").orderBy(F.desc("duration"), "pos").limit(20)


_TESTS = f"with {RESULTS}, r as (select kind, outcome from results) "


@query("report_tests_html", _TESTS + """select kind, cast(count(*) as bigint) as total, cast(count(*) filter (outcome = 'executed') as bigint) as passed, cast(count(*) filter (outcome = 'cached') as bigint) as cached,
  cast(count(*) filter (outcome = 'flaky') as bigint) as flaky, cast(count(*) filter (outcome not in ('executed', 'cached', 'flaky')) as bigint) as failed from r group by kind""")
def tests_html(t):
    c = lambda *o: F.count_if(F.col("outcome").isin(*o))
    x = D.results(t).groupBy("kind").agg(F.count("*").alias("total"), c("executed").alias("passed"), c("cached").alias("cached"), c("flaky").alias("flaky"))
    return x.withColumn("failed", F.expr("total - passed - cached - flaky"))


@query("report_tests_cli", _TESTS + """select kind, cast(count(*) filter (outcome = 'executed') as bigint) as passed, cast(count(*) filter (outcome = 'failed') as bigint) as failed,
  cast(count(*) filter (outcome = 'skipped') as bigint) as skipped from r group by kind""")
def tests_cli(t):
    c = lambda o: F.count_if(F.col("outcome") == o)
    return D.results(t).groupBy("kind").agg(c("executed").alias("passed"), c("failed").alias("failed"), c("skipped").alias("skipped"))


@query("report_failures", f"with {RESULTS} select id, split_part(detail, ':', 1) as first from results where outcome = 'failed' order by pos limit 10")
def failures(t):
    x = D.results(t).filter("outcome = 'failed'")
    return x.orderBy("pos").limit(10).select("id", F.substring_index("detail", ":", 1).alias("first"))


@query("report_failure_tail", """with l as (select doc_id, string_split(text, chr(10)) as lines from documents)
  select doc_id, array_to_string(lines[greatest(1, len(lines) - 39):], chr(10)) as tail, cast(greatest(0, len(lines) - 40) as bigint) as hidden from l""")
def failure_tail(t):
    return R.tail(t.documents.select("doc_id", "text"), "doc_id", "text", 40)


@query("report_trace", f"with {RESULTS} select id, duration * 1000 as dur_us, cast(coalesce(sum(duration) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding), 0) * 1000 as bigint) as ts_us, user_id from results")
def trace(t):
    w = W.partitionBy("user_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return D.results(t).select("id", (F.col("duration") * 1000).alias("dur_us"), (F.coalesce(F.sum("duration").over(w), F.lit(0)) * 1000).cast("long").alias("ts_us"), "user_id")


@query("bench_upper_median", f"with {RESULTS}, s as (select kind, list_sort(list(duration)) as d, cast(count(*) as bigint) as n from results group by kind) select kind, d[n // 2 + 1] as median, d[1] as low, d[n] as high, n from s")
def upper_median(t):
    return R.upper_median(D.results(t), "kind", "duration")


@query("bench_median", f"with {RESULTS} select kind, round(median(duration), 3) as median, min(duration) as low, max(duration) as high from results group by kind")
def median(t):
    return D.results(t).groupBy("kind").agg(F.round(F.median("duration"), 3).alias("median"), F.min("duration").alias("low"), F.max("duration").alias("high"))


@query("bench_throughput", f"with {RESULTS}, s as (select kind, list_sort(list(duration)) as d, cast(count(*) as bigint) as n from results group by kind) select kind, round(n * 4096.0 / 1048576.0 / (nullif(d[n // 2 + 1], 0) / 1000.0), 4) as mib_s from s")
def throughput(t):
    m = R.upper_median(D.results(t), "kind", "duration")
    return m.select("kind", F.round(F.try_divide(F.col("n") * 4096.0 / 1048576.0, F.col("median") / 1000.0), 4).alias("mib_s"))


@query("bench_interleaved", f"with {RESULTS} select id, row_number() over (partition by user_id order by case when user_id % 2 = 0 then pos else -pos end) as place from results")
def interleaved(t):
    x = D.results(t)
    return x.select("id", F.row_number().over(W.partitionBy("user_id").orderBy(F.when(F.col("user_id") % 2 == 0, F.col("pos")).otherwise(-F.col("pos")))).cast("long").alias("place"))


@query("pivot_strategy", f"with {ACTIONS}, k as (select kind, pos % 4 as jobs, duration from actions) select kind, " + ", ".join(f"cast(sum(duration) filter (jobs = {j}) as bigint) as jobs_{j}" for j in range(4)) + " from k group by kind")
def pivot(t):
    x = D.actions(t).select("kind", (F.col("pos") % 4).alias("jobs"), "duration")
    p = x.groupBy("kind").pivot("jobs", [0, 1, 2, 3]).agg(F.sum("duration"))
    return p.select("kind", *[F.col(str(j)).alias(f"jobs_{j}") for j in range(4)])


@query("coverage_lcov", """with c as (select l_suppkey as file, l_partkey % 50 as line, cast(sum(cast(l_quantity as bigint) % 3) as bigint) as hits from lineitem group by 1, 2)
  select 'SF:s' || file || chr(10) || string_agg('DA:' || line || ',' || hits, chr(10) order by line) || chr(10) || 'LF:' || count(*) || chr(10) || 'LH:' || count(*) filter (hits > 0) || chr(10) || 'end_of_record' as record from c group by file""")
def lcov(t):
    c = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"), (F.col("l_partkey") % 50).alias("line"), (F.col("l_quantity").cast("long") % 3).alias("count"))
    return R.lcov(c)


@query("junit_suites", f"""with {RESULTS} select kind as suite, cast(count(*) as bigint) as tests, cast(count(*) filter (outcome = 'failed') as bigint) as failures,
  cast(count(*) filter (outcome not in ('executed', 'cached', 'flaky', 'failed', 'skipped')) as bigint) as errors, cast(count(*) filter (outcome = 'skipped') as bigint) as skipped, cast(sum(duration) as bigint) as ms from results group by kind""")
def junit(t):
    o = F.col("outcome")
    return D.results(t).groupBy(F.col("kind").alias("suite")).agg(
        F.count("*").alias("tests"), F.count_if(o == "failed").alias("failures"), F.count_if(~o.isin("executed", "cached", "flaky", "failed", "skipped")).alias("errors"),
        F.count_if(o == "skipped").alias("skipped"), F.sum("duration").alias("ms"))


@query("junit_counts", f"""with {RESULTS}, k as (select unnest(['passed', 'failed', 'skipped', 'error']) as result) select result, cast(count(id) as bigint) as n from k left join results on
  (case outcome when 'failed' then 'failed' when 'skipped' then 'skipped' when 'wouldrun' then 'error' else 'passed' end) = result group by result""")
def junit_counts(t):
    known = t.spark.createDataFrame([(x,) for x in ("passed", "failed", "skipped", "error")], "result string")
    o = F.col("outcome")
    r = D.results(t).select(F.when(o == "failed", "failed").when(o == "skipped", "skipped").when(o == "wouldrun", "error").otherwise("passed").alias("result"))
    n = r.groupBy("result").agg(F.count("*").alias("n"))
    return known.join(n, "result", "left").select("result", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("lint_by_rule", """with f as (select case when p_size < 10 then 'small' when p_retailprice > 1500 then 'dear' when p_name like '%a%' then 'name' else 'none' end as rule, p_partkey as target from part)
  select rule, cast(count(*) as bigint) as n, min(target) as first from f where rule <> 'none' group by rule""")
def lint(t):
    rule = F.when(F.col("p_size") < 10, "small").when(F.col("p_retailprice") > 1500, "dear").when(F.col("p_name").like("%a%"), "name")
    f = t.part.select(rule.alias("rule"), F.col("p_partkey").alias("target")).filter("rule is not null")
    return f.groupBy("rule").agg(F.count("*").alias("n"), F.min("target").alias("first"))


@query("report_utilization", f"""with {RESULTS}, b as (select user_id, sum(duration) filter (outcome in ('executed', 'flaky')) as busy, max(duration) as makespan from results group by user_id)
  select user_id, round(case when makespan = 0 then 0 else 100.0 * coalesce(busy, 0) / (makespan * 8) end, 4) as utilization, round(busy / nullif(makespan * 1.0, 0), 4) as ratio from b""")
def utilization(t):
    b = D.results(t).groupBy("user_id").agg(F.sum(F.when(F.col("outcome").isin("executed", "flaky"), F.col("duration"))).alias("busy"), F.max("duration").alias("makespan"))
    return b.select("user_id", F.round(F.when(F.col("makespan") == 0, 0.0).otherwise(100.0 * F.coalesce("busy", F.lit(0)) / (F.col("makespan") * 8)), 4).alias("utilization"),
                    F.round(F.try_divide(F.col("busy"), F.col("makespan") * F.lit(1.0)), 4).alias("ratio"))


@query("report_headline", f"""with {RESULTS}, c as (select user_id, count(*) filter (outcome = 'failed') as f, count(*) filter (outcome in ('executed', 'flaky')) as b, count(*) filter (outcome = 'skipped') as s, count(*) filter (outcome = 'cached') as c from results group by user_id)
  select user_id, concat_ws(', ', case when f > 0 then f || ' failed' end, case when b > 0 then b || ' built' end, case when s > 0 then s || ' skipped' end, case when c > 0 then c || ' cached' end) as line from c""")
def headline(t):
    return R.headline(D.results(t), "user_id")


@query("report_edge_digest", "select sha256('[' || string_agg('[' || n_nationkey || ',' || n_regionkey || ']', ',' order by n_nationkey) || ']') as digest from nation")
def edge_digest(t):
    rows = t.nation.select("n_nationkey", F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(","), F.col("n_regionkey").cast("string"), F.lit("]")).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "e"))), lambda x: x["e"])
    return rows.agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("digest"))


@query("report_changed_paths", f"""with {RESULTS}, d as (select distinct user_id, detail from results), r as (select user_id, detail, row_number() over (partition by user_id order by detail) as k, count(*) over (partition by user_id) as n from d)
  select user_id, string_agg(detail, ', ' order by k) filter (k <= 4) || case when max(n) > 4 then ' and ' || (max(n) - 4) || ' more' else '' end as line from r group by user_id""")
def changed_paths(t):
    return R.first_and_more(D.results(t), "user_id", "detail", 4)


@query("report_log_ring", f"with {RESULTS}, r as (select id, user_id, row_number() over (partition by user_id order by pos desc) as k, count(*) over (partition by user_id) as n from results) select id, user_id from r where n <= 120 or k <= 100")
def ring(t):
    w = W.partitionBy("user_id")
    r = D.results(t).select("id", "user_id", F.row_number().over(w.orderBy(F.desc("pos"))).alias("k"), F.count("*").over(w).alias("n"))
    return r.filter("n <= 120 or k <= 100").select("id", "user_id")


@query("report_plan_summary", f"with {RESULTS} select kind, cast(count(*) filter (outcome = 'wouldrun') as bigint) as would, cast(count(*) filter (outcome = 'executed') as bigint) as may, cast(count(*) filter (outcome = 'cached') as bigint) as cached, cast(count(*) as bigint) as total from results group by kind")
def plan_summary(t):
    c = lambda o: F.count_if(F.col("outcome") == o)
    return D.results(t).groupBy("kind").agg(c("wouldrun").alias("would"), c("executed").alias("may"), c("cached").alias("cached"), F.count("*").alias("total"))
