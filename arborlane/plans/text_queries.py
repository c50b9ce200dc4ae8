"""Scalar and text queries, readers of small formats, lint rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.functions import depfile
from arborlane.functions import text as X
from arborlane.plans.registry import ACTIONS, query
from arborlane.sources import domain as D

_URLPATH = "regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def _path(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))


@query("labels_resolve", "with x as (select p_partkey as id, case p_partkey % 4 when 0 then '//:' || p_brand when 1 then '//' || p_type || ':' || p_brand when 2 then ':' || p_brand else p_brand end as label, p_type as pkg from part) select id, case when starts_with(label, '//:') then substr(label, 4) when starts_with(label, '//') then label else '//' || pkg || ':' || ltrim(label, ':') end as label from x")
def resolve(t):
    m, b = F.col("p_partkey") % 4, F.col("p_brand")
    label = F.when(m == 0, F.concat(F.lit("//:"), b)).when(m == 1, F.concat(F.lit("//"), "p_type", F.lit(":"), b)).when(m == 2, F.concat(F.lit(":"), b)).otherwise(b)
    return t.part.select(F.col("p_partkey").alias("id"), X.resolve_label(label, F.col("p_type")).alias("label"))


@query("labels_split", "with x as (select p_partkey as id, '//' || p_type || ':' || p_name as label from part) select id, substr(label, 1, length(label) - length(split_part(label, ':', -1)) - 1) as package, split_part(label, ':', -1) as name from x")
def split(t):
    name, package = X.label_parts(F.concat(F.lit("//"), "p_type", F.lit(":"), "p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), package.alias("package"), name.alias("name"))


@query("globs", f"select page_id, {_URLPATH} as path from pages where regexp_matches({_URLPATH}, '^(?:.*/)?e[^/]/[0-9][^/]*$')")
def globs(t):
    rx = X.glob_regex("**/e?/#*").replace("#", "[0-9]")
    return _path(t).filter(F.regexp_like("path", F.lit(rx)))


@query("path_predicate", f"select page_id from pages where regexp_matches({_URLPATH}, '^[^/]*\\.com/.*$')")
def predicate(t):
    return _path(t).filter(F.regexp_like("path", F.lit(X.glob_regex("*.com/**")))).select("page_id")


@query("paths_ancestors", f"with x as (select distinct {_URLPATH} as path from pages), s as (select path, string_split(path, '/') as p from x), u as (select p, unnest(range(1, len(p))) as n from s) select distinct array_to_string(p[1:n], '/') as dir from u")
def ancestors(t):
    return _path(t).select(F.explode(X.ancestors(F.col("path"))).alias("dir")).distinct()


@query("directory_stamp", f"with x as (select distinct {_URLPATH} as path from pages), d as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '([^/]*)$', 1) as name from x) select dir, sha256(string_agg(name, chr(10) order by name)) as stamp from d group by dir")
def stamp(t):
    d = _path(t).select("path").distinct().select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return d.groupBy("dir").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "\n"), 256).alias("stamp"))


@query("suggest_labels", "with w as (select p_name, min(p_partkey) as id from part group by p_name), a as (select unnest(['goldenrod', 'lavendar', 'part 1', 'part#12', 'Part#0000']) as asked), d as (select asked, p_name as label, levenshtein(asked, p_name) as dist from a cross join w), k as (select *, row_number() over (partition by asked order by dist, label) as k from d where dist <= 1 + length(asked) // 3) select asked, label, cast(dist as bigint) as dist from k where k <= 3")
def suggest(t):
    asked = t.spark.createDataFrame([(x,) for x in ("goldenrod", "lavendar", "part 1", "part#12", "Part#0000")], "asked string")
    d = t.part.select(F.col("p_name").alias("label")).distinct().join(F.broadcast(asked), F.levenshtein("asked", "label") <= 1 + F.floor(F.length("asked") / 3))
    d = d.withColumn("dist", F.levenshtein("asked", "label").cast("long"))
    return d.withColumn("k", F.row_number().over(W.partitionBy("asked").orderBy("dist", "label"))).filter("k <= 3").select("asked", "label", "dist")


@query("stamp_lines", "with l as (select o_orderkey as id, 'STABLE_' || o_orderstatus || '=' || o_orderpriority || '=' || o_custkey as line from orders) select id, split_part(line, '=', 1) as key, substr(line, strpos(line, '=') + 1) as value, starts_with(line, 'STABLE_') as stable from l")
def stamps(t):
    line = F.concat(F.lit("STABLE_"), "o_orderstatus", F.lit("="), "o_orderpriority", F.lit("="), F.col("o_custkey").cast("string"))
    x = t.orders.select(F.col("o_orderkey").alias("id"), line.alias("line"))
    return x.select("id", F.substring_index("line", "=", 1).alias("key"), F.substr("line", F.instr("line", "=") + 1).alias("value"), F.startswith("line", F.lit("STABLE_")).alias("stable"))


@query("stamp_references", "with l as (select event_id, 'v=${stamp.A_' || upper(event_type) || '} u=${stamp.USER} ${dep:x} ${stamp.USER}' as line from events) select event_id, array_to_string(regexp_extract_all(line, '\\$\\{stamp\\.([A-Z_]+)\\}', 1), ',') as refs, regexp_replace(line, '\\$\\{stamp\\.[A-Z_]+\\}', '', 'g') as blank from l")
def refs(t):
    line = F.concat(F.lit("v=${stamp.A_"), F.upper("event_type"), F.lit("} u=${stamp.USER} ${dep:x} ${stamp.USER}"))
    return t.events.select("event_id", F.array_join(X.references(line), ",").alias("refs"), F.regexp_replace(line, r"\$\{stamp\.[A-Z_]+\}", "").alias("blank"))


@query("template_expand", f"with {ACTIONS} select id, '--in ' || path || ' --out ' || target || '.o --kind=' || kind as command from actions")
def template(t):
    text = F.lit("--in ${in} --out ${out}.o --kind=${kind}")
    for name, c in (("in", "path"), ("out", "target"), ("kind", "kind")):
        text = F.replace(text, F.lit("${" + name + "}"), F.col(c))
    return D.actions(t).select("id", text.alias("command"))


@query("sanitize", "select p_partkey as id, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') as ident, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug, lower(regexp_replace(p_brand, '[-_.]+', '_', 'g')) as dist from part")
def sanitize(t):
    return t.part.select(F.col("p_partkey").alias("id"), X.identifier(F.col("p_name")).alias("ident"), X.slug(F.col("p_type")).alias("slug"), X.distribution_name(F.col("p_brand")).alias("dist"))


@query("shards", "with x as (select p_partkey as id, p_name as name, p_size % 4 as total from part), e as (select name, total, unnest(range(0, greatest(total, 1))) as i from x) select case when total <= 1 then name else name || '#' || i || '/' || total end as shard from e")
def shards(t):
    return t.part.select(F.explode(X.shard_ids(F.col("p_name"), F.col("p_size") % 4)).alias("shard"))


@query("human_bytes", "select doc_id, case when n >= 1099511627776 then printf('%.1f TiB', round(n / 1099511627776.0, 1)) when n >= 1073741824 then printf('%.1f GiB', round(n / 1073741824.0, 1)) when n >= 1048576 then printf('%.1f MiB', round(n / 1048576.0, 1)) when n >= 1024 then printf('%.1f KiB', round(n / 1024.0, 1)) else n || ' B' end as size from (select doc_id, cast(strlen(text) as bigint) * 7 as n from documents)")
def human(t):
    return t.documents.select("doc_id", X.human_bytes(F.octet_length("text").cast("long") * 7).alias("size"))


@query("duration_text", "select event_id, case when ms < 1000 then ms || 'ms' when ms < 60000 then (ms // 1000) || '.' || ((ms % 1000) // 100) || 's' else (ms // 60000) || 'm' || ((ms % 60000) // 1000) || 's' end as text from (select event_id, cast(floor(value) as bigint) * 331 as ms from events)")
def durations(t):
    return t.events.select("event_id", X.duration_text(F.floor("value").cast("long") * 331).alias("text"))


@query("shell_quote", "select event_id, case when regexp_matches(props, '^[A-Za-z0-9_./=:@%+,-]+$') then props else '''' || replace(props, '''', '''\\''''') || '''' end as arg from events")
def shell(t):
    return t.events.select("event_id", X.shell_quoted(F.col("props")).alias("arg"))


@query("html_escape", "select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as text from pages")
def escape(t):
    return t.pages.select("page_id", X.escaped(F.col("html")).alias("text"))


@query("clean_text", "select conv_id, turn, case when length(t) > 60 then substr(t, 1, 60) || '... ' || (length(t) - 60) || ' more' else t end as text from (select conv_id, turn, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') as t from conversations)")
def clean(t):
    return t.conversations.select("conv_id", "turn", X.clipped(X.clean(F.col("text")), 60).alias("text"))


@query("csv_quote", "select event_id, case when regexp_matches(props, '[\",\\n\\r]') then '\"' || replace(props, '\"', '\"\"') || '\"' else props end as field from events")
def csv(t):
    return t.events.select("event_id", X.csv_quoted(F.col("props")).alias("field"))


@query("spam_signals", r"""with x as (select page_id, url, regexp_matches(url, 'spam|pills|cheap') as lure, regexp_matches(url, '\.(zip|rar|exe)$') as archive from pages) select page_id, concat_ws(',', case when archive then 'archive' end, case when lure then 'lure' end) as reasons from x where lure or archive""")
def spam(t):
    lure, archive = F.regexp_like("url", F.lit("spam|pills|cheap")), F.regexp_like("url", F.lit(r"\.(zip|rar|exe)$"))
    return t.pages.filter(lure | archive).select("page_id", F.concat_ws(",", F.when(archive, "archive"), F.when(lure, "lure")).alias("reasons"))


@query("absolute_paths", r"with w as (select doc_id, unnest(string_split_regex(text, '\s+')) as w from documents) select doc_id, cast(count(*) as bigint) as n from w where regexp_matches(w, '^/[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$') group by doc_id")
def absolute(t):
    return t.documents.select("doc_id", F.size(X.absolute_paths(F.col("text"))).cast("long").alias("n")).filter("n > 0")


@query("shell_marks", "with m as (select unnest(['|', '&', ';', '<', '>', '*', '$']) as c) select doc_id, cast(count(*) as bigint) as n from documents, m where contains(text, c) group by doc_id")
def marks(t):
    return t.documents.select("doc_id", F.size(X.shell_marks(F.col("text"))).cast("long").alias("n")).filter("n > 0")


@query("depfile_lines", "with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents) select doc_id, cast(count(*) as bigint) as n from l where trim(x) <> '' and not starts_with(trim(x), '#') group by doc_id")
def lines(t):
    return t.documents.select("doc_id", F.size(X.rule_lines(F.col("text"))).cast("long").alias("n")).filter("n > 0")


@query("depfile_includes", "with l as (select page_id, unnest(['Note: including file: ' || url, 'Note (x): y: ' || url, 'plain ' || page_id]) as x from pages) select page_id, split_part(x, ': ', -1) as path from l where contains(x, ': ') and not contains(substr(x, 1, length(x) - length(split_part(x, ': ', -1))), '(') and contains(split_part(x, ': ', -1), '/')")
def includes(t):
    text = F.concat(F.lit("Note: including file: "), "url", F.lit("\nNote (x): y: "), "url", F.lit("\nplain "), F.col("page_id").cast("string"))
    return t.pages.select("page_id", F.explode(X.included_paths(text)).alias("path"))


@query("depfile_make", f"with {ACTIONS} select distinct target as id, path as dep from actions")
def make(t):
    a = D.actions(t).groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("path")), " \\\n ").alias("deps"))
    return depfile.dependencies(a.select(F.col("target").alias("id"), F.concat("target", F.lit(".o: "), "deps", F.lit("\n")).alias("text")), "id", "text")


@query("relativize", f"with {ACTIONS}, x as (select target, '/root/ws/' || path as p from actions) select target, string_agg(distinct regexp_replace(p, '^/root/ws/', ''), ',' order by regexp_replace(p, '^/root/ws/', '')) as paths from x group by target")
def relativize(t):
    x = D.actions(t).select("target", F.regexp_replace(F.concat(F.lit("/root/ws/"), "path"), "^/root/ws/", "").alias("p"))
    return x.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("paths"))


@query("field_matrix", "with v as (select p_partkey as id, list_filter([case when p_size < 5 then 'size' end, case when p_retailprice > 1400 then 'price' end, case when p_type like '%A%' then 'type' end], lambda x: x is not null) as bad from part) select id, unnest(bad) as violation from v")
def matrix(t):
    bad = F.array_compact(F.array(F.when(F.col("p_size") < 5, "size"), F.when(F.col("p_retailprice") > 1400, "price"), F.when(F.col("p_type").like("%A%"), "type")))
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(bad).alias("violation"))


@query("clean_selection", "with p as (select unnest(['debug', 'release']) as profile) select distinct profile || '/' || p_brand as dir from part cross join p where p_size < 10")
def clean_dirs(t):
    x = t.part.filter("p_size < 10").select("p_brand").distinct()
    return x.select(F.explode(F.array(F.lit("debug"), F.lit("release"))).alias("profile"), "p_brand").select(F.concat_ws("/", "profile", "p_brand").alias("dir"))


@query("compile_commands", f"with {ACTIONS}, f as (select target, min_by(path, pos) as file, min_by(kind, pos) as kind from actions group by target) select '{{\"directory\":\".\",\"file\":\"' || file || '\",\"output\":\"' || target || '.o\"}}' as line from f where kind = 'NO'")
def compdb(t):
    f = D.actions(t).groupBy("target").agg(F.min_by("path", "pos").alias("file"), F.min_by("kind", "pos").alias("kind")).filter("kind = 'NO'")
    return f.select(F.to_json(F.struct(F.lit(".").alias("directory"), "file", F.concat("target", F.lit(".o")).alias("output"))).alias("line"))


@query("journal_export", "select '{\"action\":\"a' || event_id || '\",\"key\":\"' || user_id || '\",\"duration_ms\":' || cast(floor(value) as bigint) || '}' as line from events")
def export(t):
    return t.events.select(F.to_json(F.struct(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("action"), F.col("user_id").cast("string").alias("key"), F.floor("value").cast("long").alias("duration_ms"))).alias("line"))


@query("language_detect", "with f as (select source || '/' || (n_chars % 60) as source, case when lang in ('en', 'de') then 'germanic' else 'romance' end as family from documents) select source, case when count(distinct family) = 1 then min(family) else 'ambiguous' end as family from f group by source")
def detect(t):
    f = t.documents.select(F.concat_ws("/", "source", (F.col("n_chars") % 60).cast("string")).alias("source"), F.when(F.col("lang").isin("en", "de"), "germanic").otherwise("romance").alias("family"))
    return f.groupBy("source").agg(F.when(F.countDistinct("family") == 1, F.min("family")).otherwise("ambiguous").alias("family"))


@query("version_parse", "with v as (select event_id, '# pinned' || chr(10) || (event_id % 9) || '.' || (user_id % 7) || '.' || (event_id % 5) || chr(10) as t from events) select event_id, regexp_extract(t, '\\n([0-9]+\\.[0-9]+\\.[0-9]+)', 1) as version from v")
def version(t):
    dotted = F.concat_ws(".", (F.col("event_id") % 9).cast("string"), (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 5).cast("string"))
    return t.events.select("event_id", F.regexp_extract(F.concat(F.lit("# pinned\n"), dotted, F.lit("\n")), r"\n([0-9]+\.[0-9]+\.[0-9]+)", 1).alias("version"))
