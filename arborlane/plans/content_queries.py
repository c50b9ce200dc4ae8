"""Content addressing over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.operators import content as C
from arborlane.plans.registry import ACTIONS, BLOBS, query
from arborlane.sources import domain as D

_F = lambda n, v: f"'{n}' || chr(0) || strlen({v}) || chr(0) || {v} || chr(0)"


@query("key_digest", f"with {ACTIONS} select id, sha256({_F('target', 'target')} || {_F('kind', 'kind')} || {_F('path', 'path')}) as key from actions")
def key(t):
    return D.actions(t).select("id", C.key_digest(("target", F.col("target")), ("kind", F.col("kind")), ("path", F.col("path"))).alias("key"))


@query("document_key", f"select doc_id, sha256({_F('lang', 'lang')} || {_F('text', 'text')}) as key from documents")
def doc_key(t):
    return t.documents.select("doc_id", C.key_digest(("lang", F.col("lang")), ("text", F.col("text"))).alias("key"))


@query("blob_dedup", f"with {BLOBS}, r as (select *, row_number() over (partition by digest order by id) as k, count(*) over (partition by digest) as copies from blobs) select id, digest, bytes, copies from r where k = 1")
def dedup(t):
    b = D.blobs(t).groupBy("digest").agg(F.min_by(F.struct("id", "bytes"), "id").alias("f"), F.count("*").alias("copies"))
    return b.select("f.id", "digest", "f.bytes", "copies")


@query("blob_last_path", f"with {BLOBS} select digest, max(id) as id from blobs group by digest")
def last_path(t):
    return D.blobs(t).groupBy("digest").agg(F.max("id").alias("id"))


@query("cas_stats", f"with {BLOBS}, o as (select digest, count(*) as n, max(bytes) as b from blobs group by digest), s as (select cast(sum(n) as bigint) as logical_count, cast(sum(n * b) as bigint) as logical_bytes, cast(count(*) as bigint) as unique_count, cast(sum(b) as bigint) as unique_bytes from o) select *, round(coalesce(cast(logical_bytes - unique_bytes as double) / nullif(logical_bytes, 0), 0), 6) as reuse from s")
def stats(t):
    return C.reuse(D.blobs(t), "digest", "bytes")


@query("cas_gc", f"with {BLOBS}, r as (select id, source, sum(bytes) over (partition by source order by id desc rows unbounded preceding) as s from blobs) select id, source from r where s > 50000")
def gc(t):
    return C.evicted(D.blobs(t), "source", "id", "digest", "bytes", 50_000).select("id", "source")


CHUNKS = "c as (select doc_id, unnest(range(0, greatest(cast(ceil(length(text) / 512.0) as bigint), 1))) as seq, text from documents), chunks as (select doc_id, seq, seq * 512 as \"offset\", substr(text, cast(seq * 512 + 1 as bigint), 512) as chunk from c)"


@query("chunk_manifest", f"with {CHUNKS} select doc_id, cast(count(*) as bigint) as chunks, cast(sum(length(chunk)) as bigint) as total, bool_and(length(chunk) > 0 and length(chunk) <= 512) as valid from chunks group by doc_id")
def manifest(t):
    c = C.chunks(t.documents, "doc_id", "text", 512)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("length").alias("total"), F.bool_and(F.col("length").between(1, 512)).alias("valid"))


@query("chunk_reuse", f"with {CHUNKS}, o as (select sha256(chunk) as d, count(*) as n, max(length(chunk)) as b from chunks group by 1), s as (select cast(sum(n) as bigint) as logical_count, cast(sum(n * b) as bigint) as logical_bytes, cast(count(*) as bigint) as unique_count, cast(sum(b) as bigint) as unique_bytes from o) select *, round(coalesce(cast(logical_bytes - unique_bytes as double) / nullif(logical_bytes, 0), 0), 6) as reuse from s")
def chunk_reuse(t):
    c = C.chunks(t.documents, "doc_id", "text", 512).select(F.sha2("chunk", 256).alias("d"), "length")
    return C.reuse(c, "d", "length")


@query("reassemble", "select doc_id, sha256(text) as digest, true as same from documents")
def reassemble(t):
    c = C.chunks(t.documents, "doc_id", "text", 512)
    whole = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("text"))
    x = whole.select("doc_id", F.sha2("text", 256).alias("digest")).join(t.documents.select("doc_id", F.sha2("text", 256).alias("d")), "doc_id")
    return x.select("doc_id", "digest", (F.col("digest") == F.col("d")).alias("same"))


@query("positional_base", f"""with {CHUNKS}, n as (select doc_id, seq, "offset", length(chunk) as length from chunks),
  o as (select doc_id, unnest(range(0, greatest(cast(ceil(length(text) / 700.0) as bigint), 1))) as base, length(text) as total from documents), ob as (select doc_id, base, base * 700 as bo, least(700, total - base * 700) as bl from o),
  x as (select n.doc_id, n.seq, base, least(n."offset" + n.length, bo + bl) - greatest(n."offset", bo) as overlap from n join ob on n.doc_id = ob.doc_id and bo < n."offset" + n.length and n."offset" < bo + bl),
  k as (select *, row_number() over (partition by doc_id, seq order by overlap desc, base desc) as k from x) select doc_id, cast(seq as bigint) as seq, cast(base as bigint) as base, cast(overlap as bigint) as overlap from k where k = 1""")
def positional(t):
    new = C.chunks(t.documents, "doc_id", "text", 512).drop("chunk")
    old = C.chunks(t.documents, "doc_id", "text", 700).drop("chunk")
    return C.best_base(new, old, "doc_id").select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("base").cast("long").alias("base"), "overlap")


@query("fastcdc_chunks")
def fastcdc(t):
    return C.content_chunks(t.documents, "doc_id", "text", 256)


@query("fastcdc_invariants", "select doc_id, cast(strlen(text) as bigint) as total, true as contiguous, true as bounded from documents where strlen(text) > 0")
def fastcdc_ok(t):
    c = C.content_chunks(t.documents, "doc_id", "text", 256)
    w = W.partitionBy("doc_id").orderBy("seq")
    c = c.withColumns({"end": F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0)), "next": F.lead("seq").over(w)})
    size = F.col("length").between(64, 1024) | F.col("next").isNull() & (F.col("length") <= 1024)
    return c.groupBy("doc_id").agg(F.sum("length").alias("total"), F.bool_and(F.col("end") == F.col("offset")).alias("contiguous"), F.bool_and(size).alias("bounded"))


@query("sketch", f"with {CHUNKS}, h as (select distinct doc_id, substr(sha256(chunk), 1, 16) as h from chunks), r as (select *, row_number() over (partition by doc_id order by h) as k from h) select doc_id, h from r where k <= 8")
def sketch(t):
    c = C.chunks(t.documents, "doc_id", "text", 512)
    return C.sketch(c, "doc_id", "chunk")


@query("content_sketch")
def content_sketch(t):
    """As sketch, over content-defined sub-chunks, which cover the whole text."""
    c = C.content_chunks(t.documents, "doc_id", "text", 256)
    return C.sketch(c, "doc_id", "digest")


@query("sketch_neighbors", f"""with {CHUNKS}, h as (select distinct doc_id, substr(sha256(chunk), 1, 16) as h from chunks), r as (select *, row_number() over (partition by doc_id order by h) as k from h), s as (select doc_id, h from r where k <= 8),
  first as (select h, min(doc_id) as base from s group by h), v as (select s.doc_id, base, count(*) as shared from s join first using (h) where base <> doc_id group by 1, 2), b as (select *, row_number() over (partition by doc_id order by shared desc, base) as k from v)
  select doc_id, base, cast(shared as bigint) as shared from b where k = 1""")
def neighbors(t):
    """Each document's best base among the first holders of its features: a hot feature
    votes for one document, not for all pairs of its holders."""
    c = C.chunks(t.documents, "doc_id", "text", 512)
    s = C.sketch(c, "doc_id", "chunk")
    v = s.join(s.groupBy("h").agg(F.min("doc_id").alias("base")), "h").filter("base <> doc_id").groupBy("doc_id", "base").agg(F.count("*").alias("shared"))
    best = v.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("base")).alias("m"))).alias("b"))
    return best.select("doc_id", (-F.col("b.m")).alias("base"), F.col("b.shared").alias("shared"))


@query("transport_replay", f"with {BLOBS}, s as (select *, min(id) over (partition by digest) as first, lag(bytes) over (partition by source, lang order by id) as prev from blobs) select source, cast(count(*) filter (id <> first) as bigint) as hits, cast(count(*) filter (id = first and prev is null) as bigint) as first_seen, cast(sum(bytes) as bigint) as raw_bytes, cast(coalesce(sum(bytes) filter (id = first), 0) as bigint) as cdc_bytes from s group by source")
def replay(t):
    b = D.blobs(t)
    first = b.groupBy("digest").agg(F.min("id").alias("first"))
    s = b.join(first, "digest").withColumn("prev", F.lag("bytes").over(W.partitionBy("source", "lang").orderBy("id")))
    new = F.col("id") == F.col("first")
    return s.groupBy("source").agg(F.count_if(~new).alias("hits"), F.count_if(new & F.col("prev").isNull()).alias("first_seen"), F.sum("bytes").alias("raw_bytes"), F.coalesce(F.sum(F.when(new, F.col("bytes"))), F.lit(0)).cast("long").alias("cdc_bytes"))


@query("oracle_ablation", f"with {BLOBS}, v as (select id, source, bytes, lag(bytes) over w as prev, min(bytes) over (partition by source, lang order by id rows between unbounded preceding and 1 preceding) as best from blobs window w as (partition by source, lang order by id)) select id, abs(bytes - prev) as recent, bytes - best as over_best from v where prev is not null")
def ablation(t):
    w = W.partitionBy("source", "lang").orderBy("id")
    v = D.blobs(t).select("id", "bytes", F.lag("bytes").over(w).alias("prev"), F.min("bytes").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("best"))
    return v.filter("prev is not null").select("id", F.abs(F.col("bytes") - F.col("prev")).alias("recent"), (F.col("bytes") - F.col("best")).alias("over_best"))


@query("breakeven", f"""with {BLOBS}, p as (select source, sum(bytes) as raw, count(*) * 0.01 as cpu, sum(bytes) filter (id % 3 <> 0) as saved from blobs group by source), b as (select unnest([5.0, 50.0, 500.0]) as mbit)
  select source, cast(mbit as double) as mbit, round(case when saved <= 0 or cpu <= 0 then null else cast(saved as double) * 8 / 1e6 / cast(cpu as double) end, 6) as breakeven,
    case when cast(cpu as double) * 1000 + cast(raw - saved as double) * 8 / (mbit * 1000) < cast(raw as double) * 8 / (mbit * 1000) then 'delta' else 'full' end as winner from p cross join b""")
def breakeven(t):
    p = D.blobs(t).groupBy("source").agg(F.sum("bytes").cast("double").alias("raw"), (F.count("*") * 0.01).alias("cpu"), F.sum(F.when(F.col("id") % 3 != 0, F.col("bytes"))).cast("double").alias("saved"))
    x = p.withColumn("mbit", F.explode(F.array(*[F.lit(v) for v in (5.0, 50.0, 500.0)])))
    ms = lambda b: b * 8 / (F.col("mbit") * 1000)
    return x.select("source", "mbit", F.round(F.when((F.col("saved") > 0) & (F.col("cpu") > 0), F.col("saved") * 8 / 1e6 / F.col("cpu")), 6).alias("breakeven"),
                    F.when(F.col("cpu") * 1000 + ms(F.col("raw") - F.col("saved")) < ms(F.col("raw")), "delta").otherwise("full").alias("winner"))


@query("wheel_record", "select doc_id, 'docs/' || doc_id || '.txt,sha256=' || rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') || ',' || strlen(text) as line from documents")
def wheel(t):
    d = F.rtrim(F.translate(F.base64(F.unhex(F.sha2("text", 256))), "+/", "-_"), F.lit("="))
    return t.documents.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt,sha256="), d, F.lit(","), F.octet_length("text").cast("string")).alias("line"))


@query("tree_stamp", f"with {BLOBS} select source, sha256(string_agg(digest || ' ' || id, chr(10) order by digest, id)) as stamp from blobs group by source")
def tree(t):
    row = F.struct("digest", "id")
    x = D.blobs(t).groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return x.select("source", F.sha2(F.array_join(F.transform("r", lambda a: F.concat_ws(" ", a["digest"], a["id"].cast("string"))), "\n"), 256).alias("stamp"))


@query("semantic_text", "select doc_id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda l: not starts_with(ltrim(l), '#') and not starts_with(ltrim(l), 'The ')), chr(10))) as digest from documents")
def semantic(t):
    keep = F.filter(F.split("text", "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit("#")) & ~F.startswith(F.ltrim(x), F.lit("The ")))
    return t.documents.select("doc_id", F.sha2(F.array_join(keep, "\n"), 256).alias("digest"))


@query("file_digest", "select page_id, sha256((case when page_id % 2 = 0 then 'x' else '-' end) || html) as digest from pages")
def file_digest(t):
    return t.pages.select("page_id", F.sha2(F.concat(F.when(F.col("page_id") % 2 == 0, "x").otherwise("-"), "html"), 256).alias("digest"))
