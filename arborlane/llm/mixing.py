"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words; a document's expected copies are
``min(most, c * sqrt(words))`` with c set so that the source's expected words equal
its target. The whole part of the expected copies is certain. The fractions are
inclusion probabilities of one more copy: documents are ranked by random odds
divided by inclusion odds (Rosen's Pareto order sampling) and taken in that order up
to the words still wanted; one last document closes the gap that is left.

Nothing is collected in one task: sizes are pre-aggregated by (source, words), the
ranking by (source, slice of rank), and only the slice with the end of a sample is
sorted. What a row then needs is a handful of numbers of its source.

Defined cases: a null text has no words; a document without words is never taken, nor is
one that is longer than its source's whole target (but to close a gap); a null source is
a source, the last one; an empty table gives an empty result; rows of equal doc_id, text
and source are taken one by one like any others, and in mix() one of them stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlane.llm.common import BROADCAST_ROWS, WORD, checkpointed, own_names, small

SLICES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _measured(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    row = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.col(source))
    return docs.withColumns({"__source": F.col(source), "__id": F.col(doc_id), "__size": word_count(F.col(text)), "__row": row})


def _random(bits: Column) -> Column:
    return (F.shiftrightunsigned(bits, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _repeated(narrow: DataFrame) -> DataFrame:
    """(__row) of rows that repeat."""
    return checkpointed(narrow.groupBy("__row").agg(F.count("*").alias("n")).filter("n > 1").select("__row"))


def _units(narrow: DataFrame, repeated: DataFrame) -> DataFrame:
    """A random number __u for each row. Rows that repeat are numbered, each partition of
    the input by itself, so that no task numbers all rows of a hot one."""
    once = narrow.withColumn("__u", _random(F.col("__row")))
    if repeated.isEmpty():
        return once
    side = small(repeated)
    key = ["__source", "__id", "__size", "__row"]
    parts = narrow.join(side, "__row", "left_semi").groupBy(*key, F.spark_partition_id().alias("__p")).agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(W.partitionBy(*key).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = checkpointed(parts.withColumn("__from", before)).repartition(*key, "__p")
    again = parts.withColumn("__j", F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("__k") - 1)))
    again = again.select(*key, _random(F.xxhash64("__row", "__j")).alias("__u"))
    return checkpointed(once.join(side, "__row", "left_anti").select(*key, "__u").unionByName(again))


def _with(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns that side has for their source."""
    side = side.withColumnRenamed("__source", "__side")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    return rows.join(side, F.col("__source").eqNullSafe(F.col("__side")), how).drop("__side")


def _weight() -> Column:
    """A document longer than its source's whole target has no place in a mix."""
    return F.when(F.col("__size") <= F.col("__t"), F.round(F.sqrt("__size") * 1024).cast("long")).otherwise(F.lit(0).cast("long"))


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """A row for each source: its words and its target. Sources reach ``most`` times
    their words in the order of words by weight, so the level is a running sum."""
    by_name = W.orderBy(F.col("__source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("__s") / F.col("__w"), F.col("__source").asc_nulls_last())
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    table = F.array(*[F.lit(w) for w in weights])
    x = sizes.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("__s"))
    x = x.withColumn("__w", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    x = x.withColumns({
        "__left": F.sum("__s").over(W.partitionBy()) - most * F.coalesce(F.sum("__s").over(before), F.lit(0)),
        "__open": F.sum("__w").over(after),
    })
    x = x.withColumn("__level", F.col("__left") / F.col("__open"))
    x = x.withColumn("__fits", F.col("__level") * F.col("__w") <= most * F.col("__s"))
    level = F.max(F.when(F.col("__fits"), F.struct(-F.row_number().over(by_ratio), F.col("__level").alias("v")))).over(W.partitionBy())
    x = x.withColumn("__best", level["v"])
    return x.select("__source", "__s", F.least(
        F.coalesce(F.col("__best") * F.col("__w"), F.lit(float(most)) * F.col("__s")), F.lit(float(most)) * F.col("__s")
    ).alias("__t"))


def _rate(sizes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """c of each source, from its sizes, largest first: the first size not above most."""
    down = W.partitionBy("__source").orderBy(F.col("__size").desc())
    x = _with(sizes, targets).withColumn("__g", _weight())
    x = x.withColumn("__xn", F.when(F.col("__g") > 0, F.col("__size") * F.col("__n")).otherwise(F.lit(0).cast("long")))
    x = x.withColumns({
        "__above": most * F.coalesce(F.sum("__xn").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "__under": F.sum((F.col("__xn") * F.col("__g")).cast("decimal(38,0)")).over(down.rowsBetween(0, W.unboundedFollowing)).cast("double"),
    })
    x = x.withColumn("__c", F.try_divide(F.col("__t") - F.col("__above"), F.col("__under")))
    return x.groupBy("__source", "__s", "__t").agg(
        F.coalesce(F.max_by("__c", F.when((F.col("__g") > 0) & (F.col("__c") * F.col("__g") <= most), F.col("__size"))), F.lit(1e300)).alias("__c")
    )


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """Certain copies, inclusion probability, and rank in (0, 1): q / (1 + q) of the
    ratio q of random odds to inclusion odds; null for what can't be sampled."""
    m = F.least(F.lit(float(most)), F.col("__c") * _weight())
    rows = rows.withColumn("__m", m).withColumn("__sure", F.floor("__m").cast("long"))
    p = F.col("__m") - F.col("__sure")
    random, included = F.col("__u") / (1 - F.col("__u")), p / (1 - p)
    q = random / included
    return rows.withColumn("__v", F.when((F.col("__size") > 0) & (p > 0), q / (1 + q)))


def plan(narrow: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """What a row needs of its source: __s words, __t target, __c rate, __end the last
    rank taken, and (__fu, __fid) the document that closes the gap."""
    sizes = checkpointed(narrow.groupBy("__source", "__size").agg(F.count("*").alias("__n")))
    n = sizes.agg(F.sum("__n")).first()[0] or 0
    rates = checkpointed(_rate(sizes, checkpointed(_targets(sizes, weights, most)), most))
    slices = max(SLICES, n // SLICES)
    ranked = _ranked(_with(narrow, rates), most).withColumn("__slice", F.floor(F.col("__v") * slices))
    sure = _ranked(_with(sizes.withColumn("__u", F.lit(0.5)), rates), most).groupBy("__source", "__t").agg(
        F.sum(F.col("__sure") * F.col("__size") * F.col("__n")).alias("__sw"))
    want = checkpointed(sure.select("__source", (F.col("__t") - F.col("__sw")).alias("__want")))
    ranked = _with(ranked, want)
    fits = F.col("__v").isNotNull() & (F.col("__size") <= F.col("__want"))
    up = W.partitionBy("__source").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    hist = ranked.filter(fits).groupBy("__source", "__slice", "__want").agg(F.sum("__size").alias("__x"))
    hist = hist.withColumn("__before", F.coalesce(F.sum("__x").over(up), F.lit(0)))
    edge = hist.filter("__before <= __want").groupBy("__source").agg(
        F.max_by(F.struct("__slice", "__before"), "__slice").alias("__e"))
    edge = checkpointed(edge.select("__source", F.col("__e.__slice").alias("__es"), F.col("__e.__before").alias("__eb")))
    last = _with(ranked.filter(fits), edge).filter("__slice = __es")
    last = last.withColumn("__sum", F.col("__eb") + F.sum("__size").over(W.partitionBy("__source").orderBy("__v").rangeBetween(W.unboundedPreceding, 0)))
    ends = last.groupBy("__source", "__es", "__eb", "__want").agg(
        F.max(F.when(F.col("__sum") <= F.col("__want"), F.struct(F.col("__v"), F.col("__sum")))).alias("__l"))
    ends = ends.select(
        F.col("__source").alias("__s1"), F.coalesce(F.col("__l.__v"), F.col("__es") / slices).alias("__end"),
        (F.col("__want") - F.coalesce(F.col("__l.__sum"), F.col("__eb"))).alias("__gap"))
    # a source may have no document that fits
    ends = want.join(ends, F.col("__source").eqNullSafe(F.col("__s1")), "left").select(
        "__source", "__want", F.coalesce("__end", F.lit(-1.0)).alias("__end"), F.coalesce("__gap", "__want").alias("__gap"))
    ends = checkpointed(ends)
    spare = _with(ranked.drop("__want"), ends).filter((F.col("__sure") < most) & (F.col("__size") > 0) & ~F.coalesce(fits & (F.col("__v") <= F.col("__end")), F.lit(False)))
    off = F.abs(F.col("__size") - F.col("__gap"))
    fill = spare.filter(off < F.col("__gap")).groupBy("__source").agg(F.min(F.struct(off.alias("o"), "__u", "__id")).alias("__f"))
    keep = _with(rates, ends, "left")
    keep = _with(keep, checkpointed(fill), "left")
    return checkpointed(keep.select("__source", "__s", "__t", "__c", "__want", "__end", F.col("__f.__u").alias("__fu"), F.col("__f.__id").alias("__fid")))


def _decided(rows: DataFrame, per_source: DataFrame, most: int) -> DataFrame:
    x = _ranked(_with(rows, per_source), most)
    more = F.coalesce((F.col("__v") <= F.col("__end")) & (F.col("__size") <= F.col("__want")), F.lit(False))
    gap = F.coalesce((F.col("__u") == F.col("__fu")) & F.col("__id").eqNullSafe(F.col("__fid")), F.lit(False))
    return x.withColumn("__copies", F.col("__sure") + (more | gap).cast("long"))


def sampled(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7,
            doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    narrow = checkpointed(_measured(docs.select(doc_id, text, source), doc_id, text, source, seed).select("__id", "__source", "__size", "__row"))
    units = _units(narrow, _repeated(narrow))
    out = _decided(units, plan(units, weights, most), most)
    return out.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__s").alias("source_size"), F.col("__t").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, all columns, each row as often as the mix takes it."""
    work, names = own_names(docs)
    rows = _measured(work, names[doc_id], names[text], names[source], seed)
    narrow = checkpointed(rows.select("__id", "__source", "__size", "__row"))
    repeated = _repeated(narrow)
    units = _units(narrow, repeated)
    per_source = plan(units, weights, most)
    every = lambda x: x.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names.values())
    if repeated.isEmpty():
        return every(_decided(rows.withColumn("__u", _random(F.col("__row"))), per_source, most).filter("__copies > 0")).toDF(*docs.columns)
    side = small(repeated)
    single = _decided(rows.join(side, "__row", "left_anti").withColumn("__u", _random(F.col("__row"))), per_source, most).filter("__copies > 0")
    counts = _decided(units.join(side, "__row", "left_semi"), per_source, most).groupBy("__row").agg(F.sum("__copies").alias("__copies")).filter("__copies > 0")
    one = rows.join(side, "__row", "left_semi").groupBy("__row").agg(F.first(F.struct(*names.values())).alias("r"))
    one = one.join(counts, "__row").select("r.*", "__copies").repartition(F.col(names[doc_id]))
    return every(single).unionByName(every(one)).toDF(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return sampled(docs).select("doc_id", "size", "source_size", "target", "taken")
