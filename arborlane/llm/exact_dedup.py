"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Only rows whose length is shared get a prefix hash compared, and only rows whose
(length, prefix hash) is shared get their full content hashed for grouping. The shared
pairs are broadcast as a bit map of a fixed size (BITS); a row that only shares a bit is
hashed in vain, which changes no result. So the same plan serves every size, and text
enters a shuffle only where drop_exact_copies() drops more rows than may be broadcast.

Defined cases: a null text counts as empty; empty texts equal each other; rows
with the same doc_id and text are copies of one another and exactly one of them
stays; a null doc_id is smaller than any other; an empty table gives an empty
result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.llm.common import BROADCAST_ROWS, checkpointed, join_hot, own_names, small

#: Characters of the text that the second level hashes.
PREFIX = 256
#: Bits of the map of shared (length, prefix hash): at most a million words are broadcast.
BITS = 1 << 26


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").select(*keys)


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = PREFIX, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, full hash (null
    where no other row has the length and prefix) and the carried columns."""
    carry = carry or {}
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(_text(text)).alias("__len"),
        F.xxhash64(F.substring(_text(text), 1, prefix)).alias("__pre"),
        _text(text).alias("__text"),
        *[c.alias(k) for k, c in carry.items()],
    )
    lengths = small(checkpointed(_shared(rows.select("__len"), ["__len"])))
    pairs = _shared(rows.select("__len", "__pre").join(lengths, "__len", "left_semi"), ["__len", "__pre"])
    place = F.pmod(F.xxhash64("__len", "__pre"), F.lit(BITS))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    bits = checkpointed(pairs.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__b")).groupBy("__word").agg(F.bit_or("__b").alias("__bits")))
    hashed = rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(bits), "__word", "left")
    live = F.call_function("shiftrightunsigned", F.col("__bits"), F.col("__bit")).bitwiseAND(F.lit(1)) == 1
    hashed = hashed.withColumn("__full", F.when(live, F.sha2("__text", 256)))
    narrow = checkpointed(
        hashed.select("doc_id", "__full", *carry, F.monotonically_increasing_id().alias("__row"))
    )
    groups = narrow.filter("__full is not null").groupBy("__full").agg(
        F.max(F.struct("doc_id", "__row")).alias("__keep"), F.count("*").alias("__n")
    )
    groups = checkpointed(groups.filter("__n > 1"))
    joined = join_hot(narrow, groups, ["__full"], "__n")
    alone = F.col("__n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__keep.doc_id")).alias("keep_id"),
        F.coalesce("__n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("__keep.__row") == F.col("__row"))).alias("kept"),
        F.col("__full").alias("full_hash"),
        *carry,
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_groups() does not keep."""
    work, names = own_names(docs)
    key, content = names[doc_id], names[text]
    gone = exact_groups(work, key, content).filter(~F.col("kept")).select(
        F.col("doc_id").alias("id"), F.col("full_hash").alias("sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same")
    ).distinct()
    gone = checkpointed(gone)
    # only rows whose id is gone are hashed again
    match = lambda side: F.col(key).eqNullSafe(side["id"]) & F.array_contains(F.array(side["sha"]), F.sha2(_text(content), 256))
    other = small(gone.filter("not same"), BROADCAST_ROWS // 2)
    out = work.join(other, match(other), "left_anti")
    if not gone.filter("same").isEmpty():  # a row repeated as a whole: one of it stays
        same = small(gone.filter("same"), BROADCAST_ROWS // 2)
        once = out.join(same, match(same), "left_semi").withColumn("sha", F.sha2(_text(content), 256)).dropDuplicates([key, "sha"]).drop("sha")
        out = out.join(same, match(same), "left_anti").unionByName(once)
    return out.toDF(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    sha = F.sha2(_text("text"), 256)
    return exact_groups(docs, carry={"text_sha256": sha}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
