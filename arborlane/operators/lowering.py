"""From targets to actions, overlays, options of tests, deltas of versions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlane.functions.text import shard_ids

ACTION = ["id", "kind", "target", "input", "output"]


def lowered(targets: DataFrame) -> DataFrame:
    """Actions of targets (name, kind, srcs array<string>, shards int): a library compiles
    each source and archives, a program compiles and links, a rule is one action, a test
    one for each shard."""
    compiled = targets.filter("kind in ('library', 'program')")
    each = compiled.select("name", F.explode("srcs").alias("src"))
    objects = F.transform("srcs", lambda s: F.concat(s, F.lit(".o")))
    compile_ = each.select(F.concat(F.lit("compile:"), "name", F.lit(":"), "src").alias("id"), F.lit("compile").alias("kind"), F.col("name").alias("target"), F.col("src").alias("input"), F.concat("src", F.lit(".o")).alias("output"))
    join = compiled.select(F.concat(F.when(F.col("kind") == "library", "archive:").otherwise("link:"), "name").alias("id"), F.when(F.col("kind") == "library", "archive").otherwise("link").alias("kind"), F.col("name").alias("target"), F.array_join(objects, " ").alias("input"), F.concat("name", F.when(F.col("kind") == "library", ".a").otherwise("")).alias("output"))
    rule = targets.filter("kind = 'rule'").select(F.concat(F.lit("rule:"), "name").alias("id"), F.lit("rule").alias("kind"), F.col("name").alias("target"), F.array_join("srcs", " ").alias("input"), F.concat("name", F.lit(".out")).alias("output"))
    test = targets.filter("kind = 'test'").select("name", "srcs", F.explode(shard_ids(F.concat(F.lit("test:"), "name"), F.col("shards"))).alias("id")).select("id", F.lit("test").alias("kind"), F.col("name").alias("target"), F.array_join("srcs", " ").alias("input"), F.concat("id", F.lit(".log")).alias("output"))
    return compile_.unionByName(join).unionByName(rule).unionByName(test)


def overlaid(base: DataFrame, overlay: DataFrame, key: str, replaced: list[str], appended: list[str]) -> DataFrame:
    """base with the lists of overlay: some replace, some are added at the end."""
    o = overlay.select(key, *[F.col(c).alias(f"__{c}") for c in replaced + appended])
    x = base.join(o, key, "left")
    some = {c: F.coalesce(f"__{c}", c) for c in replaced}
    more = {c: F.concat(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"__{c}", F.array().cast("array<string>"))) for c in appended}
    return x.withColumns(some | more).select(base.columns)


def merged_tools(base, extra):
    """Two maps as one, the second before the first."""
    return F.map_from_entries(F.array_sort(F.concat(F.filter(F.map_entries(base), lambda e: ~F.map_contains_key(extra, e["key"])), F.map_entries(extra))))


def with_test_options(actions: DataFrame, args: list[str], env: dict[str, str]) -> DataFrame:
    """Arguments added and variables set on tests only; a variable that is set is not passed on."""
    test = F.col("kind") == "test"
    given = F.create_map(*[F.lit(x) for kv in env.items() for x in kv])
    return actions.withColumns({
        "argv": F.when(test, F.concat("argv", F.array(*[F.lit(a) for a in args]))).otherwise(F.col("argv")),
        "env": F.when(test, merged_tools(F.col("env"), given)).otherwise(F.col("env")),
        "pass_env": F.when(test, F.array_except("pass_env", F.array(*[F.lit(k) for k in env]))).otherwise(F.col("pass_env")),
    })


def deltas(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, full, delta, kept) bytes of the new text compressed alone, and with the old
    one as a dictionary; the delta is kept if it is smaller and gives the text back."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for k, a, b in zip(*(x.column(i).to_pylist() for i in range(3))):
                a, b = (a or "").encode(), (b or "").encode()
                full = len(zstandard.ZstdCompressor(level=3).compress(b))
                words = zstandard.ZstdCompressionDict(a, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(a) >= 8 else None
                delta = zstandard.ZstdCompressor(level=3, dict_data=words).compress(b) if words else b"x" * (full + 1)
                same = words is not None and zstandard.ZstdDecompressor(dict_data=words).decompress(delta, max_output_size=len(b)) == b
                rows.append((k, full, len(delta), same and len(delta) < full))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["key", "full", "delta", "kept"])

    return pairs.select(F.col(key).cast("long"), old, new).mapInArrow(run, "key long, full long, delta long, kept boolean")
