"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlane.session import ship

#: A row set below this many rows may be broadcast: the rows are narrow (at most
#: a few dozen bytes), so the broadcast stays under some 32 MB at every input size.
BROADCAST_ROWS = 500_000

#: Keys that hold at least one in HOT_SHARE of all rows are joined by broadcast:
#: there are at most HOT_SHARE such keys, whatever the size of the input.
HOT_SHARE = 1000

#: Word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own, else, in local mode, one set here."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", "")
        if not given:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            given = tempfile.mkdtemp(prefix="arborlane-")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of a table already written, for broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., so that no other name clashes, and these by name."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def dealt(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """df dealt by a key and checkpointed so that Spark still knows how it is dealt:
    what then groups or joins by the key does not move df again. (The plan of an
    adaptive query no longer says so, hence the setting.)"""
    spark = df.sparkSession
    with settings(spark, spark__sql__adaptive__enabled="false"):
        return checkpointed(df.repartition(n or partitions(spark), key))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any
    more, between the phases of an operator with large intermediate results."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> int:
    """A full collection on each executor, one task each, after which its heap shrinks to a
    few times what it holds: a heap that has grown leaves Python workers less room. Returns
    the number of executors; in local mode there are none beside the driver."""
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if executors > 0:
        spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()
    return executors


@contextlib.contextmanager
def settings(spark: SparkSession, **conf):
    """Session settings for the jobs run inside the block, then put back."""
    conf = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of texts in an Arrow batch. Spark's default of 10,000 rows can be 100 MB of texts,
#: held by the JVM and by Python for each task.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's number of rows in an Arrow batch to BATCH_ROWS. Results are
    computed after the operator has returned, so the setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "left") -> DataFrame:
    """rows joined to keyed, which has one row for each key and the number of
    its rows in ``count``. Keys with a large share of the rows (at most HOT_SHARE
    of them) go by broadcast, so that no task gets all rows of a hot key.
    Keys compare with <=>, so that nulls match.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(64, -(-total // HOT_SHARE))
    names = [f"__k{i}" for i in range(len(on))]
    side = keyed.withColumnsRenamed(dict(zip(on, names)))
    values = [c for c in keyed.columns if c not in on]
    match = lambda: [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(on, names)]
    one = rows.join(F.broadcast(side.filter(hot).withColumn("__hot", F.lit(True))), match(), "left").drop(*names)
    far = one.filter(F.col("__hot").isNull()).drop("__hot", *values)
    near = one.filter(F.col("__hot")).drop("__hot")
    return near.unionByName(far.join(side.filter(~hot), match(), how).drop(*names).select(near.columns))
