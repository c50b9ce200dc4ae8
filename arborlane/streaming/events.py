"""Event streams: sequence numbers, live folds, sessions, exact debounce, truncation.

Each stream reads JSON files from a folder and runs with availableNow, so that the same
code serves a catch-up run and, with another trigger, a live one. State is kept by Spark's
state store; nothing is held on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborlane.plans.lineage import shared_dir

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, path string"
RELEVANT = ("click", "purchase", "error")


def staged(spark: SparkSession, events: DataFrame) -> str:
    """Events as a folder of JSON files in the shared folder, as a producer leaves them."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.col("props").alias("path")).write.json(f"{at}/in")
    return at


def opened(spark: SparkSession, at: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(f"{at}/in")


def drained(stream: DataFrame, at: str, mode: str) -> DataFrame:
    """Runs a stream to its end and reads back what it wrote: rows appended, or the last
    version of each update by the batch that wrote it."""
    spark, out = stream.sparkSession, f"{at}/out"

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def folded(events: DataFrame) -> DataFrame:
    """A live dashboard: counts by user and kind of event, busy time and the last failure."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("executed"), F.count_if(F.col("event_type") == "click").alias("cached"),
        F.count_if(F.col("event_type") == "error").alias("failed"), F.sum(F.floor("value")).cast("long").alias("busy"),
        F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_failure"))


def live_fold(spark: SparkSession, events: DataFrame) -> DataFrame:
    at = staged(spark, events)
    rows = drained(folded(opened(spark, at)), at, "update")
    cols = [c for c in rows.columns if c not in ("user_id", "batch")]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*cols), "batch").alias("l")).select("user_id", "l.*")


def dirty_paths(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The set of relevant paths of each user, each once, whatever the number of events."""
    at = staged(spark, events)
    stream = opened(spark, at).filter(F.col("event_type").isin(*RELEVANT)).select("user_id", "path").dropDuplicates(["user_id", "path"])
    return drained(stream, at, "append").select("user_id", "path")


def sessions(spark: SparkSession, events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of events of a user without a gap. An event far in the future closes them all."""
    at = staged(spark, events)
    far = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("path"))
    stream = opened(spark, at).withWatermark("ts", "0 seconds").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    query = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    far.write.mode("append").json(f"{at}/in")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").filter("user_id >= 0").select("user_id", F.col("w.start").alias("started"), "events")


def truncated(spark: SparkSession, events: DataFrame, end: str = "signup") -> DataFrame:
    """Users whose stream has no end event."""
    at = staged(spark, events)
    stream = opened(spark, at).groupBy("user_id").agg(F.bool_or(F.col("event_type") == end).alias("ended"))
    rows = drained(stream, at, "update").groupBy("user_id").agg(F.max_by("ended", "batch").alias("ended"))
    return rows.filter(~F.col("ended")).select("user_id")


def numbered(spark: SparkSession, events: DataFrame) -> DataFrame:
    """A number for each event of a user, in order of arrival: a counter in state. Events of
    a micro-batch are ordered user by user, so that no order of all events is needed."""
    at = staged(spark, events)

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        x = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        state.update((n + len(x),))
        yield pd.DataFrame({"user_id": key[0], "event_id": x["event_id"].to_numpy(), "seq": range(n, n + len(x))})

    stream = opened(spark, at).select("user_id", "ts", "event_id").groupBy("user_id").applyInPandasWithState(count, "user_id long, event_id long, seq long", "n long", "append", GroupStateTimeout.NoTimeout)
    return drained(stream, at, "append").drop("batch")


Batch = tuple[int, int, list[str]]


def debounced(rows: list[tuple[int, str]], gap: int, open_: Batch | None = None) -> tuple[list[Batch], Batch | None]:
    """Closed batches (first time, last time, paths) of (time, path) in order, and the open
    one: a path that the batch does not have yet moves its deadline, a repeated one does not."""
    closed = []
    for at, path in rows:
        if open_ is not None and at >= open_[1] + gap:
            closed.append(open_)
            open_ = None
        if open_ is None:
            open_ = (at, at, [path])
        elif path not in open_[2]:
            open_ = (open_[0], at, [*open_[2], path])
    return closed, open_


def debounce(spark: SparkSession, events: DataFrame, gap: int = 6 * 3600) -> DataFrame:
    """Exact batches of each user's relevant paths; the open batch is kept in state, and
    closed by the end event."""
    end = spark.range(1).select(F.lit("end").alias("mark"))
    users = events.select("user_id").distinct().crossJoin(F.broadcast(end)).select(
        F.lit(-1).cast("long").alias("event_id"), F.lit("2200-01-01").cast("timestamp").alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    at = staged(spark, events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").unionByName(users))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, paths = state.get if state.exists else (0, None, None, None)
        open_ = (first, last, list(paths)) if first is not None else None
        x = pd.concat(list(parts))
        closed, open_ = debounced(sorted(zip((int(v.timestamp()) for v in x["ts"]), x["path"].tolist())), gap, open_)
        state.update((n + len(closed), *open_))
        yield pd.DataFrame({"user_id": [key[0]] * len(closed), "batch_no": list(range(n, n + len(closed))), "started": [b[0] for b in closed], "paths": [len(b[2]) for b in closed]})

    stream = opened(spark, at).filter(F.col("event_type").isin(*RELEVANT)).select("user_id", "ts", "path")
    out = stream.groupBy("user_id").applyInPandasWithState(run, "user_id long, batch_no long, started long, paths long", "n long, first long, last long, paths array<string>", "append", GroupStateTimeout.NoTimeout)
    return drained(out, at, "append").drop("batch")
