"""Streams of stroke and attempt events: latest per key, tombstones, roll-ups, sessions, limits, idempotent sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import limiter

BATCH, TRIGGER = 80, "900 milliseconds"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of events as a stream; the event time is a timestamp, since a watermark needs one."""
    s = spark.readStream.schema(schema).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(stream: DataFrame, by: list[str], late: str | None = None) -> DataFrame:
    """n and total of each day (UTC) and group. Without a bound on lateness no late row is dropped."""
    s = stream.withWatermark("ts", late) if late else stream
    return s.groupBy(F.window("ts", "1 day").alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("d"), *by, "n", "total")


def sessions(stream: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of each group that end after a gap."""
    s = stream.withWatermark("ts", late)
    return s.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, key: list[str], late: str | None = None) -> DataFrame:
    """One row for each key: with a bound on lateness the state is dropped after it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if late else stream.dropDuplicates(key)


def latest_strokes(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """qid, id, t1, seq, deleted: each stroke's last state. Later t1 wins (ties: later seq), a tombstone for good.

    State is kept without limit, as late events must find it: an aggregate in the state
    store, no call for each key. ttl_ms drops a key's state after that long without
    events, which takes a timer for each key, so a function in Python.
    """
    if not ttl_ms:
        gone = F.coalesce("deleted", F.lit(False))
        last = stream.groupBy("qid", "id").agg(F.max(F.when(~gone, F.struct("t1", "seq"))).alias("_l"), F.bool_or(gone).alias("deleted"))
        none = F.struct(F.lit(-1).cast("long").alias("t1"), F.lit(-1).cast("long").alias("seq"))
        return last.withColumn("_l", F.coalesce("_l", none)).select("qid", "id", F.col("_l.t1").cast("long").alias("t1"), F.col("_l.seq").cast("long").alias("seq"), "deleted")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        t1, seq, deleted = state.get if state.exists else (-1, -1, False)
        for f in frames:
            deleted = deleted or bool(f["deleted"].any())
            live = f[~f["deleted"].astype(bool)]
            if len(live):
                best = max(zip(live["t1"], live["seq"]))
                t1, seq = max((t1, seq), (int(best[0]), int(best[1])))
        state.update((t1, seq, deleted))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"qid": [key[0]], "id": [key[1]], "t1": [t1], "seq": [seq], "deleted": [deleted]})

    return stream.groupBy("qid", "id").applyInPandasWithState(update, "qid string, id string, t1 long, seq long, deleted boolean", "t1 long, seq long, deleted boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def limited(stream: DataFrame) -> DataFrame:
    """The request limiter on a stream of user_id, usage_date, ms, seq, weight: user, seq, allowed, reason. Rows of a batch are taken in order of ms."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        before = state.get if state.exists else (0, 0, -1)
        rows = pd.concat(list(frames)).sort_values(["ms", "seq"])
        done, after = limiter.decide(list(zip(rows["ms"], rows["weight"])), tuple(before))
        state.update(after)
        yield pd.DataFrame({"user_id": key[0], "seq": rows["seq"].to_numpy(), "allowed": [d[0] for d in done], "reason": [d[1] for d in done]})

    kinds = dict(stream.dtypes)
    return stream.groupBy("user_id", "usage_date").applyInPandasWithState(update, f"user_id {kinds['user_id']}, seq long, allowed boolean, reason string", "requests int, weight int, last long", "append", GroupStateTimeout.NoTimeout)


def segments_stateful(stream: DataFrame, gap_ms: int) -> DataFrame:
    """user_id, seq, segment: a segment ends at a gap of gap_ms; state is the last end and number."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        end, segment = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(frames)).sort_values(["t0", "seq"])
        out = []
        for r in rows.itertuples():
            if end >= 0 and r.t0 - end >= gap_ms:
                segment += 1
            end = max(end, int(r.t1))
            out.append(segment)
        state.update((end, segment))
        yield pd.DataFrame({"user_id": key[0], "seq": rows["seq"].to_numpy(), "segment": out})

    kinds = dict(stream.dtypes)
    return stream.groupBy("user_id").applyInPandasWithState(update, f"user_id {kinds['user_id']}, seq long, segment int", "end long, segment int", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that is safe to repeat: the last row of each key of a batch, in a folder that its number names; latest_of() reads the last rows of all."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), order).alias("_r")).select(*key, "_r.*")
        last.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_of(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct("_batch", order)).alias("_r")).select(*key, "_r.*").drop("_batch")


def both_sinks(first: str, second: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes to two places, and fails only if both do."""

    def write(batch: DataFrame, number: int) -> None:
        failed = []
        for path in (first, second):
            try:
                batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            except Exception as e:  # the other place may still take it
                failed.append(e)
        if len(failed) == 2:
            raise failed[0]

    return write


def compact(spark: SparkSession, path: str, key: list[str], order: str) -> None:
    """Makes the last rows of all batches so far one batch, and removes those; their numbers stay with the rows, so later batches still win.

    The new batch is written beside and renamed; what a reader finds in between are the
    same last rows. It must not run while the stream writes.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    rows = spark.read.parquet(path).drop("batch")
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_batch", order)).alias("_r")).select(*key, "_r.*")
    new = jvm.org.apache.hadoop.fs.Path(folder, f"_compacting-{uuid.uuid4().hex}")
    last.write.parquet(new.toString())
    # batches are numbered from 0, so this number is none of the stream's
    number = min([0, *[int(p.getName().partition("=")[2]) for p in old]]) - 1
    fs.rename(new, jvm.org.apache.hadoop.fs.Path(folder, f"batch={number}"))
    for p in old:
        fs.delete(p, True)


def recovered(a: DataFrame, b: DataFrame) -> DataFrame:
    """The later heartbeat of two replicas that isn't closed, with its remaining time frozen at the heartbeat."""
    from ..operators.merge import last_writer

    d = last_writer(a, b, ["user_id", "run_id"], F.coalesce("beat", F.lit(0)))
    return d.where("status not in ('closed', 'completed', 'discarded')").withColumn("left_ms", F.greatest(F.lit(0), F.col("base_ms") - (F.col("beat") - F.col("resumed"))))


def run_available(stream: DataFrame, path: str, mode: str, checkpoint: str, key: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is, into files of the shared folder, and returns them as a table.

    A batch's folder is named by its number, so a repeated batch replaces itself. A
    complete output replaces the one before; of an updated one the last row of each
    key counts.
    """
    spark, done = stream.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/whole" if mode == "complete" else f"{path}/batch={number}")
        done.append(number)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/whole")
    rows = spark.read.parquet(path)
    if mode == "update":
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in key]), "batch").alias("_r")).select(*key, "_r.*")
    return rows.select(*stream.columns)
