"""Streaming queries run over what the event table holds, into a table that a batch query could give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import journal, ordered
from .practice import ORACLE_SQL as PLAIN
from .practice import A, attempts_of, scratch


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files. A pattern names it, as a stream's path may not be one file."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")


def _run(spark: SparkSession, stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    return journal.run_available(stream, scratch(spark, "stream"), mode, scratch(spark, "checkpoint"), key)


def _utc(ts: str):
    # the stored time has no zone; it is taken as UTC whatever the session's zone
    return F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return _run(spark, journal.daily(s, ["event_type"]).select(F.col("d").cast("string").alias("d"), "event_type", "n"), "complete")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events")
    return _run(spark, journal.first_seen(s.select("user_id", "event_type"), ["user_id", "event_type"]), "append")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "events").select("user_id", _utc("ts").alias("ts"))
    return _run(spark, journal.sessions(s, ["user_id"], "6 hours", "365 days"), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def stream_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = attempts_of(_stream(spark, sf_dir, "events")).select(F.col("user_id").cast("string").alias("qid"), F.col("qid").cast("string").alias("id"), F.col("ms").alias("t1"), "seq", (~F.col("ok") & (F.col("seq") % 5 == 0)).alias("deleted"))
    with ordered.rocksdb_state(spark):  # a key's state stays, so it should not be on the heap
        r = _run(spark, journal.latest_strokes(e), "update", ["qid", "id"])
    return r.where("not deleted").select("qid", "id", "t1", "seq")


QUERIES = {f.__name__: f for f in (stream_daily, stream_dedup, stream_sessions, stream_strokes)}
ORACLE_SQL = {
    "stream_daily": "select cast(cast(ts as date) as varchar) as d, event_type, count(*) as n from events group by all",
    "stream_dedup": "select distinct user_id, event_type from events",
    "stream_sessions": "with g as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events) select user_id, count(*) filter (where p is null or ts - p >= interval 6 hour) as sessions, count(*) as n from g group by user_id",
    "stream_strokes": A + ", s as (select user_id, qid, ms as t1, seq, not ok and seq % 5 = 0 as gone from a), k as (select *, bool_or(gone) over (partition by user_id, qid) as dead, row_number() over (partition by user_id, qid, gone order by t1 desc, seq desc) as n from s) select cast(user_id as varchar) as qid, cast(qid as varchar) as id, t1, seq from k where not dead and n = 1",
}


def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request limits over events that come up to two days out of order, in several micro-batches."""
    e = attempts_of(spark.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "seq", (F.col("qid") % 25).alias("weight"))
    came = F.unix_seconds("ts") + F.pmod(F.xxhash64("seq"), F.lit(2 * 86_400))
    low, high = e.agg(F.min(came), F.max(came)).first()
    path, batches = scratch(spark, "shuffled"), 5
    for k in range(batches if low is not None else 0):  # a file set for each, written in order
        width = (high - low + 1) / batches
        e.where((came >= low + k * width) & (came < low + (k + 1) * width)).coalesce(4).write.parquet(f"{path}/{k}")
    # what comes long after lets the last events go
    last = e.agg((F.max("ts") + F.expr("interval 10 days")).alias("ts")).where("ts is not null").select(F.lit(-1).cast("long").alias("user_id"), "ts", F.lit(-1).cast("long").alias("seq"), F.lit(1).cast("long").alias("weight"))
    last.coalesce(1).write.parquet(f"{path}/{batches}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/*")
    with ordered.rocksdb_state(spark):
        r = _run(spark, ordered.limited(stream, "3 days"), "append")
    return r.where("user_id >= 0").select("user_id", "seq", "allowed", F.col("requests").cast("long").alias("requests"), F.col("weight_used").cast("long").alias("weight_used"))


QUERIES["stream_limiter"] = stream_limiter
ORACLE_SQL["stream_limiter"] = PLAIN["rate_limiter"]
