"""Registered streams with timers, barriers and replay-safe sinks, over changes derived from history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.steps import COMPLETED, LOG_COMPLETED, label, metadata_time, now_at, of_kinds, seconds_after
from runlens.operators.fleet import STALE_SECONDS
from runlens.sources import history as hi
from runlens.sources.keyset import by_key
from runlens.sources.shared import new_folder
from runlens.streaming import ledger
from runlens.streaming.deadlines import barriers, deadlines, keyed_state
from runlens.streaming.jobs import appended

#: How late a change may come, and the time that the streams of sleeps and runs have reached.
DELAY, SLEEPS_AT = "1 hour", "2024-01-20 00:00:00"
#: Deliveries of events, one after the other, and how late an event may be.
DELIVERIES, LATEST = 3, "1 day"
_CHANGES = "key long, at timestamp, what string, due timestamp"


def _zoned(ts):
    """A time in UTC as an instant, whatever the session's zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", now_at("1970-01-01 00:00:00"), ts))


def _unzoned(at):
    return F.timestamp_add("MICROSECOND", F.unix_micros(at), now_at("1970-01-01 00:00:00"))


def _streamed(rows: DataFrame, name: str, delay: str) -> DataFrame:
    """``rows``, with their time in ``at``, as a stream with a watermark."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path).withWatermark("at", delay)


def changes(begins: DataFrame, ends: DataFrame, now: str, delay: str = DELAY) -> DataFrame:
    """Begins (``key``, ``at``, ``due``) and ends (``key``, ``at``) up to ``now`` as changes in order of time, and one that moves the watermark there."""
    upto = now_at(now)
    both = begins.select("key", "at", F.lit("begin").alias("what"), "due").unionByName(ends.select("key", "at", F.lit("end").alias("what"), F.lit(None).cast("timestamp_ntz").alias("due"))).where(F.col("at") <= upto)
    tick = begins.sparkSession.range(1).select(F.lit(-1).cast("long").alias("key"), (upto + F.expr(f"INTERVAL {delay}")).alias("at"), F.lit("tick").alias("what"), F.lit(None).cast("timestamp_ntz").alias("due"))
    return both.unionByName(tick).select("key", _zoned(F.col("at")).alias("at"), "what", _zoned(F.col("due")).alias("due"))


def _step_changes(logs: DataFrame, kind: str, key: str, after: int, now: str) -> DataFrame:
    """Steps of a kind that begin with the time due in their metadata, ``after`` milliseconds on, and end when they complete."""
    d = of_kinds(logs, kind).select(F.col("id").alias("key"), "started_at", "completed_at", "state", F.timestamp_add("MILLISECOND", F.lit(after), metadata_time(key)).alias("due")).where("due is not null")
    ended = d.where((F.col("state") == LOG_COMPLETED) & F.col("completed_at").isNotNull())
    return changes(d.select("key", F.col("started_at").alias("at"), "due"), ended.select("key", F.col("completed_at").alias("at")), now)


def sleep_changes(logs: DataFrame, now: str) -> DataFrame:
    """Sleeps: done once their time is reached, the time itself included."""
    return _step_changes(logs, "sleep", "wait_until", 0, now)


def wait_changes(logs: DataFrame, now: str) -> DataFrame:
    """Waits for a condition: timed out once their time-out is past, not at it; those without one are left out."""
    return _step_changes(logs, "wait", "timeout_at", 1, now)


def run_changes(wf: DataFrame, now: str, most: int = STALE_SECONDS) -> DataFrame:
    """Locks taken and released: a run is stale once its lock is older than ``most`` seconds, not at that age."""
    at = F.coalesce("locked_at", F.when(F.col("state") == COMPLETED, F.col("started_at")))
    d = wf.select(F.col("id").alias("key"), at.alias("at"), "completed_at").where("at is not null")
    return changes(d.select("key", "at", F.timestamp_add("MILLISECOND", F.lit(most * 1000 + 1), F.col("at")).alias("due")), d.where("completed_at is not null").select("key", F.col("completed_at").alias("at")), now)


def _told(rows: DataFrame, name: str) -> DataFrame:
    with keyed_state(rows.sparkSession):
        found = appended(deadlines(_streamed(rows, name, DELAY)), name)
    return found.select(F.col("key").alias("id"), label(_unzoned(F.col("due"))).alias("due"), "outcome")


def stream_sleeps(spark: SparkSession, folder: str) -> DataFrame:
    """Sleeps whose time is up by the watermark, or that ended before."""
    return _told(sleep_changes(hi.derive(spark, folder).logs, SLEEPS_AT), "sleeps")


def stream_wait_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """Waits that timed out by the watermark, or that were met before."""
    return _told(wait_changes(hi.derive(spark, folder).logs, SLEEPS_AT), "waits")


def stream_stale_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that went stale by the watermark, or that released their lock before."""
    return _told(run_changes(hi.derive(spark, folder).workflows, SLEEPS_AT), "runs")


def branch_changes(wf: DataFrame) -> DataFrame:
    """Completions of branches' children, and seals with the number of children that were dispatched."""
    d = wf.where("parent_execution_log_id is not null").select(F.col("parent_execution_log_id").alias("branch_id"), F.col("id").alias("child_id"), "created_at", "completed_at")
    none = F.lit(None).cast("long")
    completed = d.where("completed_at is not null").select("branch_id", "child_id", F.col("completed_at").alias("at"), F.lit("completed").alias("what"), none.alias("children"))
    sealed = hi.seals(wf).where("sealed_at is not null").join(d.groupBy("branch_id").agg(F.count("*").alias("children")), "branch_id")
    return completed.unionByName(sealed.select("branch_id", none.alias("child_id"), F.col("sealed_at").alias("at"), F.lit("sealed").alias("what"), "children")).withColumn("at", _zoned(F.col("at")))


def stream_barriers(spark: SparkSession, folder: str) -> DataFrame:
    """Branches that are sealed and whose children are all complete, each change delivered twice."""
    rows = branch_changes(hi.derive(spark, folder).workflows)
    with keyed_state(spark):
        return appended(barriers(_streamed(rows.unionByName(rows), "barriers", LATEST)), "barriers")


def _delivered(spark: SparkSession, folder: str, write, to: str) -> str:
    """The events' schema, once they came in ``DELIVERIES`` parts, the stream starting anew for each."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "event_type", _zoned(F.col("ts").cast("timestamp_ntz")).alias("at"))
    for k in range(DELIVERIES):
        events.where(F.pmod("event_id", F.lit(DELIVERIES)) == k).write.mode("append").parquet(f"{to}/source")
        ledger.run(spark.readStream.schema(events.schema).parquet(f"{to}/source"), to, write)
    return ledger.schema_of(events)


def stream_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Customers from a source that remembers the last key: a first run up to a key, a second, after the rest was added, from there on."""
    to = new_folder(spark, "by-key")
    customers = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_mktsegment")
    middle = customers.agg(F.floor(F.avg("c_custkey")).alias("k")).first().k
    for part in (F.col("c_custkey") <= middle, F.col("c_custkey") > middle):
        customers.where(part).write.mode("append").parquet(f"{to}/source")
        rows = by_key(spark, f"{to}/source".removeprefix("file:"), "c_custkey", "c_custkey long, c_mktsegment string")
        rows.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("c_custkey long, c_mktsegment string").parquet(f"{to}/rows")


def stream_bulk_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Events inserted once by type and user: the first of the first delivery that has one."""
    to = new_folder(spark, "inserted")
    schema = _delivered(spark, folder, ledger.insert_once(to, ["event_type", "user_id"], ["at", "event_id"]), to)
    return ledger.rows(spark, to, "rows", schema).select("event_type", "user_id", "event_id")


def stream_late_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events of all deliveries, with those that came too late marked, not lost."""
    to = new_folder(spark, "late")
    schema = _delivered(spark, folder, ledger.split_late(to, "at", LATEST), to)
    parts = (ledger.rows(spark, to, name, schema).select("event_id", "batch", F.lit(name == "late").alias("late")) for name in ("rows", "late"))
    return next(parts).unionByName(next(parts))
