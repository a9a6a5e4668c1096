"""Streaming forms of the temporal queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.sources.shared import new_folder

#: How late an event may come.
DELAY = "1 day"


def _events(spark: SparkSession, folder: str, delay: str = DELAY) -> DataFrame:
    """The events as a stream, with their time in ``at`` and a watermark of ``delay``."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # The brackets make it a pattern, as a stream's source must be a folder or a pattern; it matches this name alone.
    events = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def appended(rows: DataFrame, name: str) -> DataFrame:
    """All rows that a stream which reads what is there and stops has written, as Parquet."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, name)
    sink = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _updated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The last state of every key of a stream in update mode.

    Every batch writes what changed into a folder of its number, so that a batch which
    runs again replaces what it wrote; the largest number of a key holds.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, name)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    changes = spark.read.parquet(f"{folder}/rows")
    rest = [c for c in rows.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def first_events(events: DataFrame) -> DataFrame:
    """Exactly-once steps: of repeated deliveries of a user's step at one time a single one comes through.

    Time is part of the key, so that the watermark clears the state of keys that can't
    come again.  A delivery later than the watermark allows is dropped: with its key's
    state gone, it can't be told from one that came through.
    """
    return events.select("user_id", "event_type", "at").dropDuplicates(["user_id", "event_type", "at"])


def wait_outcomes(events: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """Waits (a user's ``signup``) with the events that end them (a ``purchase`` within the time-out), or without one once the watermark is past the time-out.

    Waits whose time has not run out by the watermark are in the stream's state alone.
    """
    # Conditions on time as well stay above the watermark, which so follows events of all kinds.
    of = lambda kind: F.when(F.col("at").isNotNull(), F.col("event_type")) == kind
    waits = events.where(of("signup")).select("event_id", "user_id", F.col("at").alias("waiting_since"))
    ends = events.where(of("purchase")).select(F.col("user_id").alias("by"), F.col("at").alias("met_at"))
    within = (F.col("user_id") == F.col("by")) & (F.col("met_at") >= F.col("waiting_since")) & (F.col("met_at") <= F.col("waiting_since") + F.expr(f"INTERVAL {timeout}"))
    return waits.join(ends, within, "leftOuter").select("event_id", "user_id", "waiting_since", "met_at")


def drained(events: DataFrame) -> DataFrame:
    """Children of every branch that were spawned (a user's ``signup``) and that are completed (a ``purchase``), so far; the state has two numbers a branch."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    return events.groupBy("user_id").agg(of("signup").alias("spawned"), of("purchase").alias("completed"))


def stream_first_events(spark: SparkSession, folder: str) -> DataFrame:
    return appended(first_events(_events(spark, folder)), "first-events").select("user_id", "event_type", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def stream_wait_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every wait that was met, with the first event that met it, and every one whose time-out the watermark is past."""
    rows = appended(wait_outcomes(_events(spark, folder)), "waits")
    first = rows.groupBy("event_id", "user_id", "waiting_since").agg(F.min("met_at").alias("met_at"))
    return first.select("event_id", "user_id", F.date_format("met_at", "yyyy-MM-dd HH:mm:ss").alias("met_at"), F.when(F.col("met_at").isNull(), "timed_out").otherwise("met").alias("outcome"))


def stream_drain(spark: SparkSession, folder: str) -> DataFrame:
    """Pending children of every branch after the stream has read what is there."""
    return _updated(drained(_events(spark, folder)), ["user_id"], "drain").select("user_id", "spawned", "completed", F.greatest(F.col("spawned") - F.col("completed"), F.lit(0)).alias("pending"))


def stream_daily_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors per tumbling day over the stream of events, as the complete final state.

    The state has a row a day, so that it may stand in memory; its table is named
    anew for every call.
    """
    errors = _events(spark, folder).where("event_type = 'error'")
    daily = errors.groupBy(F.window("at", "1 day")).agg(F.count("*").alias("errors"))
    name = f"daily_errors_{uuid.uuid4().hex}"
    daily.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "errors")
