"""Periodic steps: grids of ticks, catching up, runs that are missing, late or out of time, and what a failed run leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.steps import LOG_COMPLETED, LOG_FAILED, LOG_PENDING, label, metadata_time, now_at, of_kinds, seconds_after

EPOCH, TIMEOUT = "1970-01-01 00:00:00", 3600
CONTINUE, FAIL_WORKFLOW = "continue", "fail_workflow"


def unix(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", now_at(EPOCH), ts)


def at_unix(seconds: Column) -> Column:
    return seconds_after(now_at(EPOCH), seconds)


def tasks(logs: DataFrame, every: Column, start_at: Column | None = None, till: Column | None = None) -> DataFrame:
    """``workflow_id``, ``step``, ``every`` (seconds), ``first_tick`` (unix), ``last_tick`` (unix; null: no end) of every periodic step.

    The first tick is one period after the last execution on record; without one it is
    ``start_at`` if the step has that, else a period after the task's begin.  Ticks end
    with the time ``till``, that one included, and a step that is completed has no more after its completion.
    """
    none = F.lit(None).cast("timestamp_ntz")
    last = metadata_time("last_execution_at")
    ended = F.least(none if till is None else till, F.when(F.col("state") == LOG_COMPLETED, F.col("completed_at")))
    d = of_kinds(logs, "repeat_coordination").select("workflow_id", "step", every.cast("bigint").alias("every"), last.alias("last_at"), "started_at", (none if start_at is None else start_at).alias("start_at"), ended.alias("ended"))
    first = F.coalesce(unix(F.col("last_at")) + F.col("every"), unix(F.col("start_at")), unix(F.col("started_at")) + F.col("every"))
    return d.select("workflow_id", "step", "every", "last_at", "started_at", first.alias("first_tick"), unix(F.col("ended")).alias("last_tick"))


def fast_forward(due: DataFrame, now: Column, timeout: int = TIMEOUT) -> DataFrame:
    """Fixed grids: ticks of every task that expired by ``now``, and the first that did not.

    A tick has expired when it lies before ``now`` less the timeout, not at it.  A task without
    a period has its first tick alone.
    """
    late = unix(F.timestamp_add("SECOND", F.lit(-timeout), now)) - F.col("first_tick")
    skipped = F.greatest(F.ceil(late / F.nullif(F.col("every"), F.lit(0))).cast("bigint"), F.lit(0))
    return due.withColumn("skipped", skipped).select("workflow_id", "step", "every", "skipped", label(at_unix(F.col("first_tick") + F.col("skipped") * F.col("every"))).alias("next_at"))


def calendar_grid(starts: DataFrame, now: Column) -> DataFrame:
    """Monthly ticks from ``start`` (a date) to the first that isn't before ``now``: ``id``, ``next_tick``, ``ticks``.

    Every tick is a month after the last, and a day cut short stays short: n months on
    the day is the smaller of the start's and of the shortest month passed.  That is a
    common year's February once one was passed (of two in a row one is), else a leap
    year's, else a month of thirty days, one of which is among any three months without a February.
    """
    today, start = F.to_date(now), F.col("start")
    index = lambda d: F.year(d) * 12 + F.month(d) - 1  # noqa: E731  months since year 0

    def tick(n: Column) -> Column:
        first, last = index(start) + 1, index(start) + n
        february = F.ceil((first - 1) / 12).cast("int") * 12 + 1
        year = F.floor(february / 12).cast("int")
        leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
        thirty = F.lit(False)
        for k in range(3):
            thirty = thirty | ((first + k <= last) & F.pmod(first + k, F.lit(12)).isin(3, 5, 8, 10))
        shortest = F.when(february <= last, F.when(leap & (february + 12 > last), 29).otherwise(28)).when(thirty, 30).otherwise(31)
        return F.make_date(F.floor(last / 12).cast("int"), F.pmod(last, F.lit(12)) + 1, F.least(F.dayofmonth(start), F.when(n > 0, shortest).otherwise(31)))

    d = starts.select("id", "start", F.greatest(index(today) - index(start), F.lit(0)).alias("n")).withColumn("tick", tick(F.col("n")))
    d = d.select("id", "start", (F.col("n") + F.when(F.col("tick") < today, 1).otherwise(0)).alias("n"))
    return d.select("id", tick(F.col("n")).cast("string").alias("next_tick"), F.col("n").cast("bigint").alias("ticks"))


#: Ticks of a task that one row makes at a time.
CHUNK = 1024


def grid_runs(due: DataFrame, logs: DataFrame, now: Column, timeout: int = TIMEOUT) -> DataFrame:
    """Every tick of every task up to ``now`` and the task's end with its run, if there is one.

    A tick without a run is ``missed`` once it has expired, else ``due``.  A task without
    a period has none.  A task's ticks are dealt out in chunks, so that no row makes them all.
    """
    upto = F.least(unix(now), F.col("last_tick")) if "last_tick" in due.columns else unix(now)
    d = due.where(F.col("every") > 0).withColumn("n", F.floor((upto - F.col("first_tick")) / F.col("every")) + 1).where("n > 0")
    chunks = d.select("workflow_id", "step", "every", "first_tick", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(CHUNK).cast("bigint"))).alias("k"))
    in_chunk = F.explode(F.sequence(F.col("k"), F.least(F.col("k") + CHUNK, F.col("n")) - 1)).alias("i")
    ticks = chunks.select("workflow_id", "step", "every", "first_tick", in_chunk).select("workflow_id", "step", (F.col("first_tick") + F.col("i") * F.col("every")).alias("number"))
    runs = of_kinds(logs, "repeat_run").where("number is not null").select("workflow_id", "step", "number", F.col("id").alias("run_id"), "state")
    none = F.when(F.col("number") < unix(now) - timeout, "missed").otherwise("due")
    status = F.coalesce(F.get(F.array(F.lit("pending"), F.lit("completed"), F.lit("failed")), F.col("state")), none)
    return ticks.join(runs, ["workflow_id", "step", "number"], "left").select("workflow_id", "step", "number", "run_id", status.alias("status"))


def run_timeouts(logs: DataFrame, now: Column, timeout: int = TIMEOUT) -> DataFrame:
    """Pending runs: ``timed_out`` when ``now`` is past their time-out, not at it; else ``due`` or, before their time, ``scheduled``."""
    at = at_unix(F.col("number"))
    limit = F.timestamp_add("SECOND", F.lit(timeout), at)
    outcome = F.when(now > limit, "timed_out").when(at <= now, "due").otherwise("scheduled")
    return of_kinds(logs.where(F.col("state") == LOG_PENDING), "repeat_run").where("number is not null").select("id", label(limit).alias("timeout_at"), outcome.alias("outcome"))


def failed_runs(logs: DataFrame, every: Column, on_error: Column) -> DataFrame:
    """What follows a failed run: the next tick, or the workflow's failure where the task asks for it.

    A run that timed out is part of catching up and never fails its workflow.
    """
    timed_out = F.coalesce(F.col("error_class") == "TimeoutError", F.lit(False))
    fails = (on_error == FAIL_WORKFLOW) & ~timed_out
    d = of_kinds(logs.where(F.col("state") == LOG_FAILED), "repeat_run").where("number is not null")
    return d.select("id", F.when(fails, FAIL_WORKFLOW).otherwise(CONTINUE).alias("follows"), F.when(~fails, label(at_unix(F.col("number") + every))).alias("next_at"))
