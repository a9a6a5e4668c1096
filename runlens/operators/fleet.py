"""Fleet overview, lists and pages of workflows, stranded runs, durations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.steps import COMPLETED, FAILED, IDLE, RUNNING, STALLED, STATES, human_duration, label, percent, seconds_between, state_name, state_place

IN_FLIGHT, BLOCKED = (IDLE, RUNNING), (FAILED, STALLED)
CAP, MOST_ROWS, STALE_SECONDS, STRANDED_SHOWN = 5000, 200, 1800, 500


def _counts() -> list[Column]:
    state = F.col("state")
    return [F.count_if(state == COMPLETED).alias("processed"), F.count_if(state.isin(*IN_FLIGHT)).alias("in_flight"), F.count_if(state.isin(*BLOCKED)).alias("blocked"), F.count("*").alias("total")]


def fleet_overview(wf: DataFrame) -> DataFrame:
    return wf.groupBy("job_class").agg(*_counts())


def fleet_totals(wf: DataFrame) -> DataFrame:
    """The overview's rows and a grand total without a class."""
    return wf.rollup("job_class").agg(*_counts())


def class_share(wf: DataFrame) -> DataFrame:
    """Percent of processed workflows by class, rounded; 0 where nothing is processed."""
    total = F.sum("processed").over(Window.partitionBy())
    return fleet_overview(wf).select("job_class", "processed", F.when(total == 0, F.lit(0)).otherwise(F.round(F.col("processed") * 100 / total)).cast("bigint").alias("share"), F.col("blocked"), (F.col("blocked") / F.nullif(F.col("total"), F.lit(0))).alias("blocked_rate")).withColumn("blocked_shown", percent(F.col("blocked_rate")))


def state_stats(wf: DataFrame, cap: int = CAP) -> DataFrame:
    """Workflows per state, every state included, counted up to ``cap``: no task reads on once it has found as many."""
    found = reduce(DataFrame.unionByName, (wf.where(F.col("state") == k).select(F.lit(k).alias("k")).limit(cap) for k in range(len(STATES))))
    counts = found.agg(*(F.count_if(F.col("k") == k).alias(s) for k, s in enumerate(STATES)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(s).alias("state"), state_place(F.lit(s)).alias("place"), F.col(s).alias("capped"), F.when(F.col(s) >= cap, F.lit(f"{cap}+")).otherwise(F.col(s).cast("string")).alias("shown")) for s in STATES))))


def select_workflows(wf: DataFrame, state: str | None = None, job_class: str | None = None, key_prefix: str | None = None, created_from: Column | None = None, created_to: Column | None = None, top_level: bool = False) -> DataFrame:
    """Filtered workflows.  States may be ``blocked`` or ``in_flight``; an unknown state does not filter."""
    s = F.col("state")
    by_state = {"blocked": s.isin(*BLOCKED), "in_flight": s.isin(*IN_FLIGHT)} | {n: s == k for k, n in enumerate(STATES)}
    conditions = [by_state.get(state), None if job_class is None else F.col("job_class") == job_class, None if key_prefix is None else F.col("key").startswith(key_prefix), None if created_from is None else F.col("created_at") >= created_from, None if created_to is None else F.col("created_at") <= created_to, F.col("parent_execution_log_id").isNull() if top_level else None]
    for c in conditions:
        wf = wf if c is None else wf.where(c)
    return wf


def page(rows: DataFrame, per: int = 50, before: int | None = None, after: int | None = None) -> DataFrame:
    """A keyset page, newest first: ``id`` and whether there are newer and older rows.

    One row more than the page is read, never an offset; after a cursor, older rows are taken to exist.
    """
    per = min(max(per, 1), MOST_ROWS)
    if after is not None:
        found = rows.where(F.col("id") > after).orderBy("id").limit(per + 1)
        place = F.row_number().over(Window.orderBy("id"))
        more, older = F.count("*").over(Window.partitionBy()) > per, F.lit(True)
        return found.select("*", place.alias("_n"), more.alias("has_prev"), older.alias("has_next")).where(F.col("_n") <= per).drop("_n")
    found = (rows if before is None else rows.where(F.col("id") < before)).orderBy(F.desc("id")).limit(per + 1)
    place = F.row_number().over(Window.orderBy(F.desc("id")))
    more = F.count("*").over(Window.partitionBy()) > per
    return found.select("*", place.alias("_n"), F.lit(before is not None).alias("has_prev"), more.alias("has_next")).where(F.col("_n") <= per).drop("_n")


def stranded(wf: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """Running workflows whose lock is older than ``stale_seconds``: all that a reaper would start again."""
    age = seconds_between(F.col("locked_at"), now)
    return wf.where((F.col("state") == RUNNING) & (F.col("locked_at") < F.timestamp_add("SECOND", F.lit(-stale_seconds), now))).select("id", "key", "locked_by", label(F.col("locked_at")).alias("locked_at"), age.cast("bigint").alias("lock_seconds"))


def stranded_page(wf: DataFrame, now: Column, cap: int = STRANDED_SHOWN, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """The ``cap`` stranded workflows with the oldest locks, their place, and whether there are more."""
    oldest = stranded(wf, now, stale_seconds).orderBy("locked_at", "id").limit(cap + 1)
    place = F.row_number().over(Window.orderBy("locked_at", "id"))
    return oldest.select("*", place.alias("place"), (F.count("*").over(Window.partitionBy()) > cap).alias("capped")).where(F.col("place") <= cap)


def row_durations(wf: DataFrame, now: Column) -> DataFrame:
    """Whole seconds a workflow took or has taken; none for idle ones and where the clock runs backwards."""
    s, begun = F.col("state"), F.col("started_at")
    end = F.when(s == COMPLETED, F.col("completed_at")).when(s == RUNNING, now).when(s.isin(*BLOCKED), F.col("updated_at"))
    seconds = F.floor(seconds_between(begun, end)).cast("bigint")
    d = wf.select("id", state_name(s).alias("state"), F.when(seconds >= 0, seconds).alias("seconds"))
    return d.withColumn("shown", human_duration(F.col("seconds")))
