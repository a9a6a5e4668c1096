"""Outcomes, rates, durations and errors in a time window that ends at ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.steps import COMPLETED, FAILED, seconds_between, trend_arrow, trend_points

#: Days by window name; an unknown name is a week.
WINDOWS = {"24h": 1, "7d": 7, "30d": 30}
FLAGGED_RATE = 0.1


def _since(now: Column, window: str) -> Column:
    return F.timestamp_add("DAY", F.lit(-WINDOWS.get(window, 7)), now)


def terminal(wf: DataFrame, now: Column, window: str = "7d", job_class: str | None = None) -> DataFrame:
    """Completed workflows by completion and failed ones by their last update, within the window (both ends included)."""
    ended = F.when(F.col("state") == COMPLETED, F.col("completed_at")).when(F.col("state") == FAILED, F.col("updated_at"))
    d = wf.where(F.col("state").isin(COMPLETED, FAILED))
    d = d if job_class is None else d.where(F.col("job_class") == job_class)
    return d.withColumn("ended_at", ended).where(F.col("ended_at").between(_since(now, window), now))


def _sums() -> list[Column]:
    done = F.col("state") == COMPLETED
    return [F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), F.round(F.avg(F.when(done, seconds_between(F.col("started_at"), F.col("completed_at"))))).cast("bigint").alias("avg_seconds")]


def daily_outcomes(wf: DataFrame, now: Column, window: str = "7d", job_class: str | None = None) -> DataFrame:
    """One row per day that has a terminal workflow."""
    return terminal(wf, now, window, job_class).groupBy(F.date_format("ended_at", "yyyy-MM-dd").alias("day")).agg(*_sums())


def window_totals(wf: DataFrame, now: Column, window: str = "7d", job_class: str | None = None) -> DataFrame:
    d = terminal(wf, now, window, job_class).agg(*_sums())
    n = F.nullif(F.col("completed") + F.col("failed"), F.lit(0))
    return d.select("completed", "failed", (F.col("completed") + F.col("failed")).alias("terminal"), (F.col("completed") / n).alias("completion_rate"), (F.col("failed") / n).alias("failure_rate"), "avg_seconds")


def flagged_days(wf: DataFrame, now: Column, window: str = "7d", rate: float = FLAGGED_RATE) -> DataFrame:
    share = F.col("failed") / (F.col("completed") + F.col("failed"))
    return daily_outcomes(wf, now, window).select("day", "failed", share.alias("failure_rate")).where(F.col("failure_rate") >= rate)


def window_trend(wf: DataFrame, now: Column, window: str = "7d") -> DataFrame:
    """Completion rate of the newer half of the days present, less that of the older half, in points."""
    days = daily_outcomes(wf, now, window)  # at most as many rows as the window has days
    place, n = F.row_number().over(Window.orderBy("day")), F.count("*").over(Window.partitionBy())
    halves = days.withColumn("newer", place > F.floor(n / 2)).withColumn("n", n)
    rate = lambda cond: F.sum(F.when(cond, F.col("completed"))) / F.nullif(F.sum(F.when(cond, F.col("completed") + F.col("failed"))), F.lit(0))
    points = F.round((rate(F.col("newer")) - rate(~F.col("newer"))) * 100, 1)
    return halves.agg(F.when(F.max("n") >= 2, points).alias("completion_points")).withColumn("failure_points", -F.col("completion_points")).withColumns({"arrow": trend_arrow(F.col("completion_points")), "points": trend_points(F.col("completion_points"))})


def top_errors(errors: DataFrame, wf: DataFrame, now: Column, window: str = "7d", job_class: str | None = None, limit: int = 8) -> DataFrame:
    """Most frequent error classes in the window; no class is a class of its own, and ties go by name."""
    d = errors.where(F.col("created_at").between(_since(now, window), now))
    if job_class is not None:
        d = d.join(wf.where(F.col("job_class") == job_class).select(F.col("id").alias("workflow_id")), "workflow_id")
    return d.groupBy("error_class").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), F.asc_nulls_first("error_class")).limit(limit)
