"""Fan-out branches: health, merges, drain rate, cadence, rekicks, and retention of whole histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.steps import COMPLETED, FAILED, IDLE, LOG_COMPLETED, RUNNING, STALLED

REKICKS, REKICK_AFTER = 200, 300


def _branches(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("step_name").startswith("branch$")).select(F.col("id").alias("branch_id"), F.col("workflow_id").alias("parent_id"), (F.col("state") == LOG_COMPLETED).alias("sealed"))


def branch_health(wf: DataFrame, logs: DataFrame) -> DataFrame:
    """Counts of children per branch; done when sealed and all children are completed.

    Children are counted by their parent's id before the join, each task its own first,
    so that a branch of very many is no task's alone.
    """
    s, counts = F.col("state"), ("spawned", "pending", "blocked", "never_started", "running", "failed", "progressing")
    d = wf.where(F.col("parent_execution_log_id").isNotNull()).groupBy(F.col("parent_execution_log_id").alias("branch_id")).agg(
        F.count("*").alias("spawned"), F.count_if(s != COMPLETED).alias("pending"), F.count_if(s.isin(FAILED, STALLED)).alias("blocked"), F.count_if((s == IDLE) & F.col("started_at").isNull()).alias("never_started"),
        F.count_if(s == RUNNING).alias("running"), F.count_if(s == FAILED).alias("failed"), F.count_if((s == RUNNING) | ((s == IDLE) & F.col("started_at").isNull())).alias("progressing"),
    )
    d = _branches(logs).join(d, "branch_id", "left").select("branch_id", "parent_id", "sealed", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "active").when(F.col("spawned") > 0, "done").otherwise("not_reached")
    return d.withColumn("done", F.col("sealed") & (F.col("pending") == 0)).withColumn("status", status)


def merge_states(logs: DataFrame) -> DataFrame:
    """Every branch with the state of the merge that names it: merged wins over merging, none is unmerged."""
    names = logs.where(F.col("step_name").startswith("merge$")).select("workflow_id", F.explode(F.split(F.substring("step_name", 7, 1 << 30), ",")).alias("branch"), (F.col("state") == LOG_COMPLETED).alias("merged"))
    merges = names.groupBy("workflow_id", "branch").agg(F.bool_or("merged").alias("merged"))
    branch = logs.where(F.col("step_name").startswith("branch$")).select("workflow_id", F.substring("step_name", 8, 1 << 30).alias("branch"))
    state = F.when(F.col("merged").isNull(), "unmerged").when(F.col("merged"), "merged").otherwise("merging")
    return branch.join(merges, ["workflow_id", "branch"], "left").select("workflow_id", "branch", state.alias("merge_state"))


def parents(wf: DataFrame, logs: DataFrame) -> DataFrame:
    up = logs.select(F.col("id").alias("parent_execution_log_id"), F.col("workflow_id").alias("parent_id"), "step_name")
    named = wf.select(F.col("id").alias("parent_id"), F.col("key").alias("parent_key"))
    return wf.select("id", "parent_execution_log_id").join(up, "parent_execution_log_id", "left").join(named, "parent_id", "left").select("id", "parent_id", "parent_key", F.col("step_name").alias("branch"))


def rekick_candidates(wf: DataFrame, logs: DataFrame, now: Column, most: int = REKICKS) -> DataFrame:
    """The first ``most`` children of every branch that were dispatched but never started and have not moved for a while.

    They are ranked before the join, each task keeping no more than that of a branch before it shuffles.
    """
    lost = wf.where(F.col("parent_execution_log_id").isNotNull() & (F.col("state") == IDLE) & F.col("started_at").isNull() & (F.col("updated_at") < F.timestamp_add("SECOND", F.lit(-REKICK_AFTER), now)))
    place = F.row_number().over(Window.partitionBy("branch_id").orderBy("child_id"))
    first = lost.select(F.col("parent_execution_log_id").alias("branch_id"), F.col("id").alias("child_id")).withColumn("place", place).where(F.col("place") <= most)
    return first.join(_branches(logs).select("branch_id"), "branch_id", "left_semi").select("branch_id", "child_id", "place")


def expired(wf: DataFrame, now: Column, completed_days: int, failed_days: int) -> DataFrame:
    """Workflows past retention: completed by completion, failed by last update; others never."""
    ago = lambda days: F.timestamp_add("DAY", F.lit(-days), now)
    s = F.col("state")
    return wf.where(((s == COMPLETED) & (F.col("completed_at") <= ago(completed_days))) | ((s == FAILED) & (F.col("updated_at") <= ago(failed_days))))


def cleanup_counts(wf: DataFrame, logs: DataFrame, errors: DataFrame, pruned: DataFrame, now: Column, completed_days: int, failed_days: int) -> DataFrame:
    """Rows that a cleanup deletes, by table, and children that lose their parent; ``pruned``: ids of runs that are pruned besides.

    Runs of deleted workflows count as execution logs, not as pruned runs.
    """
    gone = expired(wf, now, completed_days, failed_days).select(F.col("id").alias("workflow_id"))
    kept_runs = logs.join(pruned.select("id"), "id", "left_semi").join(gone, "workflow_id", "left_anti")
    counted = {"workflows": gone, "execution_logs": logs.join(gone, "workflow_id", "left_semi"), "error_logs": errors.join(gone, "workflow_id", "left_semi"), "repetition_logs": kept_runs, "orphaned_children": orphaned_children(wf, logs, now, completed_days, failed_days)}
    return reduce(DataFrame.unionByName, (rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("category"), "rows") for name, rows in counted.items()))


def survivors(wf: DataFrame, now: Column, completed_days: int, failed_days: int) -> DataFrame:
    return wf.join(expired(wf, now, completed_days, failed_days).select("id"), "id", "left_anti")


def orphaned_children(wf: DataFrame, logs: DataFrame, now: Column, completed_days: int, failed_days: int) -> DataFrame:
    """Surviving workflows whose parent goes: their parent is cleared."""
    gone = logs.join(expired(wf, now, completed_days, failed_days).select(F.col("id").alias("workflow_id")), "workflow_id", "left_semi").select(F.col("id").alias("parent_execution_log_id"))
    return survivors(wf, now, completed_days, failed_days).join(gone, "parent_execution_log_id", "left_semi").select("id")


def complete_without_merge(wf: DataFrame, logs: DataFrame) -> DataFrame:
    """Completed workflows that the completion gate would have held: some branch of theirs isn't merged."""
    held = merge_states(logs).where("merge_state <> 'merged'").groupBy(F.col("workflow_id").alias("id")).agg(F.count("*").alias("open_branches"))
    return wf.where(F.col("state") == COMPLETED).select("id", "key").join(held, "id")


def percentiles(wf: DataFrame, start: str, end: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Mean, exact percentiles and maximum of the seconds between two columns, over completed workflows by class.

    Workflows are counted by class and second first.  Only these counts, as many as
    there are different durations, are put in order to find the ranks around a
    percentile, between which it lies in proportion.
    """
    x = F.timestamp_diff("SECOND", F.col(start), F.col(end))
    counts = wf.where((F.col("state") == COMPLETED) & F.col(start).isNotNull()).select("job_class", x.alias("x")).groupBy("job_class", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("job_class").orderBy("x"))
    ranked = counts.select("*", upto.alias("upto"), F.sum("n").over(Window.partitionBy("job_class")).alias("total"))

    def point(q: float) -> Column:
        at = (F.max("total") - 1) * q
        value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
        low, high = value(F.floor((F.col("total") - 1) * q)), value(F.ceil((F.col("total") - 1) * q))
        return F.round(low + (high - low) * (at - F.floor(at)), 6)

    named = [point(q).alias(f"p{round(q * 100)}") for q in points]
    return ranked.groupBy("job_class").agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("mean"), *named, F.max("x").alias("longest"))


def throughput(wf: DataFrame) -> DataFrame:
    """Workflows per second from the first creation to the last completion, and to the last creation."""
    span = lambda end: F.timestamp_diff("SECOND", F.min("created_at"), F.max(end))
    return wf.groupBy("job_class").agg(F.round(F.count("completed_at") / span("completed_at"), 9).alias("completed_per_second"), F.round(F.count("*") / span("created_at"), 9).alias("dispatched_per_second"))
