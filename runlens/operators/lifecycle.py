"""States of workflows over time, from their marks, and sessions of those who held their locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.steps import of_kinds, seconds_between

#: State that a lifecycle mark leads to.
AFTER = {"completion": "completed", "failure": "failed", "retry": "idle"}
#: Transitions that the engine makes: (from, to).
LEGAL = {("idle", "running"), ("running", "idle"), ("running", "completed"), ("running", "failed"), ("running", "stalled"), ("failed", "idle"), ("stalled", "idle")}
#: Seconds after which a lock that nobody renews is free.
LOCK_SECONDS = 600


def marks(wf: DataFrame, logs: DataFrame) -> DataFrame:
    """``workflow_id``, ``at``, ``state``, ``source`` of every change that history records: creation, start, and lifecycle marks by when they began.

    Marks of other names, and times that are missing, are left out.
    """
    of = lambda column, state: wf.select(F.col("id").alias("workflow_id"), F.col(column).alias("at"), F.lit(state).alias("state"), F.lit(0).alias("source"))
    named = F.create_map(*(F.lit(x) for pair in AFTER.items() for x in pair))
    told = of_kinds(logs, "lifecycle").select("workflow_id", F.col("started_at").alias("at"), F.try_element_at(named, "step").alias("state"), F.col("id").alias("source"))
    return of("created_at", "idle").unionByName(of("started_at", "running")).unionByName(told).where("at is not null and state is not null")


def intervals(changes: DataFrame, now: Column) -> DataFrame:
    """``workflow_id``, ``place``, ``state``, ``since``, ``until``, ``seconds``, ``before`` (the state that it follows), ``legal`` for every interval between changes.

    Changes count in the order of their times, whatever order they are recorded in; at the
    same time idle comes before running, and others come after, by ``source``.  The last
    interval lasts to ``now``; changes after ``now`` are left out.
    """
    rank = F.when(F.col("state") == "idle", F.when(F.col("source") == 0, 0).otherwise(3)).when(F.col("state") == "running", 1).otherwise(2)
    order = Window.partitionBy("workflow_id").orderBy("at", "rank", "source")
    d = changes.where(F.col("at") <= now).withColumn("rank", rank)
    d = d.select("workflow_id", F.row_number().over(order).alias("place"), "state", F.col("at").alias("since"), F.coalesce(F.lead("at").over(order), now).alias("until"), F.lag("state").over(order).alias("before"))
    step = F.concat_ws(">", "before", "state")
    legal = F.when(F.col("before").isNull(), F.col("state") == "idle").otherwise(step.isin(sorted(f"{a}>{b}" for a, b in LEGAL)))
    return d.withColumn("seconds", seconds_between(F.col("since"), F.col("until"))).withColumn("legal", legal)


def time_in_states(found: DataFrame, wf: DataFrame) -> DataFrame:
    """Per class and state: workflows, visits, and seconds in all and at most."""
    each = found.groupBy("workflow_id", "state").agg(F.count("*").alias("visits"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))
    d = each.join(wf.select(F.col("id").alias("workflow_id"), "job_class"), "workflow_id")
    return d.groupBy("job_class", "state").agg(F.count("*").alias("workflows"), F.sum("visits").alias("visits"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.max("longest"), 3).alias("longest"))


def illegal_transitions(found: DataFrame) -> DataFrame:
    """Intervals that the one before can't lead to."""
    return found.where(~F.col("legal")).select("workflow_id", "place", "before", "state", "since")


def lock_sessions(touches: DataFrame, seconds: int = LOCK_SECONDS) -> DataFrame:
    """``workflow_id``, ``owner``, ``since``, ``until``, ``touches``: an owner's uses of a lock, as long as each comes at most ``seconds`` after the last.

    ``until`` is when the lock was free, ``seconds`` after the last use.
    """
    d = touches.where("workflow_id is not null and owner is not null and at is not null")
    found = d.groupBy("workflow_id", "owner", F.session_window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("touches"))
    return found.select("workflow_id", "owner", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "touches")


def lock_overlaps(sessions: DataFrame) -> DataFrame:
    """Pairs of sessions of two owners that held a workflow at once: ``workflow_id``, ``first``, ``second`` (owners, by who came first), ``since``, ``until`` of the overlap."""
    a = sessions.select("workflow_id", F.col("owner").alias("first"), F.col("since").alias("a0"), F.col("until").alias("a1"))
    b = sessions.select("workflow_id", F.col("owner").alias("second"), F.col("since").alias("b0"), F.col("until").alias("b1"))
    met = (F.col("first") != F.col("second")) & (F.col("b0") < F.col("a1")) & ((F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("first") < F.col("second"))))
    return a.join(b, "workflow_id").where(met).select("workflow_id", "first", "second", F.col("b0").alias("since"), F.least("a1", "b1").alias("until"))
