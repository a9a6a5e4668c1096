"""Waits, positions, repetitions, timelines and their errors, from execution logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.steps import IDLE, LOG_COMPLETED, LOG_FAILED, LOG_PENDING, attempts_note, duration_steps, human_duration, kind_label, label, metadata_time, now_at, of_kinds, parsed, seconds_after, seconds_between

LONG_WAIT, LATENCIES, EPOCH = 3600, 20, "1970-01-01 00:00:00"


def active_waits(wf: DataFrame, logs: DataFrame) -> DataFrame:
    """The latest pending wait of every idle workflow: later start wins, no start loses, then the larger id."""
    pending = of_kinds(logs.where(F.col("state") == LOG_PENDING), "wait", "continue")
    last = F.row_number().over(Window.partitionBy("workflow_id").orderBy(F.desc_nulls_last("started_at"), F.desc("id")))
    latest = pending.withColumn("_n", last).where("_n = 1").select("workflow_id", "kind", F.col("step").alias("condition"), F.col("started_at").alias("waiting_since"), metadata_time("timeout_at").alias("timeout_at"))
    return wf.where(F.col("state") == IDLE).select(F.col("id").alias("workflow_id"), "job_class").join(latest, "workflow_id")


def long_waits(wf: DataFrame, logs: DataFrame, now: Column, threshold: int = LONG_WAIT) -> DataFrame:
    """Waits older than ``threshold`` seconds; event waits among them are urgent, and a time-out ahead makes one scheduled."""
    age = seconds_between(F.col("waiting_since"), now)
    return active_waits(wf, logs).where(age > threshold).select("workflow_id", "kind", "condition", age.cast("bigint").alias("waited"), (F.col("kind") == "continue").alias("urgent"), F.coalesce((F.col("kind") == "wait") & (F.col("timeout_at") > now), F.lit(False)).alias("scheduled"))


def oldest_event_waits(wf: DataFrame, logs: DataFrame) -> DataFrame:
    d = active_waits(wf, logs).where(F.col("kind") == "continue")
    return d.groupBy("job_class").agg(F.min(F.struct("waiting_since", "workflow_id")).alias("first"), F.count("*").alias("waits")).select("job_class", F.col("first.workflow_id").alias("workflow_id"), label(F.col("first.waiting_since")).alias("waiting_since"), "waits")


def current_position(logs: DataFrame) -> DataFrame:
    """The step a workflow stands at: its latest failed step, else its latest pending wait with a condition, else its last step."""
    order = F.struct("started_at", "id")
    kept = parsed(logs).where(F.col("kind") != "repeat_run")
    latest = lambda cond: F.max_by(F.when(cond, F.col("step_name")), F.when(cond, order))
    found = F.coalesce(latest(F.col("state") == LOG_FAILED), latest((F.col("kind") == "wait") & (F.col("state") == LOG_PENDING)), F.max_by("step_name", order))
    return kept.groupBy("workflow_id").agg(found.alias("position"))


def sleeps(logs: DataFrame, now: Column) -> DataFrame:
    """Pending sleeps: done once ``now`` has reached the time fixed when they began, the time itself included; seconds left of the others."""
    until = F.col("until")
    d = of_kinds(logs.where(F.col("state") == LOG_PENDING), "sleep").select("id", "workflow_id", metadata_time("wait_until").alias("until"))
    return d.select("id", "workflow_id", label(until).alias("until"), F.coalesce(until <= now, F.lit(False)).alias("done"), F.when(until > now, seconds_between(now, until).cast("bigint")).alias("left"))


def evaluated_waits(logs: DataFrame, now: Column, met: Column) -> DataFrame:
    """What a look at every pending wait comes to, ``met`` being its condition.

    The condition is looked at first, so that one that holds after the time-out still
    counts; then a ``wait`` is timed out once ``now`` is past its time-out, not at it,
    which stalls its workflow.  A ``continue`` has no time-out and goes on waiting.
    """
    d = of_kinds(logs.where(F.col("state") == LOG_PENDING), "wait", "continue")
    late = (F.col("kind") == "wait") & (metadata_time("timeout_at") < now)
    outcome = F.when(met, "met").when(F.coalesce(late, F.lit(False)), "timed_out").otherwise("waiting")
    return d.select("id", "kind", outcome.alias("outcome")).withColumn("stalls", F.col("outcome") == "timed_out")


def repetition_meters(page: DataFrame) -> DataFrame:
    """Lateness and duration of the runs of a page, each beside the page's largest (one second, if there is none)."""
    number = F.get(F.split("step_name", r"\$", 3), 2).try_cast("bigint")
    late = seconds_between(seconds_after(now_at(EPOCH), number), F.col("started_at")).cast("bigint")
    d = page.select("id", late.alias("late"), seconds_between(F.col("started_at"), F.col("completed_at")).cast("bigint").alias("took"))
    most = lambda c, cond: F.coalesce(F.max(F.when(cond, F.col(c))).over(Window.partitionBy()), F.lit(1))  # noqa: E731  a page has 200 rows at most
    d = d.select("*", most("late", F.col("late") > 0).alias("most_late"), most("took", F.col("took").isNotNull()).alias("most_took"))
    return d.select("id", F.when(F.col("late") <= 0, "on time").otherwise(human_duration(F.col("late"))).alias("late"), duration_steps(F.col("late"), F.col("most_late")).alias("late_bar"), human_duration(F.col("took")).alias("took"), duration_steps(F.col("took"), F.col("most_took")).alias("took_bar"))


def runs_of(logs: DataFrame, step: str) -> DataFrame:
    return logs.where(F.col("step_name").startswith(f"durably_repeat${step}$"))


def _skipped() -> Column:
    return F.greatest(F.coalesce(F.get_json_object("metadata", "$.fast_forwarded").try_cast("bigint"), F.lit(0)), F.lit(1))


def repetition_summary(logs: DataFrame, step: str) -> DataFrame:
    """Per workflow: iterations, completed, failed ones (tombstones), ticks skipped, start of the last run."""
    failed = F.col("state") == LOG_FAILED
    return runs_of(logs, step).groupBy("workflow_id").agg(F.count("*").alias("iterations"), F.count_if(F.col("state") == LOG_COMPLETED).alias("completed"), F.count_if(failed).alias("tombstones"), F.coalesce(F.sum(F.when(failed, _skipped())), F.lit(0)).alias("skipped_ticks"), label(F.max("started_at")).alias("last_run_at"))


def repetition_lateness(logs: DataFrame, step: str) -> DataFrame:
    late = seconds_between(seconds_after(now_at(EPOCH), F.col("number")), F.col("started_at")).cast("bigint")
    return parsed(runs_of(logs, step)).select("id", "number", F.greatest(late, F.lit(0)).alias("late_seconds"), (late > 60).alias("late"))


def periodic_health(logs: DataFrame) -> DataFrame:
    """Per workflow and periodic step: last execution on record, next run due, ticks missed.

    Coordinations and runs are of one name, so that one grouping finds both; runs of no
    coordination are left out.
    """
    coordinates = F.col("kind") == "repeat_coordination"
    missed = ~coordinates & (F.col("error_class") == "TimeoutError")
    d = of_kinds(logs, "repeat_coordination", "repeat_run").groupBy("workflow_id", "step").agg(
        F.count_if(coordinates).alias("_tasks"), F.max(F.when(coordinates, F.get_json_object("metadata", "$.last_execution_at"))).alias("last_execution_at"),
        F.max(F.when(~coordinates & (F.col("state") == LOG_PENDING), F.col("number"))).alias("next_due"), F.coalesce(F.sum(F.when(missed, _skipped())), F.lit(0)).alias("missed_ticks"),
    )
    return d.where("_tasks > 0").drop("_tasks")


def recent_latencies(logs: DataFrame, most: int = LATENCIES) -> DataFrame:
    """Per workflow and periodic step: mean and last of the whole seconds that the last ``most`` completed runs took."""
    took = seconds_between(F.col("started_at"), F.col("completed_at")).cast("bigint")
    d = of_kinds(logs.where(F.col("state") == LOG_COMPLETED), "repeat_run").withColumn("latency", took).where("latency is not null")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("workflow_id", "step").orderBy(F.desc("id")))).where(F.col("_n") <= most)
    d = d.groupBy("workflow_id", "step").agg(F.count("*").alias("runs"), F.avg("latency").alias("mean_latency"), F.max_by("latency", "id").alias("last_latency"))
    shown = F.concat(F.lit("avg "), F.round("mean_latency").cast("bigint").cast("string"), F.lit("s · last "), F.col("last_latency").cast("string"), F.lit("s"))
    return d.withColumn("shown", shown)


def prunable_repetitions(logs: DataFrame, cutoff: Column) -> DataFrame:
    """Finished runs scheduled before the cutoff and before their task's frontier; without a frontier nothing is pruned."""
    frontier = of_kinds(logs, "repeat_coordination").select("workflow_id", "step", metadata_time("last_execution_at").alias("frontier"))
    runs = of_kinds(logs.where(F.col("state") != LOG_PENDING), "repeat_run").withColumn("scheduled", seconds_after(now_at(EPOCH), F.col("number"))).where(F.col("scheduled") < cutoff)
    return runs.join(frontier, ["workflow_id", "step"]).where(F.col("scheduled") < F.col("frontier")).select("id")


def timeline(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """Steps of all timelines (runs of periodic steps left out) with their errors counted: those of their name, and for a failure's mark the one that it names."""
    named = errors.where(F.col("step_name").isNotNull()).select("workflow_id", "step_name", "id", "attempt")
    marked = _marks(logs).join(errors.select("workflow_id", F.col("id").alias("number"), "attempt"), ["workflow_id", "number"]).select("workflow_id", "step_name", F.col("number").alias("id"), "attempt")
    counts = named.unionByName(marked).groupBy("workflow_id", "step_name").agg(F.countDistinct("id").alias("errors"), F.max("attempt").alias("last_attempt"))
    d = parsed(logs).where(F.col("kind") != "repeat_run")
    place = F.row_number().over(Window.partitionBy("workflow_id").orderBy("started_at", "id"))
    return d.select("id", "workflow_id", "step_name", "kind", place.alias("place")).join(counts, ["workflow_id", "step_name"], "left").select("id", "kind", "place", F.coalesce("errors", F.lit(0)).alias("errors"), "last_attempt")


def _marks(logs: DataFrame) -> DataFrame:
    """Marks of failed workflows with the ``number`` of the error that each names; a number that marks repeat counts once."""
    marks = of_kinds(logs, "lifecycle").where((F.col("step") == "failure") & F.col("number").isNotNull())
    return marks.select("workflow_id", "step_name", "number").distinct()


def orphan_errors(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """Errors that belong to no step of their workflow's timeline: no log has their step's name, and no mark of a failure names them."""
    rest = errors.join(logs.select("workflow_id", "step_name"), ["workflow_id", "step_name"], "left_anti").where(F.col("step_name").isNull() | ~F.col("step_name").rlike(r"^durably_repeat\$.+\$"))
    shown = _marks(logs).select("workflow_id", F.col("number").alias("id"))
    return rest.join(shown, ["workflow_id", "id"], "left_anti").select("id", "error_class", "attempt")


def failure_markers(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """Marks of failed workflows with the error that each names; ``missing_error_id`` where that error is gone."""
    marks = of_kinds(logs, "lifecycle").where((F.col("step") == "failure") & F.col("number").isNotNull()).select("id", "workflow_id", "number")
    named = errors.select("workflow_id", F.col("id").alias("number"), F.col("id").alias("error_id"), "error_class", "attempt")
    return marks.join(named, ["workflow_id", "number"], "left").select("id", "workflow_id", "error_id", "error_class", "attempt", F.when(F.col("error_id").isNull(), F.col("number")).alias("missing_error_id"))


def timeline_errors(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """Errors as a timeline lists them: under their step, by attempt, then time, then id, with their place."""
    steps = logs.where(~F.col("step_name").rlike(r"^durably_repeat\$.+\$")).select("workflow_id", "step_name", F.col("id").alias("step_id"))
    place = F.row_number().over(Window.partitionBy("step_id").orderBy("attempt", "created_at", "error_id"))
    return errors.select("workflow_id", "step_name", F.col("id").alias("error_id"), "attempt", "created_at", "error_class").join(steps, ["workflow_id", "step_name"]).select("step_id", "error_id", "attempt", "error_class", place.alias("place"))


SLOW_STEP = 60


def step_meters(logs: DataFrame) -> DataFrame:
    """Finished steps of a timeline: their kind's label, a note on attempts, seconds, how long that is beside the workflow's longest step, and whether it is slow."""
    took = F.floor(seconds_between(F.col("started_at"), F.col("completed_at"))).cast("bigint")
    d = parsed(logs).where(F.col("kind") != "repeat_run").withColumn("seconds", took)
    longest = F.max("seconds").over(Window.partitionBy("workflow_id"))
    return d.select("id", "attempts", "kind", "seconds", longest.alias("longest")).where("seconds is not null").select("id", kind_label(F.col("kind")).alias("label"), attempts_note(F.col("kind"), F.col("attempts")).alias("note"), "seconds", human_duration(F.col("seconds")).alias("shown"), duration_steps(F.col("seconds"), F.col("longest")).alias("bar"), (F.col("seconds") >= SLOW_STEP).alias("slow"))


def metadata_pairs(logs: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """Keys and values of steps' metadata worth listing: blank values and internal keys are left out, and underscores in keys are blanks."""
    pairs = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: v.isNotNull() & (v != "") & ~k.isin(*hidden))
    return logs.where("metadata is not null").select("id", F.explode(pairs).alias("key", "value")).select("id", F.replace("key", F.lit("_"), F.lit(" ")).alias("key"), "value")


WAITS_SHOWN = 500


def oldest_idle_waits(wf: DataFrame, logs: DataFrame, now: Column, cap: int = WAITS_SHOWN) -> DataFrame:
    """Waits of the ``cap`` idle workflows with the smallest ids: the cap comes before the waits are looked up, so fewer rows may come back.

    ``capped`` tells whether there are more idle workflows than that; waits without a start sort as if they began now.
    """
    idle = wf.where(F.col("state") == IDLE).orderBy("id").limit(cap + 1)
    place = F.row_number().over(Window.orderBy("id"))
    first = idle.select("id", "job_class", "state", place.alias("_n"), (F.count("*").over(Window.partitionBy()) > cap).alias("capped")).where(F.col("_n") <= cap)
    waits = active_waits(first, logs).join(first.select(F.col("id").alias("workflow_id"), "capped"), "workflow_id")
    since = F.coalesce("waiting_since", now)
    return waits.select("workflow_id", "job_class", "kind", "condition", label(F.col("waiting_since")).alias("waiting_since"), "capped", F.row_number().over(Window.orderBy(since, "workflow_id")).alias("place"))
