"""One query per operator, over history derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.steps import INTERNAL_KEYS, label, now_at, parsed
from runlens.operators import analytics as an
from runlens.operators import branches as br
from runlens.operators import contexts as cx
from runlens.operators import fleet as fl
from runlens.operators import graphs as gr
from runlens.operators import lifecycle as lc
from runlens.operators import overlay as ov
from runlens.operators import periodic as pe
from runlens.operators import policies as po
from runlens.operators import polls as pl
from runlens.operators import steps as st
from runlens.operators import tables as tb
from runlens.sources import history as hi
from runlens.sources.history import NOW, History, derive
from runlens.sources.shared import saved
from runlens.streaming import jobs, stateful

#: Policies whose classes stand for all below them.
CLASS_POLICIES = (po.Policy("network", 5, 1, 30, ("IOError",)), po.Policy("strict", 1, 1, 30, ("StrictError",)), po.Policy("even", 2, 2, 30, ("Even",)), po.Policy("any", 3, 1, 30))
#: Retention in days of completed and failed workflows.
RETENTION = (20, 30)
URGENT = "1-URGENT"
#: Before this, finished runs may be pruned; the time at which a grid of ticks is held against its runs; bytes of a context that are kept.
CUTOFF, GRID_NOW, KEPT = "2024-01-10 00:00:00", "2024-01-01 18:00:00", 30


def _keys(df: DataFrame) -> DataFrame:
    return df.select("id", "key", "job_class", "state")


def _named(df: DataFrame) -> DataFrame:
    """Timestamps as text, so that any engine compares them alike."""
    return df.select(*(label(F.col(c)).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))


def _polled(h: History) -> DataFrame:
    return pl.history(pl.snapshots(h.workflows, hi.seals(h.workflows), now_at(NOW)))


def _recorded(h: History) -> DataFrame:
    return pl.recorded(hi.polled_branches(h.logs, br.branch_health(h.workflows, h.logs)))


def _marked(h: History) -> DataFrame:
    """The logs and marks of failures, a mark being the only log of its workflow's error without a step."""
    return h.logs.unionByName(hi.failure_marks(h.errors), allowMissingColumns=True)


def _due(h: History) -> DataFrame:
    """Periodic tasks, each with a period of one to five hours."""
    return pe.tasks(h.logs, (F.pmod(F.col("workflow_id"), F.lit(5)) + 1) * 3600)


def _bounded(h: History) -> DataFrame:
    """The same, some with a start of their own and some with an end."""
    k = F.col("workflow_id")
    start = F.when(F.pmod(k, F.lit(2)) == 0, F.timestamp_add("MINUTE", F.pmod(k, F.lit(90)), now_at("2024-01-01 02:00:00")))
    till = F.when(F.pmod(k, F.lit(3)) == 0, F.timestamp_add("HOUR", F.pmod(k, F.lit(12)), now_at("2024-01-01 04:00:00")))
    return pe.tasks(h.logs, (F.pmod(k, F.lit(5)) + 1) * 3600, start, till)


def _states(h: History) -> DataFrame:
    return lc.intervals(lc.marks(h.workflows, hi.lifecycle_marks(h.workflows)), now_at(NOW))


def _starts(h: History) -> DataFrame:
    """Monthly schedules that began between 400 days and some twelve years before a workflow's creation."""
    days = F.lit(400) + F.pmod(F.col("id"), F.lit(13)) * 366
    return h.workflows.select("id", F.to_date(F.timestamp_add("DAY", -days, F.col("created_at"))).alias("start"))


def _pruned(h: History) -> DataFrame:
    return st.prunable_repetitions(h.logs, now_at(CUTOFF))


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    return hi.contexts(spark.read.parquet(f"{folder}/orders.parquet"))


def _context_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts after a few edits: a value set, one set only where it is missing, several merged both ways, one fetched with a default."""
    bag = F.from_json("context", "map<string,string>")
    more = F.create_map(F.lit("status"), F.lit("Z"), F.lit("extra"), F.lit("1"))
    d = _contexts(spark, folder).select("id", bag.alias("c"))
    edited = cx.put_once(cx.put(F.col("c"), "memo", F.lit("m")), "memo", F.lit("n"))
    return d.select("id", cx.fetch(F.col("c"), "customer", F.lit("none")).alias("customer"), cx.fetch(edited, "memo").alias("memo"), cx.fetch(cx.merge(F.col("c"), more), "status").alias("merged"), cx.fetch(cx.merge_once(F.col("c"), more), "status").alias("merged_once"), F.size(cx.merge_once(F.col("c"), more)).alias("keys"))


def _overlay(spark: SparkSession, folder: str) -> DataFrame:
    h = derive(spark, folder)
    return ov.overlay([ov.Node(*x) for x in hi.DEFINITION], h.logs, br.branch_health(h.workflows, h.logs))


def _run_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """A document for every run, with the steps that its nodes were bound to and its branches' children."""
    h = derive(spark, folder)
    # Read several times, derived once; children are counted before, for nodes without a log would all be one key.
    logs = saved(h.logs.select(F.col("id").alias("log_id"), "workflow_id", "step_name", "state").join(gr.child_counts(h.workflows), "log_id", "left").withColumnRenamed("log_id", "id"), "logs")
    found = ov.named_overlay([ov.Node(*x) for x in hi.DEFINITION], logs, br.branch_health(h.workflows, logs)).withColumn("definition", F.lit("fulfilment"))
    return gr.documents(*hi.definition(spark), found).select("workflow_id", "document")


def _bulk_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Children that customers spawn, resumed from a key and sent twice: those that a bulk insert adds beside what is there."""
    customers = tb.after_key(spark.read.parquet(f"{folder}/customer.parquet"), "c_custkey", 50)
    spawned = tb.children(customers, F.col("c_custkey"), F.lit("wf-1"), "fulfil", "mail").select(F.col("child_key").alias("key"), F.col("c_mktsegment").alias("job_class"))
    there = spawned.where(F.col("key").endswith("0"))
    return tb.insert_missing(there, spawned.unionByName(spawned), ["job_class", "key"])


def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Workflows with a later state for every seventh, and one new row for each of those."""
    wf = derive(spark, folder).workflows.select("id", "state", "updated_at")
    seventh = wf.where(F.pmod("id", F.lit(7)) == 0)
    later = seventh.select("id", F.lit(4).alias("state"), F.timestamp_add("SECOND", F.lit(1), F.col("updated_at")).alias("updated_at"))
    fresh = seventh.select((F.col("id") + 1_000_000_000).alias("id"), F.lit(0).alias("state"), "updated_at")
    return _named(tb.upsert(wf, later.unionByName(fresh), ["id"], ["updated_at"]))


def _resumed(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size")
    return tb.after_count(parts, ["p_size", "p_partkey"], 100)


OVER_HISTORY: dict[str, Callable[[History], DataFrame]] = {
    "hist_workflows": lambda h: _named(h.workflows),
    "hist_execution_logs": lambda h: _named(h.logs),
    "hist_error_logs": lambda h: _named(h.errors),
    "daily_outcomes": lambda h: an.daily_outcomes(h.workflows, now_at(NOW)),
    "daily_outcomes_by_class": lambda h: an.daily_outcomes(h.workflows, now_at(NOW), "30d", URGENT),
    "window_totals": lambda h: an.window_totals(h.workflows, now_at(NOW), "30d"),
    "flagged_days": lambda h: an.flagged_days(h.workflows, now_at(NOW), "30d"),
    "window_trend": lambda h: an.window_trend(h.workflows, now_at(NOW)),
    "top_errors": lambda h: an.top_errors(h.errors, h.workflows, now_at(NOW), "30d"),
    "top_errors_by_class": lambda h: an.top_errors(h.errors, h.workflows, now_at(NOW), "30d", URGENT),
    "fleet_overview": lambda h: fl.fleet_overview(h.workflows),
    "fleet_totals": lambda h: fl.fleet_totals(h.workflows),
    "class_share": lambda h: fl.class_share(h.workflows),
    "state_stats_capped": lambda h: fl.state_stats(h.workflows),
    "workflow_page": lambda h: fl.page(_keys(fl.select_workflows(h.workflows, state="completed")), before=1001),
    "workflow_page_prev": lambda h: fl.page(_keys(fl.select_workflows(h.workflows, top_level=True)), after=101),
    "key_prefix_list": lambda h: _keys(fl.select_workflows(h.workflows, key_prefix="wf-12")),
    "blocked_list": lambda h: _keys(fl.select_workflows(h.workflows, state="blocked")),
    "in_flight_list": lambda h: _keys(fl.select_workflows(h.workflows, state="in_flight")),
    "top_level_list": lambda h: _keys(fl.select_workflows(h.workflows, top_level=True)),
    "stranded": lambda h: fl.stranded(h.workflows, now_at(NOW)),
    "stranded_page": lambda h: fl.stranded_page(h.workflows, now_at(NOW), cap=100),
    "created_between": lambda h: _keys(fl.select_workflows(h.workflows, created_from=now_at("2024-01-10 00:00:00"), created_to=now_at("2024-01-11 00:00:00"))),
    "lock_contention": lambda h: tb.contended(h.workflows, now_at("2024-01-20 00:00:00")).select("id", "locked_by"),
    "row_durations": lambda h: fl.row_durations(h.workflows, now_at(NOW)),
    "step_parse": lambda h: parsed(h.logs).select("id", "kind", "step", "number"),
    "step_kind_counts": lambda h: parsed(h.logs).groupBy("kind").agg(F.count("*").alias("steps"), F.count_if(F.col("state") == 2).alias("failed")),
    "active_waits": lambda h: _named(st.active_waits(h.workflows, h.logs)),
    "sleeps": lambda h: st.sleeps(h.logs, now_at("2024-01-20 00:00:00")),
    "evaluated_waits": lambda h: st.evaluated_waits(h.logs, now_at("2024-01-20 00:00:00"), F.pmod("id", F.lit(3)) == 0),
    "idle_waits_page": lambda h: st.oldest_idle_waits(h.workflows, h.logs, now_at(NOW), cap=200),
    "long_waits": lambda h: st.long_waits(h.workflows, h.logs, now_at(NOW)),
    "oldest_event_wait_by_class": lambda h: st.oldest_event_waits(h.workflows, h.logs),
    "current_position": lambda h: st.current_position(h.logs),
    "repetition_summary": lambda h: st.repetition_summary(h.logs, "sync_job"),
    "repetition_page": lambda h: fl.page(st.runs_of(h.logs, "sync_job").select("id", "workflow_id", "step_name")),
    "repetition_meters": lambda h: st.repetition_meters(fl.page(st.runs_of(h.logs, "sync_job"))),
    "repetition_lateness": lambda h: st.repetition_lateness(h.logs, "sync_job"),
    "periodic_health": lambda h: st.periodic_health(h.logs),
    "recent_latencies": lambda h: st.recent_latencies(h.logs),
    "repetition_prune": _pruned,
    "timeline_steps": lambda h: st.timeline(_marked(h), h.errors),
    "timeline_errors": lambda h: st.timeline_errors(h.logs, h.errors),
    "failure_markers": lambda h: st.failure_markers(hi.failure_marks(h.errors), h.errors),
    "step_meters": lambda h: st.step_meters(h.logs),
    "metadata_pairs": lambda h: st.metadata_pairs(h.logs, INTERNAL_KEYS),
    "orphan_errors": lambda h: st.orphan_errors(_marked(h), h.errors),
    "branch_health": lambda h: br.branch_health(h.workflows, h.logs),
    "merge_states": lambda h: br.merge_states(h.logs),
    "unmerged_branches": lambda h: br.merge_states(h.logs).where("merge_state <> 'merged'").select("workflow_id", "branch"),
    "parent_breadcrumb": lambda h: br.parents(h.workflows, h.logs),
    "drain_rate": lambda h: _polled(h).select("branch_id", "poll", "pending", F.round("rate", 12).alias("rate"), "eta_seconds"),
    "poll_cadence": lambda h: _polled(h).select("branch_id", "poll", F.round("interval", 9).alias("interval"), label(F.col("next_poll_at")).alias("next_poll_at")),
    "poll_counters": lambda h: _polled(h).select("branch_id", "poll", "polls", "recorded_rate", "spawned", "running", "never_started", "rekicked", "rekick_total", label(F.col("last_rekick_at")).alias("last_rekick_at")),
    "fenced_polls": lambda h: pl.fenced(hi.poll_owners(_polled(h)), hi.poll_tokens(h.workflows)).select("branch_id", "poll", "token"),
    "poll_overdue": lambda h: pl.overdue_branches(_recorded(h), now_at(NOW)),
    "merge_throughput": lambda h: pl.merges(h.logs, _recorded(h), now_at(NOW)),
    "merge_drain": lambda h: pl.merge_drain(h.logs, _polled(h)).withColumn("rate", F.round("rate", 12)),
    "branch_counts_shown": lambda h: pl.counts_shown(br.branch_health(h.workflows, h.logs), _recorded(h)),
    "rekick_candidates": lambda h: br.rekick_candidates(h.workflows, h.logs, now_at(NOW)),
    "retention_deleted": lambda h: br.expired(h.workflows, now_at(NOW), *RETENTION).select("id", "state"),
    "retention_survivors": lambda h: br.survivors(h.workflows, now_at(NOW), *RETENTION).select("id", "state"),
    "retention_orphaned_children": lambda h: br.orphaned_children(h.workflows, h.logs, now_at(NOW), *RETENTION),
    "cleanup_counts": lambda h: br.cleanup_counts(h.workflows, h.logs, h.errors, _pruned(h), now_at(NOW), *RETENTION),
    "fast_forward": lambda h: pe.fast_forward(_due(h), now_at(NOW)),
    "tick_grid_calendar": lambda h: pe.calendar_grid(_starts(h), now_at(NOW)),
    "tick_grid_runs": lambda h: pe.grid_runs(_due(h), h.logs, now_at(GRID_NOW)),
    "tick_grid_bounded": lambda h: pe.grid_runs(_bounded(h), h.logs, now_at(GRID_NOW)),
    "state_intervals": lambda h: _named(_states(h)).withColumn("seconds", F.round("seconds", 3)),
    "time_in_states": lambda h: lc.time_in_states(_states(h), h.workflows),
    "illegal_transitions": lambda h: _named(lc.illegal_transitions(_states(h))),
    "lock_sessions": lambda h: _named(lc.lock_sessions(hi.lock_touches(h.logs))),
    "lock_overlaps": lambda h: _named(lc.lock_overlaps(lc.lock_sessions(hi.lock_touches(h.logs)))),
    "run_timeouts": lambda h: pe.run_timeouts(h.logs, now_at("2024-01-01 06:30:00")),
    "failed_runs": lambda h: pe.failed_runs(h.logs.withColumn("error_class", F.when(F.pmod("id", F.lit(2)) == 0, F.col("error_class")).otherwise("Err1")), F.lit(3600), F.when(F.pmod("workflow_id", F.lit(3)) == 0, pe.FAIL_WORKFLOW).otherwise(pe.CONTINUE)),
    "retry_backoff_bounds": lambda h: po.backoff_bounds(h.errors).unionByName(po.backoff_bounds(h.errors, po.WORKFLOW)).unionByName(po.backoff_bounds(h.errors, po.WAIT)),
    "retry_routing": lambda h: po.routed(h.errors),
    "retry_routing_by_class": lambda h: po.routed_by_class(h.errors, hi.error_classes(h.errors.sparkSession), CLASS_POLICIES),
    "retry_budget_bound": lambda h: po.loosest(h.workflows.select(F.col("job_class").alias("composite"), F.when(F.pmod("id", F.lit(5)) != F.pmod(F.ascii("job_class"), F.lit(5)), F.pmod("id", F.lit(9)) + 1).alias("attempts")).where("id % 2 = 1")),
    "policy_resolution": lambda h: po.resolved(parsed(h.logs).join(h.workflows.select(F.col("id").alias("workflow_id"), "job_class"), "workflow_id").withColumn("call", F.when(F.pmod("id", F.lit(4)) == 0, "strict")), {"1-URGENT": po.WORKFLOW, "2-HIGH": po.Policy("gentle", None, 2, 60)}, po.POLICIES),
    "complete_without_merge": lambda h: br.complete_without_merge(h.workflows, h.logs),
    "exec_time_percentiles": lambda h: br.percentiles(h.workflows, "started_at", "completed_at"),
    "queue_wait_percentiles": lambda h: br.percentiles(h.workflows, "created_at", "started_at"),
    "dispatch_throughput": lambda h: br.throughput(h.workflows),
}


OVER_TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "context_nodes": lambda spark, folder: cx.nodes(_contexts(spark, folder)),
    "context_sizes": lambda spark, folder: cx.sizes(_contexts(spark, folder)),
    "context_budget": lambda spark, folder: cx.within_budget(_contexts(spark, folder), KEPT),
    "context_edits": _context_edits,
    "definition_overlay": _overlay,
    "run_graphs": _run_graphs,
    "bulk_insert": _bulk_insert,
    "upserted": _upserted,
    "resumed_by_count": _resumed,
    "stream_daily_errors": jobs.stream_daily_errors,
    "stream_first_events": jobs.stream_first_events,
    "stream_wait_outcomes": jobs.stream_wait_outcomes,
    "stream_drain": jobs.stream_drain,
    "stream_sleeps": stateful.stream_sleeps,
    "stream_wait_timeouts": stateful.stream_wait_timeouts,
    "stream_stale_runs": stateful.stream_stale_runs,
    "stream_barriers": stateful.stream_barriers,
    "stream_by_key": stateful.stream_by_key,
    "stream_bulk_insert": stateful.stream_bulk_insert,
    "stream_late_events": stateful.stream_late_events,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    over = lambda f: lambda spark, folder: f(derive(spark, folder))
    return {name: over(f) for name, f in OVER_HISTORY.items()} | OVER_TABLES
