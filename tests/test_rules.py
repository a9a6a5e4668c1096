"""Golden values of rules that code and SQL might misread alike, and of state, locks, graphs and deletion."""

import json
import os

import pytest
from pyspark.sql import functions as F

from runlens.functions.steps import now_at, time_of
from runlens.operators import branches, fleet, graphs, lifecycle, overlay, periodic, policies, polls, tables
from runlens.operators import steps as st
from runlens.sources import history as hi
from runlens.sources import shared
from test_history import LOGS, WF, table, values

ERRORS = "id long, workflow_id long, step_name string, attempt int, error_class string, created_at timestamp_ntz"


def test_times_with_offsets(spark):
    given = {"2024-01-01T05:00:00Z": "2024-01-01 05:00:00", "2024-01-01T05:00:00+02:00": "2024-01-01 03:00:00", "2024-01-01T23:30:00-0530": "2024-01-02 05:00:00", "2024-01-01 05:00:00 UTC": "2024-01-01 05:00:00", "2024-01-05": "2024-01-05 00:00:00", "2024-01-01T05:00:00": "2024-01-01 05:00:00", "no time": "None"}
    d = spark.createDataFrame([(x,) for x in given], "x string")
    assert [str(r[0]) for r in d.select(time_of(F.col("x"))).collect()] == list(given.values())


def test_errors_under_a_failure_mark_are_no_orphans(spark):
    logs = table(spark, LOGS, [{"id": 1, "workflow_id": 1, "step_name": "$workflow_failure$55", "state": 1}, {"id": 2, "workflow_id": 1, "step_name": "durably_execute$a", "state": 2}, {"id": 3, "workflow_id": 2, "step_name": "$workflow_failure$55", "state": 1}])
    errors = table(spark, ERRORS, [{"id": 55, "workflow_id": 1, "attempt": 4}, {"id": 56, "workflow_id": 1, "attempt": 1}, {"id": 57, "workflow_id": 1, "step_name": "durably_execute$a", "attempt": 2}, {"id": 58, "workflow_id": 1, "step_name": "durably_repeat$x$1", "attempt": 1}])
    assert [r.id for r in st.orphan_errors(logs, errors).collect()] == [56]
    assert sorted(values(st.timeline(logs, errors), "id", "errors", "last_attempt")) == [(1, 1, 4), (2, 1, 2), (3, 0, None)]


def test_spawned_is_fixed_by_the_seal(spark):
    child = lambda k, created, done=None: {"id": k, "state": 2 if done else 0, "created_at": f"2024-01-{created:02d}", "completed_at": done and f"2024-01-{done:02d}", "updated_at": "2024-01-01", "parent_execution_log_id": 7}
    wf = table(spark, WF, [child(1, 1, 12), child(2, 5), child(3, 9), child(4, 20)])
    seals = spark.createDataFrame([(7, "2024-01-09")], "branch_id long, at string").select("branch_id", F.col("at").cast("timestamp_ntz").alias("sealed_at"))
    rows = polls.history(polls.snapshots(wf, seals, now_at("2024-01-17"), polls=3, every_days=7)).orderBy("poll")
    assert values(rows, "pending", "spawned") == [(1, None), (3, 3), (2, 3)]  # a child that isn't there yet is not pending
    growing = polls.history(polls.snapshots(wf, seals.where("false"), now_at("2024-01-17"), polls=3)).orderBy("poll")
    assert values(growing, "spawned") == [(None,)] * 3


def test_counts_of_a_growing_branch(spark):
    health = spark.createDataFrame([(7, 9, 4, 2, 1), (8, 9000, 6000, 1, 0), (9, 3, 1, 1, 0)], "branch_id long, spawned long, pending long, never_started long, blocked long")
    record = lambda k, **poll: (k, f"branch$b{k}", json.dumps({"poll": poll} if poll else {}))
    logs = spark.createDataFrame([record(7, pending=5, never_started=3, spawned=None), record(8, pending=6001, spawned=9000), record(9)], "id long, step_name string, metadata string")
    shown = polls.counts_shown(health, polls.recorded(logs)).orderBy("branch_id")
    assert values(shown, "spawned", "pending", "never_started", "blocked") == [(9, 5, 3, 1), (9000, 6001, 1, 0), (3, 1, 1, 0)]
    assert values(polls.counts_shown(health, polls.recorded(logs.limit(0))).orderBy("branch_id"), "spawned") == [(9,), (5000,), (3,)]


def test_recorded_polls(spark):
    poll = {"last_polled_at": "2024-01-01T02:00:00+02:00", "next_poll_at": "2024-01-01T00:01:00Z", "rate": 0.5, "pending": 10, "polls": 3}
    logs = table(spark, LOGS, [{"id": 1, "workflow_id": 1, "step_name": "branch$a", "state": 1, "metadata": json.dumps({"poll": poll})}, {"id": 2, "workflow_id": 1, "step_name": "branch$b", "state": 1, "metadata": json.dumps({"poll": poll | {"next_poll_at": None, "rate": 0.25, "pending": 5}})}, {"id": 3, "workflow_id": 1, "step_name": "merge$a,b", "state": 0}])
    seen = polls.recorded(logs)
    assert [(r.branch_id, str(r.polled_at), r.next_poll_at is None) for r in seen.orderBy("branch_id").collect()] == [(1, "2024-01-01 00:00:00", False), (2, "2024-01-01 00:00:00", True)]
    assert values(polls.overdue_branches(seen, now_at("2024-01-01 00:03:00")), "branch_id", "overdue") == [(1, False), (2, False)]
    assert values(polls.overdue_branches(seen, now_at("2024-01-01 00:03:01")), "branch_id", "overdue") == [(1, True), (2, False)]
    assert values(polls.merges(logs, seen, now_at("2024-01-01 00:00:30")), "id", "rate", "eta_seconds", "polls") == [(3, 0.75, 20, 3)]


def test_merge_rate_needs_all_branches_samples(spark):
    logs = table(spark, LOGS, [{"id": 1, "workflow_id": 1, "step_name": "branch$a"}, {"id": 2, "workflow_id": 1, "step_name": "branch$b"}, {"id": 3, "workflow_id": 1, "step_name": "merge$a,b"}])
    polled = spark.createDataFrame([(1, 0, "00:00:00", 10), (1, 1, "00:00:10", 6), (2, 1, "00:00:10", 30), (1, 2, "00:00:20", 7), (2, 2, "00:00:20", 9)], "branch_id long, poll int, at string, pending long").withColumn("polled_at", F.concat(F.lit("2024-01-01 "), "at").cast("timestamp_ntz"))
    assert values(polls.merge_drain(logs, polled).orderBy("poll"), "poll", "pending", "sampled", "rate", "eta_seconds") == [(0, 10, False, 0.0, None), (1, 36, False, 0.0, None), (2, 16, True, 2.0, 8)]


def test_tasks_without_a_period(spark):
    due = spark.createDataFrame([(1, "s", 0, 100), (1, "t", 60, 100)], "workflow_id long, step string, every long, first_tick long")
    now = now_at("1970-01-01 02:00:00")
    assert values(periodic.fast_forward(due, now), "step", "skipped") == [("s", 0), ("t", 59)]
    assert {r.step for r in periodic.grid_runs(due, table(spark, LOGS, []), now).collect()} == {"t"}


def test_starts_ends_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 3)
    rows = [{"id": k, "workflow_id": k, "step_name": "durably_repeat$s", "state": state, "started_at": "1970-01-01 00:00:10", "completed_at": done, "metadata": meta} for k, state, done, meta in ((1, 0, None, None), (2, 0, None, '{"last_execution_at":"1970-01-01T00:01:40Z"}'), (3, 1, "1970-01-01 00:00:35", None), (4, 0, None, None))]
    logs = table(spark, LOGS, rows)
    start = F.when(F.col("workflow_id") < 3, now_at("1970-01-01 00:00:05"))
    till = F.when(F.col("workflow_id") == 4, now_at("1970-01-01 00:00:50"))
    ticks = {}
    for r in periodic.grid_runs(periodic.tasks(logs, F.lit(20), start, till), logs, now_at("1970-01-01 00:02:25")).collect():
        ticks.setdefault(r.workflow_id, []).append(r.number)
    assert {k: sorted(v) for k, v in ticks.items()} == {1: [5, 25, 45, 65, 85, 105, 125, 145], 2: [120, 140], 3: [30], 4: [30, 50]}


def test_months_keep_the_shortest_day(spark):
    from datetime import date, timedelta

    def walk(start, today):
        tick, n = start, 0
        while tick < today:
            year, month = divmod(tick.year * 12 + tick.month, 12)
            last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(1)).day
            tick, n = date(year, month + 1, min(tick.day, last)), n + 1
        return str(tick), n

    today = date(2028, 3, 1)
    starts = [date(2021, 1, 1) + timedelta(k) for k in range(0, 2700, 11)] + [date(2024, 1, d) for d in (28, 29, 30, 31)] + [date(2027, 12, 31), date(2028, 2, 29), date(2028, 3, 1), date(2027, 7, 31)]
    found = periodic.calendar_grid(spark.createDataFrame([(k, s) for k, s in enumerate(starts)], "id long, start date"), now_at(f"{today} 10:00:00"))
    assert {r.id: (r.next_tick, r.ticks) for r in found.collect()} == {k: walk(s, today) for k, s in enumerate(starts)}


def test_policies_by_ancestor(spark):
    tree = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "StandardError"), ("StandardError", "Exception"), ("X", "Y"), ("Y", "X"), ("Fatal", "Exception"), (None, "Z"), ("M", "A"), ("M", "X")], "class string, parent string")
    reach = {(r["class"], r.ancestor) for r in policies.ancestors(tree).collect()}
    assert {a for c, a in reach if c == "A"} == {"A", "B", "C", "StandardError", "Exception"} and {a for c, a in reach if c == "X"} == {"X", "Y"} and ("M", "Y") in reach and ("M", "C") in reach
    rules = (policies.Policy("deep", 2, 1, 30, ("C",)), policies.Policy("cycle", 5, 1, 30, ("Y",)), policies.Policy("any", 3, 1, 30))
    errors = table(spark, ERRORS, [{"id": k, "workflow_id": 1, "error_class": c, "created_at": f"2024-01-01 00:00:{k:02d}"} for k, c in enumerate(("A", "X", "M", "B", "Fatal", "Unknown", None, "A"))])
    rows = policies.routed_by_class(errors, tree, rules).orderBy("id")
    assert values(rows, "policy", "used", "retries") == [("deep", 1, True), ("cycle", 1, True), ("deep", 2, False), ("deep", 3, False), (None, None, False), ("any", 1, True), (None, None, False), ("deep", 4, False)]


def test_loosest_and_resolved(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 7), ("b", 3), ("b", None)], "composite string, attempts int")
    assert sorted(values(policies.loosest(rows), "composite", "attempts")) == [("a", 7), ("b", None)]
    calls = spark.createDataFrame([(1, "J", "execute", "strict"), (2, "J", "execute", None), (3, "J", "wait", None), (4, "K", "execute", None), (5, "J", "wait", "strict")], "id long, job_class string, kind string, call string")
    found = policies.resolved(calls, {"J": policies.WORKFLOW}, policies.POLICIES).orderBy("id")
    assert values(found, "policy", "attempts") == [("strict", 1), ("workflow", 10), ("wait", None), ("step", 3), ("strict", 1)]


def test_overlapping_prefixes(spark):
    nodes = [overlay.Node("d1", "dynamic", prefix="wait$"), overlay.Node("d2", "dynamic", prefix="wait$a"), overlay.Node("d3", "dynamic", prefix="wait$"), overlay.Node("s", "sleep", "wait$b"), overlay.Node("none", "dynamic")]
    log = lambda k, w, name, state=1: {"id": k, "workflow_id": w, "step_name": name, "state": state}
    logs = table(spark, LOGS, [log(1, 1, "wait$b"), log(2, 1, "wait$ax"), log(3, 1, "wait$ay", 0), log(4, 1, "wait$c", 2), log(5, 1, "wait$d"), log(6, 1, "durably_repeat$x$1"), log(7, 2, "wait$c"), log(8, 2, "wait$a")])
    health = spark.createDataFrame([], "branch_id long, status string")
    found = {(r.workflow_id, r.node): (r.log_id, r.status) for r in overlay.overlay(nodes, logs, health).collect()}
    assert found == {
        (1, "s"): (1, "done"), (1, "d1"): (2, "done"), (1, "d2"): (3, "active"), (1, "d3"): (4, "failed"), (1, "log-5"): (5, "unmapped"), (1, "none"): (None, "not_reached"),
        (2, "s"): (None, "not_reached"), (2, "d1"): (7, "done"), (2, "d2"): (8, "done"), (2, "d3"): (None, "not_reached"), (2, "none"): (None, "not_reached"),
    }


def test_hot_branch_counts(spark):
    """One branch has nearly all children: they are counted before they move, and ranked ones are cut before they move."""
    wf = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, 2).otherwise(0).alias("state"), F.when(F.col("id") % 100 == 0, 9).otherwise(7).cast("long").alias("parent_execution_log_id"), *(F.lit(None).cast("timestamp_ntz").alias(c) for c in ("started_at", "completed_at")), now_at("2024-01-01").alias("updated_at"))
    logs = table(spark, LOGS, [{"id": k, "workflow_id": 1, "step_name": f"branch$b{k}", "state": 1} for k in (7, 8, 9)])
    found = {r.branch_id: (r.spawned, r.status, r.done) for r in branches.branch_health(wf, logs).collect()}
    assert found == {7: (198_000, "active", False), 8: (0, "not_reached", True), 9: (2_000, "active", False)}
    first = branches.rekick_candidates(wf, logs, now_at("2024-01-02"), most=5)
    assert first.groupBy("branch_id").count().orderBy("branch_id").collect() == [(7, 5), (9, 5)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stats_stop_at_the_cap(spark):
    wf = spark.range(1000).select((F.col("id") % 3).cast("int").alias("state"))
    assert sorted(values(fleet.state_stats(wf, 50), "state", "capped", "shown")) == [("completed", 50, "50+"), ("failed", 0, "0"), ("idle", 50, "50+"), ("running", 50, "50+"), ("stalled", 0, "0")]


def test_intervals_of_marks_in_any_order(spark):
    rows = [("2024-01-01 00:00:30", "failed", 9), ("2024-01-01 00:00:00", "idle", 0), ("2024-01-01 00:01:00", "running", 8), ("2024-01-01 00:00:10", "running", 0), ("2024-01-01 00:00:40", "idle", 4), ("2024-01-01 00:02:00", "completed", 7), ("2024-01-01 00:03:00", "running", 6), ("2024-01-02 00:00:00", "idle", 5)]
    marks = spark.createDataFrame([(1, *r) for r in rows], "workflow_id long, t string, state string, source long").select("workflow_id", F.col("t").cast("timestamp_ntz").alias("at"), "state", "source")
    found = lifecycle.intervals(marks.repartition(3), now_at("2024-01-01 00:05:00"))
    assert values(found.orderBy("place"), "state", "seconds", "legal") == [("idle", 10.0, True), ("running", 20.0, True), ("failed", 10.0, True), ("idle", 20.0, True), ("running", 60.0, True), ("completed", 60.0, True), ("running", 120.0, False)]
    assert values(lifecycle.illegal_transitions(found), "place", "before", "state") == [(7, "completed", "running")]


def test_lock_sessions_and_overlaps(spark):
    touch = [(1, "a", "00:00:00"), (1, "a", "00:09:59"), (1, "a", "00:19:59"), (1, "b", "00:19:00"), (1, "a", "01:00:00"), (2, "b", "00:00:00"), (1, None, "00:00:00")]
    d = spark.createDataFrame(touch, "workflow_id long, owner string, t string").select("workflow_id", "owner", F.concat(F.lit("2024-01-01 "), "t").cast("timestamp_ntz").alias("at"))
    sessions = lifecycle.lock_sessions(d)
    assert sorted((r.workflow_id, r.owner, str(r.since)[11:], str(r.until)[11:], r.touches) for r in sessions.collect()) == [(1, "a", "00:00:00", "00:29:59", 3), (1, "a", "01:00:00", "01:10:00", 1), (1, "b", "00:19:00", "00:29:00", 1), (2, "b", "00:00:00", "00:10:00", 1)]
    assert sorted((r.first, r.second, str(r.since)[11:], str(r.until)[11:]) for r in lifecycle.lock_overlaps(sessions).collect()) == [("a", "b", "00:19:00", "00:29:00")]


def test_graph_documents(spark):
    nodes = spark.createDataFrame([("d", 0, "n1", "One", "branch", "branch$a"), ("d", 1, "n2", 'Tw"o', "dynamic", None), ("e", 0, "only", "Only", "execute", "x")], "definition string, place long, node string, label string, kind string, step_name string")
    edges = spark.createDataFrame([("d", 0, "start", "n1", "sequence", None), ("d", 1, "n1", "halt", "guard", "bad?"), ("d", 2, "n2", "start", "loop", None)], "definition string, place long, source string, target string, kind string, guard string")
    found = spark.createDataFrame([("d", 5, "n2", "active", None, None, 3, "wait$q"), ("d", 5, "n1", "failed", None, '{"failed":2}', 2, "branch$a"), ("d", 5, "log-9", "unmapped", None, None, 9, "z"), ("d", 6, "n1", "done", 4, None, 1, "branch$a")], "definition string, workflow_id long, node string, status string, repetitions long, counts string, log_id long, log_name string")
    runs = {r.workflow_id: json.loads(r.document) for r in graphs.documents(nodes, edges, found).collect()}
    assert [(x["data"]["id"], x["classes"]) for x in runs[5]["nodes"]] == [("n1", "kind-branch status-failed"), ("n2", "kind-dynamic status-active"), ("log-9", "kind-unmapped status-unmapped"), ("start", "kind-endpoint"), ("halt", "kind-endpoint")]
    assert runs[5]["nodes"][0]["data"] == {"id": "n1", "label": "One", "step_name": "branch$a", "counts": {"failed": 2}} and runs[6]["nodes"][0]["data"]["repetitions"] == 4
    assert runs[5]["edges"][1] == {"data": {"id": "e1", "source": "n1", "target": "halt", "label": "bad?"}, "classes": "kind-guard"}
    plain = {r.definition: json.loads(r.document) for r in graphs.documents(nodes, edges).collect()}
    assert plain["e"] == {"nodes": [{"data": {"id": "only", "label": "Only", "step_name": "x"}, "classes": "kind-execute status-not_reached"}], "edges": []} and plain["d"]["nodes"][1]["data"]["label"] == 'Tw"o'


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_deletion_rewrites_only_what_changes(spark, tmp_path):
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    row = lambda k, m, state=0, parent=None: {"id": k, "key": f"k{k}", "state": state, "created_at": f"2024-{m:02d}-05", "completed_at": f"2024-{m:02d}-06" if state == 2 else None, "updated_at": f"2024-{m:02d}-06", "parent_execution_log_id": parent}
    wf = table(spark, WF, [row(1, 1, 2), row(2, 2), row(3, 2, 0, 100), row(4, 3), row(5, 4, 0, 101), row(6, 5, 2)])
    logs = table(spark, LOGS, [{"id": k, "workflow_id": w, "step_name": "branch$x", "started_at": f"2024-{m:02d}-05"} for k, w, m in ((100, 1, 1), (101, 2, 2), (102, 4, 3), (103, 1, 3))])
    errors = table(spark, ERRORS, [{"id": k, "workflow_id": w, "created_at": f"2024-{m:02d}-05"} for k, w, m in ((1, 1, 1), (2, 4, 3))])
    for name, df, at in (("workflows", wf, "created_at"), ("execution_logs", logs, "started_at"), ("error_logs", errors, "created_at")):
        df.select("*", month(at)).write.partitionBy("month").parquet(f"{tmp_path}/{name}")
    before = files(tmp_path)
    gone = lambda d: branches.expired(d, now_at("2024-04-30"), 60, 60)
    want_kept = branches.survivors(wf, now_at("2024-04-30"), 60, 60)
    expired = lambda d: (F.col("state") == 2) & (F.col("completed_at") <= now_at("2024-03-01"))
    assert {r.id for r in gone(wf).collect()} == {1}
    with shared.released(spark):
        assert tables.delete_expired(spark, str(tmp_path), expired) == {"workflows": 1, "execution_logs": 2, "error_logs": 1, "orphaned_children": 1}
        assert tables.delete_expired(spark, str(tmp_path), expired) == {"workflows": 0, "execution_logs": 0, "error_logs": 0, "orphaned_children": 0}
    spark.catalog.clearCache()
    left = spark.read.schema(f"{hi.SCHEMAS['workflows']}, month string").parquet(f"{tmp_path}/workflows")
    assert sorted(values(left, "id", "parent_execution_log_id", "month")) == [(2, None, "2024-02"), (3, None, "2024-02"), (4, None, "2024-03"), (5, 101, "2024-04"), (6, None, "2024-05")]
    assert {r.id for r in left.collect()} == {r.id for r in want_kept.collect()}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/execution_logs").collect()) == [101, 102]
    after = files(tmp_path)
    same = {f for f in before if any(f.startswith(p) for p in ("workflows/month=2024-03", "workflows/month=2024-04", "workflows/month=2024-05", "execution_logs/month=2024-02", "error_logs/month=2024-03"))}
    assert len(same) >= 5 and same <= after and not {f for f in after if "month=2024-01" in f}
    assert not (before - same) & after


def test_saved_tables_are_removed(spark):
    kept = shared.saved(spark.range(3), "kept")
    with pytest.raises(ZeroDivisionError), shared.released(spark):
        inner = shared.saved(spark.range(5), "inner")
        assert inner.count() == 5
        raise ZeroDivisionError
    folders = {f.replace("file:", "") for f in inner.inputFiles() + kept.inputFiles()}
    assert [os.path.exists(f) for f in sorted(folders, key=lambda f: "kept" in f)].count(True) == len(kept.inputFiles())
    shared.release(spark)
    assert not any(os.path.exists(f) for f in folders)


@pytest.mark.parametrize("source", ["parquet", "orc", "json", "csv"])
def test_formats_of_history(spark, tmp_path, source):
    wf = table(spark, WF, [{"id": 1, "key": 'a "quoted", key', "state": 2, "created_at": "2024-01-01 00:00:00.25", "job_class": "J"}, {"id": 2, "key": None, "state": None}])
    logs = table(spark, LOGS, [{"id": 7, "workflow_id": 1, "step_name": "wait$a", "metadata": '{"wait_until":"2024-01-01T00:00:00Z","n":"x\\ny"}'}])
    errors = table(spark, ERRORS, [])
    for name, df in (("workflows", wf.drop("locked_by", "updated_at").select("state", *(c for c in wf.columns if c not in ("state", "locked_by", "updated_at")))), ("execution_logs", logs), ("error_logs", errors)):
        writer = df.write.format(source)
        (writer.option("header", True).option("escape", '"') if source == "csv" else writer).save(f"{tmp_path}/{name}.{source}")
    found = hi.load(spark, str(tmp_path), source)
    assert [str(f.dataType) for f in found.workflows.schema] == [str(f.dataType) for f in wf.schema]
    assert found.workflows.orderBy("id").collect() == wf.withColumns({c: F.lit(None) for c in ("locked_by", "updated_at")}).orderBy("id").collect()
    assert found.logs.collect() == logs.collect() and found.errors.count() == 0
    with pytest.raises(ValueError, match="not from xml"):
        hi.load(spark, str(tmp_path), "xml")
