"""Golden values of the history operators on small tables."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import steps as fs
from runlens.functions.steps import now_at
from runlens.operators import branches, contexts, fleet, overlay, periodic, policies, polls, tables
from runlens.operators import steps as st
from runlens.plans import queries

NOW = "2024-01-31 12:00:00"
LOGS = "id long, workflow_id long, step_name string, attempts int, started_at timestamp_ntz, completed_at timestamp_ntz, state int, error_class string, metadata string"
WF = "id long, key string, job_class string, state int, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, updated_at timestamp_ntz, locked_at timestamp_ntz, locked_by string, parent_execution_log_id long"


def table(spark, schema, rows):
    """Rows as dictionaries; times as text."""
    kinds = [c.split() for c in schema.split(", ")]
    plain = ", ".join(f"{name} {'string' if kind.startswith('timestamp') else kind}" for name, kind in kinds)
    df = spark.createDataFrame([tuple(r.get(name) for name, _ in kinds) for r in rows], plain)
    return df.select(*(F.col(name).cast(kind) for name, kind in kinds))


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def shown(spark, column, given):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x double")
    return [r[0] for r in df.orderBy("k").select(column(F.col("x"))).collect()]


def test_texts(spark):
    assert shown(spark, fs.percent, [None, 0.0, 0.000008, 0.005, 0.0051, 0.5, 1.0, 0.375]) == ["—", "0%", "<0.01%", "0.5%", "0.51%", "50%", "100%", "38%"]
    assert shown(spark, fs.trend_arrow, [0.0, 2.0, -1.0]) == ["—", "▲", "▼"]
    assert shown(spark, fs.trend_points, [0.0, 2.0, -12.5]) == ["flat", "+2.0", "−12.5"]
    assert shown(spark, lambda x: fs.duration_steps(x, F.lit(400.0)), [None, -1.0, 0.0, 1.0, 100.0, 400.0, 900.0]) == [0, 0, 0, 5, 50, 100, 100]
    assert shown(spark, lambda x: fs.bar_steps(x, F.lit(10.0)), [0.0, 1.3, 5.0, 10.0]) == [0, 15, 50, 100] and shown(spark, lambda x: fs.bar_steps(x, F.lit(0.0)), [3.0]) == [0]
    notes = spark.createDataFrame([("execute", 1), ("execute", 3), ("wait", 4), ("repeat_coordination", 9)], "kind string, n int")
    assert [r[0] for r in notes.select(fs.attempts_note(F.col("kind"), F.col("n"))).collect()] == [None, "3 attempts", "checked 4×", None]
    states = spark.createDataFrame([(s,) for s in ("completed", "odd", "idle", "running")], "s string")
    assert [r.s for r in states.orderBy(fs.state_place(F.col("s"))).collect()] == ["running", "idle", "completed", "odd"]
    names = spark.createDataFrame([("$workflow_completion$",), ("a$b$c",), ("wait$a",)], "s string")
    assert [r[0] for r in names.select(fs.framework_step(F.col("s"))).collect()] == [True, True, False]


def test_latencies_are_durations(spark):
    run = lambda k, begin, end, state=1: {"id": k, "workflow_id": 1, "step_name": f"durably_repeat$sync${k}", "state": state, "started_at": f"2024-01-01 00:{begin}", "completed_at": end and f"2024-01-01 00:{end}"}
    logs = table(spark, LOGS, [run(1, "00:00", "00:10"), run(2, "10:00", "10:20"), run(3, "20:00", "20:33.9"), run(4, "30:00", None), run(5, "40:00", "41:00", 2)])
    assert values(st.recent_latencies(logs), "step", "runs", "last_latency", "shown") == [("sync", 3, 33, "avg 21s · last 33s")]
    assert values(st.recent_latencies(logs, 2), "runs", "mean_latency") == [(2, 26.5)]


def test_missed_ticks_and_next_run(spark):
    rows = [{"id": 1, "step_name": "durably_repeat$sync", "state": 0, "metadata": '{"last_execution_at":"2024-01-01T05:00:00Z"}'}]
    rows += [{"id": 2, "step_name": "durably_repeat$sync$100", "state": 2, "error_class": "TimeoutError", "metadata": '{"fast_forwarded":30}'}, {"id": 3, "step_name": "durably_repeat$sync$200", "state": 2, "error_class": "TimeoutError"}]
    rows += [{"id": 4, "step_name": "durably_repeat$sync$300", "state": 0}, {"id": 5, "step_name": "durably_repeat$other$900", "state": 0}]
    assert values(st.periodic_health(table(spark, LOGS, [{"workflow_id": 1} | r for r in rows])), "step", "missed_ticks", "next_due") == [("sync", 31, 300)]


def test_cadence(spark):
    cases = [(800, 20.0, 1, 0, None, 20), (100_000, 0.1, 1, 0, None, 300), (1, 1000.0, 1, 0, None, 5), (1, 0.0, 1, 0, None, 5), (1, 0.0, 1, 0, 200, 5), (100, 0.0, 0, 1, None, 5), (100, 0.0, 0, 1, 5, 10), (100, 0.0, 0, 1, 200, 300), (100, 0.0, 0, 0, None, 300), (100, 0.0, 0, 0, 200, 300)]
    df = spark.createDataFrame([tuple(None if x is None else float(x) for x in c) for c in cases], "pending double, rate double, running double, never double, before double, want double")
    got = df.select(polls.reschedule(F.col("pending"), F.col("rate"), F.col("running"), F.col("never"), F.col("before")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_intervals_double_while_nothing_starts(spark):
    seen = [(1, 0, 9, 9), (1, 1, 9, 9), (1, 2, 9, 9), (1, 3, 5, 5), (1, 4, 5, 5), (1, 5, 5, 5), (2, 0, 3, 0), (2, 1, 3, 1), (2, 2, 3, 0)]
    rows = spark.createDataFrame([(b, p, n, 9, 0, never, 4, f"2024-01-01 00:{p:02d}:00") for b, p, n, never in seen], "branch_id long, poll int, pending long, spawned long, running long, never_started long, stale long, t string")
    got = polls.history(rows.withColumns({"polled_at": F.col("t").cast("timestamp_ntz"), "sealed": F.lit(True)}).drop("t")).orderBy("branch_id", "poll")
    # 4 children drain within a minute: 5 are left at 1/15 a second.
    assert [r.interval for r in got.collect()] == [5, 10, 20, 37.5, 75, 150, 300, 300, 300]
    assert [r.rekicked for r in got.collect()] == [4, 4, 4, 0, 4, 4, 4, 4, 0]  # not where the number never started fell
    assert [r.rekick_total for r in got.collect()][:6] == [4, 8, 12, 12, 16, 20] and got.collect()[3].eta_seconds == 75


def test_merges_sum_their_branches(spark):
    logs = table(spark, LOGS, [{"id": k, "workflow_id": 1, "step_name": s, "state": state, "started_at": at} for k, s, state, at in ((1, "branch$a", 1, None), (2, "branch$b", 1, None), (3, "merge$a,b", 0, "2024-01-02 00:00:00"), (4, "merge$a", 1, "2024-01-01 00:00:00"), (5, "branch$c", 1, None), (6, "merge$c", 0, None))])
    polled = [(1, 0, 19_000, 226.0, 3, "2024-01-31 11:00:00", "2024-01-31 11:30:00"), (2, 0, 888, 0.0, 2, "2024-01-31 11:59:00", "2024-01-31 12:05:00"), (5, 0, 7, 0.0, 1, "2024-01-31 11:00:00", "2024-01-31 11:59:59")]
    polled = spark.createDataFrame(polled, "branch_id long, poll int, pending long, rate double, polls long, p string, n string").select("*", F.col("p").cast("timestamp_ntz").alias("polled_at"), F.col("n").cast("timestamp_ntz").alias("next_poll_at")).drop("p", "n")
    got = values(polls.merges(logs, polled, now_at(NOW)).orderBy("place"), "id", "names", "state", "rate", "eta_seconds", "polls", "overdue")
    assert got == [(3, "a,b", "merging", 226.0, 88, 2, False), (6, "c", "merging", 0.0, None, 1, True), (4, "a", "merged", 226.0, 84, 3, False)]
    assert sorted(values(polls.overdue_branches(polled, now_at(NOW)), "branch_id", "overdue")) == [(1, True), (2, False), (5, False)]  # one second past is within the grace


def test_fenced_polls(spark):
    tokens = spark.createDataFrame([(1, "a", 0), (1, "b", 5), (2, "a", 0)], "branch_id long, token string, rotated_at int")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "branch_id long, token string")
    assert sorted(values(polls.fenced(rows, tokens), "branch_id", "token")) == [(1, "b"), (2, "a")]


def test_stranded(spark):
    rows = [{"id": 1, "state": 1, "locked_at": "2024-01-31 11:20:00"}, {"id": 2, "state": 1, "locked_at": "2024-01-31 11:59:00"}, {"id": 3, "state": 3, "locked_at": "2024-01-31 01:00:00"}, {"id": 4, "state": 1}, {"id": 5, "state": 1, "locked_at": "2024-01-31 11:00:00"}]
    wf = table(spark, WF, rows)
    assert values(fleet.stranded_page(wf, now_at(NOW)).orderBy("place"), "id", "place", "capped") == [(5, 1, False), (1, 2, False)]
    assert values(fleet.stranded_page(wf, now_at(NOW), cap=1), "id", "capped") == [(5, True)]
    assert values(tables.contended(wf, now_at(NOW)), "id") == [(2,)]


def test_idle_cap_comes_before_waits(spark):
    wf = table(spark, WF, [{"id": k, "state": 0, "job_class": "A"} for k in (1, 2, 3)])
    logs = table(spark, LOGS, [{"id": k, "workflow_id": w, "step_name": "continue_if$x", "state": 0, "started_at": f"2024-01-0{w} 00:00:00"} for k, w in ((10, 2), (11, 3))])
    assert values(st.oldest_idle_waits(wf, logs, now_at(NOW), cap=2), "workflow_id", "capped") == [(2, True)]
    assert values(st.oldest_idle_waits(wf, logs, now_at(NOW)).orderBy("place"), "workflow_id", "capped") == [(2, False), (3, False)]


def test_waits_are_looked_at_before_their_timeout(spark):
    rows = [(1, "wait_until$a", "2024-01-31T11:00:00Z"), (2, "wait_until$b", "2024-01-31T11:00:00Z"), (3, "wait_until$c", "2024-01-31T12:00:00Z"), (4, "wait_until$d", "no time"), (5, "continue_if$e", "2024-01-31T11:00:00Z"), (6, "continue_if$f", None)]
    logs = table(spark, LOGS, [{"id": k, "workflow_id": k, "step_name": s, "state": 0, "metadata": t and f'{{"timeout_at":"{t}"}}'} for k, s, t in rows])
    got = {r.id: (r.outcome, r.stalls) for r in st.evaluated_waits(logs, now_at(NOW), F.col("id").isin(1, 6)).collect()}
    assert got == {1: ("met", False), 2: ("timed_out", True), 3: ("waiting", False), 4: ("waiting", False), 5: ("waiting", False), 6: ("met", False)}


def test_sleeps_end_at_their_time(spark):
    logs = table(spark, LOGS, [{"id": k, "workflow_id": k, "step_name": f"wait$w{k}", "state": 0, "metadata": f'{{"wait_until":"2024-01-31T{t}Z"}}'} for k, t in ((1, "12:00:00"), (2, "12:00:01"), (3, "x"))])
    assert sorted(values(st.sleeps(logs, now_at(NOW)), "id", "done", "left")) == [(1, True, None), (2, False, 1), (3, False, None)]


def test_repetition_meters(spark):
    run = lambda k, at, begin, end: {"id": k, "step_name": f"durably_repeat$s${at}", "started_at": f"1970-01-01 00:{begin}", "completed_at": end and f"1970-01-01 00:{end}"}
    page = table(spark, LOGS, [run(1, 0, "02:00", "02:04"), run(2, 60, "01:00", "01:16"), run(3, 60, "00:30", None)])
    got = sorted(values(st.repetition_meters(page), "id", "late", "late_bar", "took", "took_bar"))
    assert got == [(1, "2m 00s", 100, "4s", 50), (2, "on time", 0, "16s", 100), (3, "on time", 0, None, 0)]


def test_failure_markers(spark):
    errors = spark.createDataFrame([(7, 1, "Boom", 1), (8, 2, "Other", 1)], "id long, workflow_id long, error_class string, attempt int")
    logs = table(spark, LOGS, [{"id": k, "workflow_id": 1, "step_name": s, "state": 2} for k, s in ((1, "$workflow_failure$7"), (2, "$workflow_failure$8"), (3, "$workflow_failure$x"), (4, "$workflow_retry$7"))])
    assert sorted(values(st.failure_markers(logs, errors), "id", "error_class", "missing_error_id")) == [(1, "Boom", None), (2, None, 8)]


def test_monthly_grid(spark):
    starts = spark.sql("SELECT 1L AS id, DATE '2026-01-31' AS start UNION ALL SELECT 2L, DATE '2026-05-15' UNION ALL SELECT 3L, DATE '2026-07-01' UNION ALL SELECT 4L, DATE '2001-01-31'")
    got = {r.id: (r.next_tick, r.ticks) for r in periodic.calendar_grid(starts, now_at("2026-05-15 00:00:00")).collect()}
    assert got == {1: ("2026-05-28", 4), 2: ("2026-05-15", 0), 3: ("2026-07-01", 0), 4: ("2026-05-28", 304)}


def test_fixed_grids_and_runs(spark):
    rows = [{"id": 1, "step_name": "durably_repeat$s", "state": 0, "started_at": "2024-01-01 00:00:00"}, {"id": 2, "step_name": "durably_repeat$s$1704070800", "state": 1}, {"id": 3, "step_name": "durably_repeat$sX$1704074400", "state": 1}, {"id": 4, "step_name": "durably_repeat$s$1704081600", "state": 0}]
    logs = table(spark, LOGS, [{"workflow_id": 1} | r for r in rows])
    due = periodic.tasks(logs, F.lit(3600))
    got = values(periodic.grid_runs(due, logs, now_at("2024-01-01 04:30:00")).orderBy("number"), "number", "run_id", "status")
    assert got == [(1704070800, 2, "completed"), (1704074400, None, "missed"), (1704078000, None, "missed"), (1704081600, 4, "pending")]
    # A tick that lies at the limit itself has not expired.
    assert values(periodic.fast_forward(due, now_at("2024-01-01 03:00:00")), "skipped", "next_at") == [(1, "2024-01-01 02:00:00")]
    assert values(periodic.fast_forward(due, now_at("2024-01-01 03:00:01")), "skipped", "next_at") == [(2, "2024-01-01 03:00:00")]
    for at, outcome in (("03:59:59", "scheduled"), ("04:00:00", "due"), ("05:00:00", "due"), ("05:00:01", "timed_out")):
        assert values(periodic.run_timeouts(logs, now_at(f"2024-01-01 {at}")), "id", "outcome") == [(4, outcome)]


def test_failed_runs(spark):
    logs = table(spark, LOGS, [{"id": k, "workflow_id": 1, "step_name": "durably_repeat$s$0", "state": 2, "error_class": e} for k, e in ((1, "TimeoutError"), (2, "Boom"), (3, None))])
    assert sorted(values(periodic.failed_runs(logs, F.lit(60), F.lit(periodic.FAIL_WORKFLOW)), "id", "follows", "next_at"), key=str) == [(1, "continue", "1970-01-01 00:01:00"), (2, "fail_workflow", None), (3, "fail_workflow", None)]
    assert {r.follows for r in periodic.failed_runs(logs, F.lit(60), F.lit(periodic.CONTINUE)).collect()} == {"continue"}


def test_pruning_frontier(spark):
    rows = [{"id": 1, "step_name": "durably_repeat$s", "state": 0, "metadata": '{"last_execution_at":"2024-01-01T05:00:00Z"}'}, {"id": 9, "step_name": "durably_repeat$t", "state": 0}]
    rows += [{"id": k, "step_name": f"durably_repeat${s}${1704067200 + h * 3600}", "state": state} for k, s, h, state in ((2, "s", 4, 1), (3, "s", 5, 1), (4, "s", 6, 1), (5, "s", 3, 0), (6, "t", 1, 1), (7, "s", 2, 2))]
    assert sorted(values(st.prunable_repetitions(table(spark, LOGS, [{"workflow_id": 1} | r for r in rows]), now_at(NOW)), "id")) == [(2,), (7,)]


def test_cleanup_counts(spark):
    wf = table(spark, WF, [{"id": 1, "state": 2, "completed_at": "2023-01-01 00:00:00"}, {"id": 2, "state": 0, "parent_execution_log_id": 10}, {"id": 3, "state": 3, "updated_at": NOW}])
    logs = table(spark, LOGS, [{"id": k, "workflow_id": w, "step_name": "x", "state": 1} for k, w in ((10, 1), (11, 1), (12, 2))])
    errors = spark.createDataFrame([(1, 1), (2, 3)], "id long, workflow_id long")
    got = dict(values(branches.cleanup_counts(wf, logs, errors, logs.select("id").where("id > 10"), now_at(NOW), 30, 30), "category", "rows"))
    assert got == {"workflows": 1, "execution_logs": 2, "error_logs": 1, "repetition_logs": 1, "orphaned_children": 1}


def test_policies(spark):
    errors = spark.createDataFrame([(k, 1, c, k, k) for k, c in enumerate(["A", "B", "A", None, "A", "C"])], "id long, workflow_id long, error_class string, attempt int, created_at int")
    chain = (policies.Policy("first", 2, 1, 30, ("B", "A")), policies.Policy("rest", None, 1, 2))
    got = values(policies.routed(errors, chain).orderBy("id"), "policy", "budget_key", "used", "retries", "backoff_max")
    assert got == [("first", "A,B", 1, True, 1.0), ("first", "A,B", 2, False, None), ("first", "A,B", 3, False, None), ("rest", "*", 1, True, 1.0), ("first", "A,B", 4, False, None), ("rest", "*", 2, True, 2.0)]
    assert values(policies.routed(errors, chain[:1]).where("policy is null").orderBy("id"), "id", "used", "retries") == [(3, None, False), (5, None, False)]
    assert policies.most_attempts(chain) is None and policies.most_attempts((policies.STEP, policies.WORKFLOW)) == 10
    assert policies.resolve() == policies.STEP and policies.resolve(own=chain[0]) == chain[0] and policies.resolve(own=chain[0], wait=True) == policies.WAIT and policies.resolve(chain[1], chain[0], True) == chain[1]
    assert {r.retries for r in policies.backoff_bounds(errors, policies.WAIT).collect()} == {False}
    assert [r.backoff_max for r in policies.backoff_bounds(errors).orderBy("attempt").collect()] == [1, 1, 2, 4, 8, 16]


def test_overlay(spark):
    nodes = [overlay.Node("a", "execute", "durably_execute$a"), overlay.Node("r", "repeat", "durably_repeat$sync_job"), overlay.Node("b", "branch", "branch$x"), overlay.Node("d1", "dynamic", None, "durably_execute$"), overlay.Node("d2", "dynamic", None, "durably_execute$")]
    names = [(1, "durably_execute$a", 1), (2, "durably_execute$q", 2), (3, "durably_repeat$sync_job", 0), (4, "durably_repeat$sync_job$5", 1), (5, "durably_repeat$syncXjob$5", 1), (6, "wait$w", 1), (7, "wait$v", 0), (8, "$workflow_completion$", 1), (9, "branch$x", 1)]
    logs = table(spark, LOGS, [{"id": k, "workflow_id": 1, "step_name": s, "state": state} for k, s, state in names])
    health = spark.createDataFrame([(9, "active")], "branch_id long, status string")
    got = {r.node: (r.log_id, r.status, r.repetitions) for r in overlay.overlay(nodes, logs, health).collect()}
    bare = {r.node: r.status for r in overlay.overlay([], logs, health).collect()}
    assert bare == {f"log-{k}": "unmapped" for k in (1, 6, 9)}
    assert got == {"a": (1, "done", None), "r": (3, "active", 1), "b": (9, "active", None), "d1": (2, "failed", None), "d2": (None, "not_reached", None), "log-6": (6, "unmapped", None)}


def test_overlay_names_its_logs(spark):
    nodes = [overlay.Node("b", "branch", "branch$x"), overlay.Node("a", "execute", "durably_execute$a"), overlay.Node("d", "dynamic", None, "branch$"), overlay.Node("u", "dynamic")]
    logs = [(1, 1, "branch$x", 1, "one"), (2, 1, "branch$y", 1, "two"), (3, 1, "branch$z", 1, "three"), (4, 1, "wait$w", 1, None), (5, 2, "wait$w", 0, None)]
    logs = spark.createDataFrame(logs, "id long, workflow_id long, step_name string, state int, counts string")
    health = spark.createDataFrame([(1, "active")], "branch_id long, status string")
    got = {(r.workflow_id, r.node): (r.log_id, r.log_name, r.counts) for r in overlay.named_overlay(nodes, logs, health).collect()}
    none = (None, None, None)
    assert got == {(1, "b"): (1, "branch$x", "one"), (1, "a"): none, (1, "d"): (2, "branch$y", "two"), (1, "u"): none, (1, "log-3"): (3, "branch$z", "three"), (1, "log-4"): (4, "wait$w", None)} | {(2, n): none for n in "baud"}


def test_run_graphs_derive_logs_once(spark):
    plan = queries.queries()["run_graphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "counts" in plan


def test_contexts(spark):
    text = '{"b":"é","a":1,"c":{"x":[1,2.5]},"d":null,"e":true,"f":1.5}'
    df = spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "id long, context string")
    got = values(contexts.nodes(df).orderBy("place"), "key", "value", "type", "bytes")
    assert got == [("b", '"é"', "string", 4), ("a", "1", "integer", 1), ("c", '{"x":[1,2.5]}', "object", 13), ("d", "null", "null", 4), ("e", "true", "boolean", 4), ("f", "1.5", "float", 3)]
    assert values(contexts.sizes(df).orderBy("id"), "id", "keys", "bytes") == [(1, 6, len(text.encode())), (2, 0, 2), (3, 0, 2)]
    assert values(contexts.within_budget(df, 6).orderBy("place"), "key", "kept") == [("b", True), ("a", True), ("c", False), ("d", False), ("e", False), ("f", False)]
    big = spark.createDataFrame([(1, '{"s":"' + "x" * 16383 + '","t":"y"}')], "id long, context string")
    assert values(contexts.nodes(big), "key", "valid") == [("s", False), ("t", True)]
    bag = spark.sql("SELECT map('k', CAST(NULL AS STRING), 'a', 'b') AS c")
    more = F.create_map(F.lit("a"), F.lit("z"), F.lit("n"), F.lit("m"))
    row = bag.select(contexts.fetch(F.col("c"), "k", F.lit("d")), contexts.fetch(F.col("c"), "q", F.lit("d")), contexts.merge(F.col("c"), more), contexts.merge_once(F.col("c"), more)).first()
    assert tuple(row) == (None, "d", {"k": None, "a": "z", "n": "m"}, {"k": None, "a": "b", "n": "m"})


def test_writing_once(spark):
    old = spark.createDataFrame([("A", "k1", 1)], "job_class string, key string, x int")
    new = spark.createDataFrame([("A", "k1", 9), ("A", "k2", 3), ("A", "k2", 2), ("B", "k1", 4)], "job_class string, key string, x int")
    added = tables.insert_missing(old, new, ["job_class", "key"])
    assert sorted(values(added, "job_class", "key", "x")) == [("A", "k2", 2), ("B", "k1", 4)]
    assert tables.insert_missing(old.unionByName(added), new, ["job_class", "key"]).count() == 0
    changes = spark.createDataFrame([("A", "k1", 1), ("A", "k3", 7)], "job_class string, key string, x int").withColumn("t", F.lit(5))
    assert sorted(values(tables.upsert(old.withColumn("t", F.lit(6)), changes, ["key"], ["t"]), "key", "x", "t")) == [("k1", 1, 6), ("k3", 7, 5)]


@pytest.mark.parametrize("done", [0, 1, 37, 200])
def test_resuming(spark, done):
    rows = spark.range(100).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    got = {r.id: r.n for r in tables.after_count(rows, ["a", "id"], done).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((i % 7, i) for i in range(100))) if n >= done}
    assert sorted(r.id for r in tables.after_key(rows, "id", 98).collect()) == [98, 99]


def test_late_deliveries_over_several_batches(spark, tmp_path):
    from runlens.streaming.jobs import first_events

    times = [["2024-01-10 00:00:00", "2024-01-10 00:00:00"], ["2024-01-10 00:00:00", "2024-01-12 00:00:00"], ["2024-01-10 00:00:00", "2024-01-10 12:00:00", "2024-01-11 12:00:00"]]
    for k, batch in enumerate(times):
        spark.createDataFrame([(1, "x", t) for t in batch], "user_id long, event_type string, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f={k}"))
        events = spark.readStream.schema("user_id long, event_type string, t string, f int").parquet(str(tmp_path / "in")).withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", "1 day")
        first_events(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(str(r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # Repeated deliveries come through once; of the last batch, what lies more than a day behind is dropped.
    assert got == ["2024-01-10 00:00:00", "2024-01-11 12:00:00", "2024-01-12 00:00:00"]


def test_loading_history(spark, tmp_path):
    from runlens.sources.history import derive, load

    h = derive(spark, "/root/testdata/sf0.001")
    for name, df in (("workflows", h.workflows), ("execution_logs", h.logs), ("error_logs", h.errors)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    again = load(spark, str(tmp_path))
    assert again.workflows.columns == h.workflows.columns and again.logs.exceptAll(h.logs).isEmpty() and again.errors.count() == h.errors.count()
    scan = st.active_waits(again.workflows, again.logs)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in scan or "StartsWith" in scan.split("PushedFilters", 1)[-1]


def test_waits_over_several_batches(spark, tmp_path):
    from runlens.streaming.jobs import drained, wait_outcomes

    batches = [[(1, 7, "signup", "2024-01-10 00:00:00"), (2, 8, "signup", "2024-01-10 00:00:00")], [(3, 7, "purchase", "2024-01-10 01:00:00"), (4, 8, "purchase", "2024-01-10 01:00:01")], [(5, 9, "signup", "2024-01-20 00:00:00"), (6, 9, "purchase", "2024-01-20 00:00:00")], [(7, 9, "signup", "2024-01-21 00:00:00")]]
    seen = {}
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "event_id long, user_id long, event_type string, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f={k}"))
        events = spark.readStream.schema("event_id long, user_id long, event_type string, t string, f int").parquet(str(tmp_path / "in")).withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", "1 day")
        wait_outcomes(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        keep = lambda rows, _: seen.update({r.user_id: (r.spawned, r.completed) for r in rows.collect()})
        drained(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    got = sorted((r.event_id, str(r.met_at)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # An end at the time-out itself still counts; one a second later leaves the wait timed out; the last wait is open.
    assert got == [(1, "2024-01-10 01:00:00"), (2, "None"), (5, "2024-01-20 00:00:00")]
    assert seen == {7: (1, 1), 8: (1, 1), 9: (2, 1)}
