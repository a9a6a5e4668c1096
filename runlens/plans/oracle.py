"""The registered queries once more, as SQL over the given tables."""

from __future__ import annotations

from runlens.sources.history import DEFINITION, EDGES, ERROR_CLASSES

NOW, EPOCH = "TIMESTAMP '2024-01-31 00:00:00'", "TIMESTAMP '1970-01-01 00:00:00'"

WF = f"""wf AS MATERIALIZED (SELECT id, key, job_class, state, created_at,
  CASE WHEN state = 0 AND k % 5 = 4 THEN NULL ELSE created_at + (k % 90) * INTERVAL '1' SECOND END AS started_at,
  CASE WHEN state = 2 THEN created_at + dur * INTERVAL '1' SECOND END AS completed_at, created_at + dur * INTERVAL '1' SECOND AS updated_at,
  CASE WHEN state = 1 THEN created_at + (k % 90) * INTERVAL '1' SECOND END AS locked_at, CASE WHEN state = 1 THEN 'worker-' || (k % 7) END AS locked_by,
  CASE WHEN k % 10 <> 0 THEN (k - k % 10) * 100 + 98 END AS parent_execution_log_id
FROM (SELECT o_orderkey AS k, o_orderkey + 1 AS id, 'wf-' || o_orderkey AS key, o_orderpriority AS job_class,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 1 THEN 3 ELSE 2 END WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 3 END END AS state,
  {NOW} - ((o_orderkey * 7919) % 3456000) * INTERVAL '1' SECOND AS created_at, 60 + (o_orderkey * 31) % 5400 AS dur FROM orders))"""
LOGS = f"""ln AS MATERIALIZED (SELECT l_orderkey AS k, l_returnflag AS rf, l_linestatus AS ls, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem),
lg AS (SELECT k, rn, (k + rn) % 6 AS m, CASE WHEN rf = 'R' THEN 2 WHEN ls = 'F' THEN 1 ELSE 0 END AS state, CAST(1704067200 + rn * 3600 AS VARCHAR) AS mark,
  CASE WHEN (k + rn) % 6 IN (2, 3) THEN TIMESTAMP '2024-01-01 00:00:00' + (rn * 3600 + (rn * 7) % 300) * INTERVAL '1' SECOND ELSE {NOW} - ((k * 7919) % 3456000) * INTERVAL '1' SECOND + (rn * 60) * INTERVAL '1' SECOND END AS started_at FROM ln),
co AS (SELECT o_orderkey AS k, {NOW} - ((o_orderkey * 7919) % 3456000) * INTERVAL '1' SECOND AS started_at FROM orders),
el AS MATERIALIZED (SELECT k * 100 + rn AS id, k + 1 AS workflow_id, CASE m WHEN 0 THEN 'wait_until$c' || rn WHEN 1 THEN 'continue_if$e' || rn WHEN 2 THEN 'durably_repeat$sync_job$' || mark WHEN 3 THEN 'durably_repeat$syncXjob$' || mark WHEN 4 THEN 'wait$w' || rn ELSE 'durably_execute$s' || rn END AS step_name,
  CAST(1 + rn % 3 AS INTEGER) AS attempts, started_at, CASE WHEN state = 1 THEN started_at + ((rn * 37) % 400) * INTERVAL '1' SECOND END AS completed_at, state,
  CASE WHEN state = 2 THEN CASE WHEN m IN (2, 3) THEN 'TimeoutError' ELSE 'Err' || (rn % 5) END END AS error_class,
  CASE WHEN m = 0 THEN '{{"timeout_at":"' || strftime(started_at + ((rn % 5) * 86400) * INTERVAL '1' SECOND, '%Y-%m-%dT%H:%M:%SZ') || '"}}' WHEN m = 4 THEN '{{"wait_until":"' || strftime(started_at + ((rn % 4) * 21600) * INTERVAL '1' SECOND, '%Y-%m-%dT%H:%M:%SZ') || '"}}' WHEN state = 2 AND m IN (2, 3) AND (k + rn) % 12 = 2 THEN '{{"fast_forwarded":' || (rn * 2) || '}}' END AS metadata FROM lg
 UNION ALL SELECT k * 100 + 99, k + 1, 'durably_repeat$sync_job', 1, started_at, NULL, 0, NULL, CASE WHEN k % 9 <> 0 THEN '{{"last_execution_at":"2024-01-01T05:00:00Z"}}' END FROM co WHERE k % 3 = 0
 UNION ALL SELECT k * 100 + 98, k + 1, 'branch$fulfil', 1, started_at, started_at, 1, NULL, NULL FROM co WHERE k % 10 = 0
 UNION ALL SELECT k * 100 + 97, k + 1, 'merge$fulfil', 1, started_at, CASE WHEN k % 20 = 0 THEN started_at END, CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END, NULL, NULL FROM co WHERE k % 10 = 0),
pt AS (SELECT *, string_split(step_name, '$') AS p FROM el),
pa AS MATERIALIZED (SELECT * EXCLUDE (p), CASE WHEN p[1] = 'durably_repeat' AND len(p) = 3 THEN 'repeat_run' WHEN len(p) = 2 THEN CASE p[1] WHEN 'durably_execute' THEN 'execute' WHEN 'wait' THEN 'sleep' WHEN 'wait_until' THEN 'wait' WHEN 'continue_if' THEN 'continue' WHEN 'durably_repeat' THEN 'repeat_coordination' WHEN 'branch' THEN 'branch' WHEN 'merge' THEN 'merge' END ELSE 'unknown' END AS kind,
  p[2] AS step, TRY_CAST(p[3] AS BIGINT) AS number, greatest(coalesce(TRY_CAST(json_extract_string(metadata, '$.fast_forwarded') AS BIGINT), 0), 1) AS skip FROM pt)"""
ERR = """er AS (SELECT event_id + 1 AS id, event_id + 1 AS workflow_id, CASE WHEN event_id % 3 <> 0 THEN 'durably_execute$s' || (event_id % 7) END AS step_name, CAST(1 + event_id % 3 AS INTEGER) AS attempt,
  CASE WHEN event_id % 50 <> 0 THEN 'Err' || (event_id % 5) END AS error_class, ts AS created_at FROM events WHERE event_type = 'error')"""
ALL = f"WITH RECURSIVE {WF}, {LOGS}, {ERR}"


def _text(*columns: str) -> str:
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in columns)


def _terminal(days: int) -> str:
    return f"(SELECT * FROM (SELECT *, CASE state WHEN 2 THEN completed_at ELSE updated_at END AS ended_at FROM wf WHERE state IN (2, 3)) WHERE ended_at BETWEEN {NOW} - INTERVAL '{days}' DAY AND {NOW})"


_SUMS = "count(*) FILTER (WHERE state = 2) AS completed, count(*) FILTER (WHERE state = 3) AS failed, CAST(round(avg(CASE WHEN state = 2 THEN epoch(completed_at) - epoch(started_at) END)) AS BIGINT) AS avg_seconds"
_DAYS = "strftime(ended_at, '%Y-%m-%d') AS day"
_COUNTS = "count(*) FILTER (WHERE state = 2) AS processed, count(*) FILTER (WHERE state IN (0, 1)) AS in_flight, count(*) FILTER (WHERE state IN (3, 4)) AS blocked, count(*) AS total"
_KEYS = "id, key, job_class, state"
_WAITS = "(SELECT w.id AS workflow_id, w.job_class, l.kind, l.step AS condition, l.started_at AS waiting_since, strptime(json_extract_string(l.metadata, '$.timeout_at'), '%Y-%m-%dT%H:%M:%SZ') AS timeout_at FROM wf w JOIN (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY started_at DESC NULLS LAST, id DESC) AS n FROM pa WHERE kind IN ('wait', 'continue') AND state = 0) l ON l.workflow_id = w.id AND l.n = 1 WHERE w.state = 0)"
_CHILDREN = "(SELECT b.id AS branch_id, b.workflow_id AS parent_id, b.state = 1 AS sealed, c.id AS child_id, c.state, c.started_at, c.updated_at FROM el b LEFT JOIN wf c ON c.parent_execution_log_id = b.id WHERE b.step_name = 'branch$fulfil')"
_EXPIRED = f"(SELECT * FROM wf WHERE (state = 2 AND completed_at <= {NOW} - INTERVAL '20' DAY) OR (state = 3 AND updated_at <= {NOW} - INTERVAL '30' DAY))"
_MERGES = "(SELECT b.workflow_id, substr(b.step_name, 8) AS branch, CASE WHEN m.merged IS NULL THEN 'unmerged' WHEN m.merged THEN 'merged' ELSE 'merging' END AS merge_state FROM el b LEFT JOIN (SELECT workflow_id, unnest(string_split(substr(step_name, 7), ',')) AS branch, state = 1 AS merged FROM el WHERE step_name LIKE 'merge$%') m ON m.workflow_id = b.workflow_id AND m.branch = substr(b.step_name, 8) WHERE b.step_name LIKE 'branch$%')"
_RUN_AT = f"{EPOCH} + number * INTERVAL '1' SECOND"


def _percentiles(start: str, end: str) -> str:
    return f"SELECT job_class, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, max(x) AS longest FROM (SELECT job_class, CAST(epoch({end}) - epoch({start}) AS BIGINT) AS x FROM wf WHERE state = 2) GROUP BY 1"


def _human(c: str) -> str:
    return f"CASE WHEN {c} < 60 THEN {c} || 's' WHEN {c} < 3600 THEN ({c} // 60) || 'm ' || lpad(CAST({c} % 60 AS VARCHAR), 2, '0') || 's' WHEN {c} < 86400 THEN ({c} // 3600) || 'h ' || lpad(CAST({c} // 60 % 60 AS VARCHAR), 2, '0') || 'm' ELSE ({c} // 86400) || 'd ' || lpad(CAST({c} // 3600 % 24 AS VARCHAR), 2, '0') || 'h' END"


#: Polls of all branches: what is seen, rates and counters, then intervals, each from the one before.
POLLS = f"""seals AS MATERIALIZED (SELECT parent_execution_log_id AS branch_id, CASE WHEN parent_execution_log_id % 7 <> 0 THEN max(created_at) END AS sealed_at FROM wf WHERE parent_execution_log_id IS NOT NULL GROUP BY 1),
seen AS MATERIALIZED (SELECT branch_id, poll, t AS polled_at, count(*) FILTER (WHERE created_at <= t AND (completed_at IS NULL OR completed_at > t)) AS pending, count(*) FILTER (WHERE created_at <= t) AS spawned,
  count(*) FILTER (WHERE started_at <= t AND (completed_at > t OR (completed_at IS NULL AND state = 1))) AS running, count(*) FILTER (WHERE created_at <= t AND (started_at IS NULL OR started_at > t)) AS never_started,
  count(*) FILTER (WHERE created_at <= t AND state = 0 AND started_at IS NULL AND updated_at < t - INTERVAL '5' MINUTE) AS stale
  FROM (SELECT parent_execution_log_id AS branch_id, wf.*, CAST(range AS INTEGER) AS poll, {NOW} - ((6 - range) * 7) * INTERVAL '1' DAY AS t FROM wf, range(7) WHERE parent_execution_log_id IS NOT NULL) GROUP BY 1, 2, 3),
rated AS MATERIALIZED (SELECT *, greatest(coalesce(lag(pending) OVER b - pending, 0), 0) / 604800.0 AS rate, CASE WHEN never_started < lag(never_started) OVER b THEN 0 ELSE least(stale, 200) END AS rekicked FROM seen WINDOW b AS (PARTITION BY branch_id ORDER BY poll)),
paced AS (SELECT branch_id, poll, CASE WHEN rate > 0 THEN least(greatest(pending / rate * 0.5, 5.0), 300.0) WHEN running > 0 OR never_started > 0 THEN 5.0 ELSE 300.0 END AS interval FROM rated WHERE poll = 0
  UNION ALL SELECT r.branch_id, r.poll, CASE WHEN rate > 0 THEN least(greatest(pending / rate * 0.5, 5.0), 300.0) WHEN running > 0 THEN 5.0 WHEN never_started > 0 THEN least(greatest(p.interval * 2, 5.0), 300.0) ELSE 300.0 END FROM paced p JOIN rated r ON r.branch_id = p.branch_id AND r.poll = p.poll + 1),
po AS MATERIALIZED (SELECT r.* EXCLUDE (spawned), first_value(CASE WHEN polled_at >= (SELECT sealed_at FROM seals s WHERE s.branch_id = r.branch_id) THEN spawned END IGNORE NULLS) OVER b AS spawned, count(*) OVER b AS polls, CAST(sum(rekicked) OVER b AS BIGINT) AS rekick_total, max(CASE WHEN rekicked > 0 THEN polled_at END) OVER b AS last_rekick_at,
  CASE WHEN rate > 0 THEN CAST(round(pending / rate) AS BIGINT) END AS eta_seconds, p.interval, polled_at + round(p.interval) * INTERVAL '1' SECOND AS next_poll_at FROM rated r JOIN paced p ON p.branch_id = r.branch_id AND p.poll = r.poll WINDOW b AS (PARTITION BY r.branch_id ORDER BY r.poll ROWS UNBOUNDED PRECEDING))"""
_HEALTH = f"(SELECT *, sealed AND pending = 0 AS done, CASE WHEN failed > 0 THEN 'failed' WHEN pending > 0 THEN 'active' WHEN spawned > 0 THEN 'done' ELSE 'not_reached' END AS status FROM (SELECT branch_id, parent_id, sealed, count(child_id) AS spawned, count(*) FILTER (WHERE state <> 2) AS pending, count(*) FILTER (WHERE state IN (3, 4)) AS blocked, count(*) FILTER (WHERE state = 0 AND started_at IS NULL) AS never_started, count(*) FILTER (WHERE state = 1) AS running, count(*) FILTER (WHERE state = 3) AS failed, count(*) FILTER (WHERE state = 1 OR (state = 0 AND started_at IS NULL)) AS progressing FROM {_CHILDREN} GROUP BY 1, 2, 3))"
#: What the last poll left of two in three branches.
RECORDED = f"""rp AS MATERIALIZED (SELECT branch_id, seen_at AS polled_at, CASE WHEN NOT whole OR pending > 0 THEN seen_at + (5 + branch_id % 296) * INTERVAL '1' SECOND END AS next_poll_at, pending, least(pending, never_started + branch_id % 2) AS never_started, CASE WHEN whole THEN spawned END AS spawned, (branch_id % 9) * 0.125::DOUBLE AS rate, 1 + branch_id % 12 AS polls
  FROM (SELECT branch_id, spawned, never_started, branch_id % 7 <> 0 AS whole, least(spawned, pending + branch_id % 3) AS pending, {NOW} - (branch_id % 600) * INTERVAL '1' SECOND AS seen_at FROM {_HEALTH} WHERE branch_id % 3 <> 0))"""
_LAST_AT = "strptime(json_extract_string(metadata, '$.last_execution_at'), '%Y-%m-%dT%H:%M:%SZ')"
_DUE = f"(SELECT workflow_id, step, every, CAST(epoch(coalesce({_LAST_AT}, started_at)) AS BIGINT) + every AS first_tick FROM (SELECT *, (workflow_id % 5 + 1) * 3600 AS every FROM pa WHERE kind = 'repeat_coordination'))"
_PRUNED = f"(SELECT r.id, r.workflow_id FROM pa r JOIN (SELECT workflow_id, step, {_LAST_AT} AS frontier FROM pa WHERE kind = 'repeat_coordination') c ON c.workflow_id = r.workflow_id AND c.step = r.step WHERE r.kind = 'repeat_run' AND r.state <> 0 AND {EPOCH} + r.number * INTERVAL '1' SECOND < TIMESTAMP '2024-01-10 00:00:00' AND {EPOCH} + r.number * INTERVAL '1' SECOND < c.frontier)"
_UNIX = lambda c: f"strftime({EPOCH} + ({c}) * INTERVAL '1' SECOND, '%Y-%m-%d %H:%M:%S')"
#: A row per key of every context.
_CONTEXT = """(SELECT o_orderkey + 1 AS id, CAST(u.place AS INTEGER) AS place, u.key, u.value, u.type, strlen(u.value) AS bytes FROM orders, LATERAL (SELECT unnest([
  {place: 0, key: 'customer', value: CAST(o_custkey AS VARCHAR), type: 'integer'}, {place: 1, key: 'memo', value: '"' || repeat('x', CAST(o_orderkey % 40 AS INTEGER)) || '"', type: 'string'}, {place: 2, key: 'lines', value: '[' || (o_orderkey % 7) || ',2]', type: 'array'},
  {place: 3, key: 'status', value: '"' || o_orderstatus || '"', type: 'string'}, {place: 4, key: 'done', value: CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, type: CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE 'boolean' END},
  {place: 5, key: 'share', value: '0.' || (o_orderkey % 9 + 1), type: 'float'}]) AS u) WHERE o_orderkey % 11 <> 0)"""
_NODES = "(VALUES ('n1', 'branch', 'branch$fulfil', NULL), ('n2', 'merge', 'merge$fulfil', NULL), ('n3', 'repeat', 'durably_repeat$sync_job', NULL), ('n4', 'execute', 'durably_execute$s1', NULL), ('n5', 'wait', 'wait_until$c2', NULL), ('n6', 'dynamic', NULL, 'durably_execute$'), ('n7', 'dynamic', NULL, 'durably_execute$'), ('n8', 'dynamic', NULL, 'wait$'), ('n9', 'dynamic', NULL, 'wait$w1'), ('n10', 'dynamic', NULL, 'wait$')) v(node, kind, step_name, prefix)"
OVERLAY = f"""nodes AS (SELECT * FROM {_NODES}), named AS (SELECT * FROM nodes WHERE step_name IS NOT NULL), runs AS (SELECT DISTINCT workflow_id FROM el), health AS (SELECT branch_id, status FROM {_HEALTH}),
reps AS (SELECT workflow_id, count(*) AS n FROM el WHERE starts_with(step_name, 'durably_repeat$sync_job$') GROUP BY 1),
free AS MATERIALIZED (SELECT workflow_id, id AS log_id, state, step_name FROM el WHERE step_name NOT IN (SELECT step_name FROM named) AND NOT starts_with(step_name, '$') AND length(step_name) - length(replace(step_name, '$', '')) < 2)"""
#: Dynamic nodes in their order: each takes the first log of its prefix that those before it left.
_DYNAMIC = (("n6", "durably_execute$"), ("n7", "durably_execute$"), ("n8", "wait$"), ("n9", "wait$w1"), ("n10", "wait$"))
for _k, (_node, _prefix) in enumerate(_DYNAMIC):
    _taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM took{i} t WHERE t.log_id = f.log_id)" for i in range(_k))
    OVERLAY += f", took{_k} AS MATERIALIZED (SELECT '{_node}' AS node, workflow_id, min(log_id) AS log_id FROM free f WHERE starts_with(step_name, '{_prefix}'){_taken} GROUP BY workflow_id)"
OVERLAY += ", took AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM took{k}" for k in range(len(_DYNAMIC))) + ")"
_STATE = "['active', 'done', 'failed'][{0} + 1]"


_SLEEPS_AT = "TIMESTAMP '2024-01-20 00:00:00'"
_TOP = "SELECT error_class, count(*) AS errors FROM er{join} WHERE er.created_at BETWEEN {now} - INTERVAL '30' DAY AND {now} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 8"

SELECTS = {
    "hist_workflows": f"SELECT {_KEYS}, {_text('created_at', 'started_at', 'completed_at', 'updated_at', 'locked_at')}, locked_by, parent_execution_log_id FROM wf",
    "hist_execution_logs": f"SELECT id, workflow_id, step_name, attempts, {_text('started_at', 'completed_at')}, state, error_class, metadata FROM el",
    "hist_error_logs": f"SELECT id, workflow_id, step_name, attempt, error_class, {_text('created_at')} FROM er",
    "daily_outcomes": f"SELECT {_DAYS}, {_SUMS} FROM {_terminal(7)} GROUP BY 1",
    "daily_outcomes_by_class": f"SELECT {_DAYS}, {_SUMS} FROM {_terminal(30)} WHERE job_class = '1-URGENT' GROUP BY 1",
    "window_totals": f"SELECT completed, failed, completed + failed AS terminal, completed / (completed + failed) AS completion_rate, failed / (completed + failed) AS failure_rate, avg_seconds FROM (SELECT {_SUMS} FROM {_terminal(30)})",
    "flagged_days": f"SELECT day, failed, failed / (completed + failed) AS failure_rate FROM (SELECT {_DAYS}, {_SUMS} FROM {_terminal(30)} GROUP BY 1) WHERE failed / (completed + failed) >= 0.1",
    "window_trend": f"SELECT p AS completion_points, -p AS failure_points, CASE WHEN p = 0 THEN '—' WHEN p > 0 THEN '▲' ELSE '▼' END AS arrow, CASE WHEN p = 0 THEN 'flat' ELSE CASE WHEN p > 0 THEN '+' ELSE '−' END || printf('%.1f', abs(p)) END AS points FROM (SELECT round((sum(CASE WHEN n > c // 2 THEN completed END) / sum(CASE WHEN n > c // 2 THEN completed + failed END) - sum(CASE WHEN n <= c // 2 THEN completed END) / sum(CASE WHEN n <= c // 2 THEN completed + failed END)) * 100, 1) AS p FROM (SELECT *, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS c FROM (SELECT {_DAYS}, {_SUMS} FROM {_terminal(7)} GROUP BY 1)))",
    "top_errors": _TOP.format(join="", now=NOW),
    "top_errors_by_class": _TOP.format(join=" JOIN wf ON wf.id = er.workflow_id AND wf.job_class = '1-URGENT'", now=NOW),
    "fleet_overview": f"SELECT job_class, {_COUNTS} FROM wf GROUP BY 1",
    "fleet_totals": f"SELECT job_class, {_COUNTS} FROM wf GROUP BY ROLLUP (job_class)",
    "class_share": f"SELECT job_class, processed, CAST(round(processed * 100 / sum(processed) OVER ()) AS BIGINT) AS share, blocked, blocked / total AS blocked_rate, CASE WHEN blocked = 0 THEN '0%' WHEN blocked / total < 0.0001 THEN '<0.01%' WHEN blocked / total < 0.01 THEN CAST(round(blocked / total * 100, 2) AS VARCHAR) || '%' ELSE CAST(round(blocked / total * 100) AS INTEGER) || '%' END AS blocked_shown FROM (SELECT job_class, {_COUNTS} FROM wf GROUP BY 1)",
    "state_stats_capped": "SELECT s AS state, p AS place, least(count(w.id), 5000) AS capped, CASE WHEN count(w.id) >= 5000 THEN '5000+' ELSE CAST(count(w.id) AS VARCHAR) END AS shown FROM (VALUES ('idle', 0, 2), ('running', 1, 1), ('completed', 2, 5), ('failed', 3, 4), ('stalled', 4, 3)) v(s, c, p) LEFT JOIN wf w ON w.state = c GROUP BY 1, 2",
    "workflow_page": f"SELECT {_KEYS}, true AS has_prev, c > 50 AS has_next FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS n, count(*) OVER () AS c FROM wf WHERE state = 2 AND id < 1001) WHERE n <= 50",
    "workflow_page_prev": f"SELECT {_KEYS}, c > 50 AS has_prev, true AS has_next FROM (SELECT *, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS c FROM wf WHERE parent_execution_log_id IS NULL AND id > 101) WHERE n <= 50",
    "key_prefix_list": f"SELECT {_KEYS} FROM wf WHERE starts_with(key, 'wf-12')",
    "blocked_list": f"SELECT {_KEYS} FROM wf WHERE state IN (3, 4)",
    "in_flight_list": f"SELECT {_KEYS} FROM wf WHERE state IN (0, 1)",
    "top_level_list": f"SELECT {_KEYS} FROM wf WHERE parent_execution_log_id IS NULL",
    "stranded": f"SELECT id, key, locked_by, {_text('locked_at')}, CAST(epoch({NOW}) - epoch(locked_at) AS BIGINT) AS lock_seconds FROM wf WHERE state = 1 AND wf.locked_at < {NOW} - INTERVAL '30' MINUTE",
    "row_durations": f"SELECT id, state, s AS seconds, {_human('s')} AS shown FROM (SELECT id, ['idle', 'running', 'completed', 'failed', 'stalled'][state + 1] AS state, CASE WHEN s >= 0 THEN s END AS s FROM (SELECT id, state, CAST(floor(epoch(CASE WHEN state = 2 THEN completed_at WHEN state = 1 THEN {NOW} WHEN state IN (3, 4) THEN updated_at END) - epoch(started_at)) AS BIGINT) AS s FROM wf))",
    "step_parse": "SELECT id, kind, step, number FROM pa",
    "step_kind_counts": "SELECT kind, count(*) AS steps, count(*) FILTER (WHERE state = 2) AS failed FROM pa GROUP BY 1",
    "active_waits": f"SELECT workflow_id, job_class, kind, condition, {_text('waiting_since', 'timeout_at')} FROM {_WAITS}",
    "long_waits": f"SELECT workflow_id, kind, condition, CAST(epoch({NOW}) - epoch(waiting_since) AS BIGINT) AS waited, kind = 'continue' AS urgent, coalesce(kind = 'wait' AND timeout_at > {NOW}, false) AS scheduled FROM {_WAITS} WHERE epoch({NOW}) - epoch(waiting_since) > 3600",
    "oldest_event_wait_by_class": f"SELECT job_class, workflow_id, {_text('waiting_since')}, waits FROM (SELECT *, row_number() OVER (PARTITION BY job_class ORDER BY waiting_since, workflow_id) AS n, count(*) OVER (PARTITION BY job_class) AS waits FROM {_WAITS} WHERE kind = 'continue') WHERE n = 1",
    "current_position": "SELECT workflow_id, step_name AS position FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY CASE WHEN state = 2 THEN 0 WHEN kind = 'wait' AND state = 0 THEN 1 ELSE 2 END, started_at DESC, id DESC) AS n FROM pa WHERE kind <> 'repeat_run') WHERE n = 1",
    "repetition_summary": "SELECT workflow_id, count(*) AS iterations, count(*) FILTER (WHERE state = 1) AS completed, count(*) FILTER (WHERE state = 2) AS tombstones, CAST(coalesce(sum(skip) FILTER (WHERE state = 2), 0) AS BIGINT) AS skipped_ticks, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_run_at FROM pa WHERE starts_with(step_name, 'durably_repeat$sync_job$') GROUP BY 1",
    "repetition_page": "SELECT id, workflow_id, step_name, false AS has_prev, c > 50 AS has_next FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS n, count(*) OVER () AS c FROM pa WHERE starts_with(step_name, 'durably_repeat$sync_job$')) WHERE n <= 50",
    "repetition_lateness": "SELECT id, number, greatest(late, 0) AS late_seconds, late > 60 AS late FROM (SELECT id, number, CAST(epoch(started_at) AS BIGINT) - number AS late FROM pa WHERE starts_with(step_name, 'durably_repeat$sync_job$'))",
    "periodic_health": "SELECT c.workflow_id, c.step, json_extract_string(c.metadata, '$.last_execution_at') AS last_execution_at, max(CASE WHEN r.state = 0 THEN r.number END) AS next_due, CAST(coalesce(sum(CASE WHEN r.error_class = 'TimeoutError' THEN r.skip END), 0) AS BIGINT) AS missed_ticks FROM pa c LEFT JOIN pa r ON r.workflow_id = c.workflow_id AND r.step = c.step AND r.kind = 'repeat_run' WHERE c.kind = 'repeat_coordination' GROUP BY 1, 2, 3",
    "recent_latencies": "SELECT workflow_id, step, runs, mean_latency, last_latency, 'avg ' || CAST(round(mean_latency) AS BIGINT) || 's · last ' || last_latency || 's' AS shown FROM (SELECT workflow_id, step, count(*) AS runs, avg(took) AS mean_latency, arg_max(took, id) AS last_latency FROM (SELECT *, CAST(epoch(completed_at) - epoch(started_at) AS BIGINT) AS took, row_number() OVER (PARTITION BY workflow_id, step ORDER BY id DESC) AS n FROM pa WHERE kind = 'repeat_run' AND state = 1 AND started_at IS NOT NULL AND completed_at IS NOT NULL) WHERE n <= 20 GROUP BY 1, 2)",
    "repetition_prune": "SELECT id FROM pruned",
    "timeline_steps": f"SELECT p.id, p.kind, row_number() OVER (PARTITION BY p.workflow_id ORDER BY p.started_at NULLS FIRST, p.id) AS place, coalesce(p.n, e.n, 0) AS errors, coalesce(p.a, e.a) AS last_attempt FROM (SELECT id, kind, workflow_id, step_name, started_at, NULL AS n, NULL AS a FROM pa UNION ALL SELECT id, 'lifecycle', workflow_id, NULL, NULL, CASE WHEN id % 10 <> 0 THEN 1 END, CASE WHEN id % 10 <> 0 THEN attempt END FROM er WHERE id % 2 = 0) p LEFT JOIN (SELECT workflow_id, step_name, count(*) AS n, max(attempt) AS a FROM er WHERE step_name IS NOT NULL GROUP BY 1, 2) e ON e.workflow_id = p.workflow_id AND e.step_name = p.step_name WHERE p.kind <> 'repeat_run'",
    "orphan_errors": "SELECT id, error_class, attempt FROM er WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.workflow_id = er.workflow_id AND el.step_name = er.step_name) AND NOT (id % 2 = 0 AND id % 10 <> 0)",
    "branch_health": f"SELECT * FROM {_HEALTH}",
    "merge_states": f"SELECT * FROM {_MERGES}",
    "unmerged_branches": f"SELECT workflow_id, branch FROM {_MERGES} WHERE merge_state <> 'merged'",
    "parent_breadcrumb": "SELECT w.id, l.workflow_id AS parent_id, p.key AS parent_key, l.step_name AS branch FROM wf w LEFT JOIN el l ON l.id = w.parent_execution_log_id LEFT JOIN wf p ON p.id = l.workflow_id",
    "drain_rate": "SELECT branch_id, poll, pending, round(rate, 12) AS rate, eta_seconds FROM po",
    "merge_throughput": f"SELECT id, workflow_id, names, CASE WHEN merged THEN 'merged' ELSE 'merging' END AS state, {_text('last_polled_at', 'next_poll_at')}, polls, coalesce(rate, 0.0) AS rate, CASE WHEN rate > 0 THEN CAST(round(pending / rate) AS BIGINT) END AS eta_seconds, coalesce(NOT merged AND m.next_poll_at < {NOW}, false) AS overdue, CAST(row_number() OVER (PARTITION BY workflow_id ORDER BY merged, started_at, id) AS INTEGER) AS place FROM (SELECT m.id, m.workflow_id, m.step AS names, m.state = 1 AS merged, m.started_at, p.polled_at AS last_polled_at, p.next_poll_at, p.polls, p.rate, p.pending FROM pa m LEFT JOIN (SELECT b.workflow_id, b.step, rp.* FROM pa b JOIN rp ON rp.branch_id = b.id WHERE b.kind = 'branch') p ON p.workflow_id = m.workflow_id AND p.step = m.step WHERE m.kind = 'merge') m",
    "merge_drain": "SELECT m.id, po.poll, po.pending, po.poll > 0 AS sampled, round(po.rate, 12) AS rate, po.eta_seconds FROM pa m JOIN pa b ON b.workflow_id = m.workflow_id AND b.kind = 'branch' AND b.step = m.step JOIN po ON po.branch_id = b.id WHERE m.kind = 'merge'",
    "poll_cadence": f"SELECT branch_id, poll, round(interval, 9) AS interval, {_text('next_poll_at')} FROM po",
    "rekick_candidates": f"SELECT branch_id, child_id, place FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY child_id) AS place FROM {_CHILDREN} WHERE state = 0 AND started_at IS NULL AND updated_at < {NOW} - INTERVAL '5' MINUTE) WHERE place <= 200",
    "retention_deleted": f"SELECT id, state FROM {_EXPIRED}",
    "retention_survivors": f"SELECT id, state FROM wf WHERE id NOT IN (SELECT id FROM {_EXPIRED})",
    "retention_orphaned_children": f"SELECT id FROM wf WHERE id NOT IN (SELECT id FROM {_EXPIRED}) AND parent_execution_log_id IN (SELECT el.id FROM el WHERE workflow_id IN (SELECT id FROM {_EXPIRED}))",
    "fast_forward": f"SELECT workflow_id, step, every, skipped, {_UNIX('first_tick + skipped * every')} AS next_at FROM (SELECT *, greatest(CAST(ceil((CAST(epoch({NOW}) AS BIGINT) - 3600 - first_tick) / every) AS BIGINT), 0) AS skipped FROM {_DUE})",
    "tick_grid_calendar": f"SELECT id, CAST(max(tick) AS VARCHAR) AS next_tick, max(n) AS ticks FROM walk GROUP BY 1",
    "retry_backoff_bounds": "SELECT id, policy, attempt, d / 2 AS backoff_min, d AS backoff_max, retries FROM (SELECT id, p.policy, attempt, least(p.cap, CAST(power(2.0, attempt - 1) AS DOUBLE)) AS d, p.policy <> 'wait' AND attempt < p.most AS retries FROM er, (VALUES ('step', 3, 30.0::DOUBLE), ('workflow', 10, 600.0::DOUBLE), ('wait', 0, 30.0::DOUBLE)) p(policy, most, cap))",
    "retry_routing": "SELECT id, policy, budget_key, CAST(used AS INTEGER) AS used, used < most AS retries, CASE WHEN used < most THEN least(30.0, CAST(power(2.0, used - 1) AS DOUBLE)) / 2 END AS backoff_min, CASE WHEN used < most THEN least(30.0, CAST(power(2.0, used - 1) AS DOUBLE)) END AS backoff_max FROM (SELECT *, CASE policy WHEN 'flaky' THEN 5 WHEN 'strict' THEN 1 ELSE 3 END AS most, CASE policy WHEN 'flaky' THEN 'Err0,Err1' WHEN 'strict' THEN 'Err2' ELSE '*' END AS budget_key, row_number() OVER (PARTITION BY workflow_id, policy ORDER BY created_at, id) AS used FROM (SELECT *, CASE WHEN error_class IN ('Err0', 'Err1') THEN 'flaky' WHEN error_class = 'Err2' THEN 'strict' ELSE 'any' END AS policy FROM er))",
    "retry_routing_by_class": "SELECT id, policy, budget_key, CASE WHEN policy IS NOT NULL THEN CAST(used AS INTEGER) END AS used, coalesce(used < most, false) AS retries, CASE WHEN used < most THEN least(30.0, base * CAST(power(2.0, used - 1) AS DOUBLE)) / 2 END AS backoff_min, CASE WHEN used < most THEN least(30.0, base * CAST(power(2.0, used - 1) AS DOUBLE)) END AS backoff_max FROM (SELECT er.id, f.*, row_number() OVER (PARTITION BY er.workflow_id, f.budget_key ORDER BY er.created_at, er.id) AS used FROM er LEFT JOIN firsts f ON f.class = er.error_class)",
    "retry_budget_bound": "SELECT job_class AS composite, CASE WHEN count(*) > count(a) THEN NULL ELSE max(a) END AS attempts FROM (SELECT job_class, CASE WHEN id % 5 <> ascii(job_class) % 5 THEN id % 9 + 1 END AS a FROM wf WHERE id % 2 = 1) GROUP BY 1",
    "policy_resolution": "SELECT l.id, CASE WHEN l.id % 4 = 0 THEN 'strict' WHEN kind IN ('wait', 'continue') THEN 'wait' WHEN job_class = '1-URGENT' THEN 'workflow' WHEN job_class = '2-HIGH' THEN 'gentle' ELSE 'step' END AS policy, CASE WHEN l.id % 4 = 0 THEN 1 WHEN kind IN ('wait', 'continue') OR job_class = '2-HIGH' THEN NULL WHEN job_class = '1-URGENT' THEN 10 ELSE 3 END AS attempts, CASE WHEN l.id % 4 <> 0 AND kind NOT IN ('wait', 'continue') AND job_class = '2-HIGH' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS base, CASE WHEN l.id % 4 = 0 OR kind IN ('wait', 'continue') THEN 30.0::DOUBLE WHEN job_class = '1-URGENT' THEN 600.0::DOUBLE WHEN job_class = '2-HIGH' THEN 60.0::DOUBLE ELSE 30.0::DOUBLE END AS cap FROM pa l JOIN wf w ON w.id = l.workflow_id",
    "stream_sleeps": f"SELECT id, {_text('due')}, CASE WHEN ended <= due THEN 'ended' ELSE 'reached' END AS outcome FROM (SELECT id, started_at, CASE WHEN state = 1 THEN completed_at END AS ended, strptime(json_extract_string(metadata, '$.wait_until'), '%Y-%m-%dT%H:%M:%SZ') AS due FROM pa WHERE kind = 'sleep') WHERE started_at <= {_SLEEPS_AT} AND (ended <= least(due, {_SLEEPS_AT}) OR due <= {_SLEEPS_AT})",
    "stream_wait_timeouts": f"SELECT id, {_text('due')}, CASE WHEN ended <= due THEN 'ended' ELSE 'reached' END AS outcome FROM (SELECT id, started_at, CASE WHEN state = 1 THEN completed_at END AS ended, strptime(json_extract_string(metadata, '$.timeout_at'), '%Y-%m-%dT%H:%M:%SZ') AS due FROM pa WHERE kind = 'wait') WHERE due IS NOT NULL AND started_at <= {_SLEEPS_AT} AND (ended <= least(due, {_SLEEPS_AT}) OR due < {_SLEEPS_AT})",
    "stream_stale_runs": f"SELECT id, strftime(begun + INTERVAL '30' MINUTE, '%Y-%m-%d %H:%M:%S') AS due, CASE WHEN ended <= begun + INTERVAL '30' MINUTE THEN 'ended' ELSE 'reached' END AS outcome FROM (SELECT id, coalesce(locked_at, CASE WHEN state = 2 THEN started_at END) AS begun, completed_at AS ended FROM wf) WHERE begun <= {_SLEEPS_AT} AND (ended <= least(begun + INTERVAL '30' MINUTE, {_SLEEPS_AT}) OR begun + INTERVAL '30' MINUTE < {_SLEEPS_AT})",
    "stream_barriers": "SELECT parent_execution_log_id AS branch_id, count(*) AS children FROM wf WHERE parent_execution_log_id % 7 <> 0 GROUP BY 1 HAVING count(*) = count(completed_at)",
    "complete_without_merge": f"SELECT wf.id, wf.key, count(*) AS open_branches FROM wf JOIN {_MERGES} m ON m.workflow_id = wf.id WHERE wf.state = 2 AND merge_state <> 'merged' GROUP BY 1, 2",
    "context_budget": "SELECT id, place, key, kept, CASE WHEN kept THEN value ELSE '<<omitted>>' END AS value FROM fold",
    "stranded_page": f"SELECT id, key, locked_by, {_text('locked_at')}, CAST(epoch({NOW}) - epoch(locked_at) AS BIGINT) AS lock_seconds, CAST(n AS INTEGER) AS place, c > 100 AS capped FROM (SELECT *, row_number() OVER (ORDER BY strftime(locked_at, '%Y-%m-%d %H:%M:%S'), id) AS n, count(*) OVER () AS c FROM wf WHERE state = 1 AND locked_at < {NOW} - INTERVAL '30' MINUTE) WHERE n <= 100",
    "created_between": f"SELECT {_KEYS} FROM wf WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00'",
    "lock_contention": "SELECT id, locked_by FROM wf WHERE state IN (0, 1) AND locked_at > TIMESTAMP '2024-01-19 23:50:00'",
    "idle_waits_page": f"SELECT workflow_id, job_class, kind, condition, {_text('waiting_since')}, capped, CAST(row_number() OVER (ORDER BY w.waiting_since, workflow_id) AS INTEGER) AS place FROM (SELECT w.*, f.c > 200 AS capped FROM {_WAITS} w JOIN (SELECT id, row_number() OVER (ORDER BY id) AS n, count(*) OVER () AS c FROM wf WHERE state = 0) f ON f.id = w.workflow_id AND f.n <= 200) w",
    "timeline_errors": "SELECT l.id AS step_id, e.id AS error_id, e.attempt, e.error_class, CAST(row_number() OVER (PARTITION BY l.id ORDER BY e.attempt, e.created_at, e.id) AS INTEGER) AS place FROM er e JOIN pa l ON l.workflow_id = e.workflow_id AND l.step_name = e.step_name WHERE l.kind <> 'repeat_run'",
    "failure_markers": "SELECT id, workflow_id, CASE WHEN id % 10 <> 0 THEN id END AS error_id, CASE WHEN id % 10 <> 0 THEN error_class END AS error_class, CASE WHEN id % 10 <> 0 THEN attempt END AS attempt, CASE WHEN id % 10 = 0 THEN id + 1000000000 END AS missing_error_id FROM er WHERE id % 2 = 0",
    "step_meters": f"SELECT id, CASE kind WHEN 'sleep' THEN 'wait' WHEN 'wait' THEN 'wait until' WHEN 'continue' THEN 'continue if' WHEN 'repeat_coordination' THEN 'repeat' ELSE kind END AS label, CASE WHEN attempts <= 1 OR kind = 'repeat_coordination' THEN NULL WHEN kind IN ('wait', 'continue', 'sleep') THEN 'checked ' || attempts || '×' ELSE attempts || ' attempts' END AS note, s AS seconds, {_human('s')} AS shown, CASE WHEN s <= 0 OR longest <= 0 THEN 0 ELSE least(CAST(round(sqrt(s / longest) * 20) AS INTEGER) * 5, 100) END AS bar, s >= 60 AS slow FROM (SELECT *, max(s) OVER (PARTITION BY workflow_id) AS longest FROM (SELECT *, CAST(floor(epoch(completed_at) - epoch(started_at)) AS BIGINT) AS s FROM pa WHERE kind <> 'repeat_run')) WHERE s IS NOT NULL",
    "metadata_pairs": " UNION ALL ".join(f"SELECT id, '{k.replace('_', ' ')}' AS key, json_extract_string(metadata, '$.{k}') AS value FROM el WHERE json_extract_string(metadata, '$.{k}') IS NOT NULL" for k in ("timeout_at", "wait_until", "fast_forwarded", "last_execution_at")),
    "poll_counters": f"SELECT branch_id, poll, polls, round(rate, 3) AS recorded_rate, spawned, running, never_started, rekicked, rekick_total, {_text('last_rekick_at')} FROM po",
    "fenced_polls": "SELECT branch_id, poll, 'second' AS token FROM po WHERE NOT (poll < 4 OR (poll < 6 AND branch_id % 300 = 98))",
    "poll_overdue": f"SELECT branch_id, {_text('next_poll_at')}, coalesce(rp.next_poll_at < {NOW} - INTERVAL '2' MINUTE, false) AS overdue FROM rp",
    "branch_counts_shown": f"SELECT h.branch_id, {', '.join(f'coalesce(p.{c}, least(h.{c}, 5000)) AS {c}' for c in ('spawned', 'pending', 'never_started'))}, least(h.blocked, 5000) AS blocked FROM {_HEALTH} h LEFT JOIN rp p ON p.branch_id = h.branch_id",
    "cleanup_counts": f"SELECT 'workflows' AS category, count(*) AS rows FROM {_EXPIRED} UNION ALL SELECT 'execution_logs', count(*) FROM el WHERE workflow_id IN (SELECT id FROM {_EXPIRED}) UNION ALL SELECT 'error_logs', count(*) FROM er WHERE workflow_id IN (SELECT id FROM {_EXPIRED}) UNION ALL SELECT 'repetition_logs', count(*) FROM {_PRUNED} WHERE workflow_id NOT IN (SELECT id FROM {_EXPIRED}) UNION ALL SELECT 'orphaned_children', count(*) FROM wf WHERE id NOT IN (SELECT id FROM {_EXPIRED}) AND parent_execution_log_id IN (SELECT id FROM el WHERE workflow_id IN (SELECT id FROM {_EXPIRED}))",
    "tick_grid_runs": "SELECT t.workflow_id, t.step, t.number, r.id AS run_id, CASE r.state WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE CASE WHEN t.number < 1704132000 - 3600 THEN 'missed' ELSE 'due' END END AS status FROM ticks t LEFT JOIN finished r ON r.workflow_id = t.workflow_id AND r.step = t.step AND r.number = t.number",
    "tick_grid_bounded": "SELECT t.workflow_id, t.step, t.number, r.id AS run_id, CASE r.state WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE CASE WHEN t.number < 1704132000 - 3600 THEN 'missed' ELSE 'due' END END AS status FROM ticks t LEFT JOIN finished r ON r.workflow_id = t.workflow_id AND r.step = t.step AND r.number = t.number",
    "state_intervals": f"SELECT workflow_id, CAST(place AS INTEGER) AS place, state, {_text('since', 'until')}, before, seconds, legal FROM spans",
    "time_in_states": "SELECT job_class, s.state, count(*) AS workflows, CAST(sum(visits) AS BIGINT) AS visits, sum(seconds) AS seconds, max(longest) AS longest FROM (SELECT workflow_id, state, count(*) AS visits, sum(seconds) AS seconds, max(seconds) AS longest FROM spans GROUP BY 1, 2) s JOIN wf ON wf.id = s.workflow_id GROUP BY 1, 2",
    "illegal_transitions": f"SELECT workflow_id, CAST(place AS INTEGER) AS place, before, state, {_text('since')} FROM spans WHERE NOT legal",
    "lock_sessions": f"SELECT workflow_id, owner, {_text('since', 'until')}, touches FROM sessions",
    "lock_overlaps": f"SELECT a.workflow_id, a.owner AS first, b.owner AS second, strftime(b.since, '%Y-%m-%d %H:%M:%S') AS since, strftime(least(a.until, b.until), '%Y-%m-%d %H:%M:%S') AS until FROM sessions a JOIN sessions b ON a.workflow_id = b.workflow_id AND a.owner <> b.owner AND b.since < a.until AND (a.since < b.since OR (a.since = b.since AND a.owner < b.owner))",
    "run_timeouts": f"SELECT id, {_UNIX('number + 3600')} AS timeout_at, CASE WHEN 1704090600 > number + 3600 THEN 'timed_out' WHEN number <= 1704090600 THEN 'due' ELSE 'scheduled' END AS outcome FROM pa WHERE kind = 'repeat_run' AND state = 0",
    "failed_runs": f"SELECT id, CASE WHEN fails THEN 'fail_workflow' ELSE 'continue' END AS follows, CASE WHEN NOT fails THEN {_UNIX('number + 3600')} END AS next_at FROM (SELECT id, number, workflow_id % 3 = 0 AND id % 2 <> 0 AS fails FROM pa WHERE kind = 'repeat_run' AND state = 2)",
    "context_nodes": f"SELECT *, type NOT IN ('string', 'object', 'array') OR bytes <= 16384 AS valid FROM {_CONTEXT}",
    "context_sizes": f"SELECT o_orderkey + 1 AS id, CASE WHEN c.id IS NULL THEN 0 ELSE 6 END AS keys, coalesce(c.bytes, 2) AS bytes FROM orders LEFT JOIN (SELECT id, CAST(sum(strlen(key) + 3 + bytes) + 6 - 1 + 2 AS INTEGER) AS bytes FROM {_CONTEXT} GROUP BY 1) c ON c.id = o_orderkey + 1",
    "context_edits": "SELECT o_orderkey + 1 AS id, CASE WHEN f THEN CAST(o_custkey AS VARCHAR) ELSE 'none' END AS customer, 'm' AS memo, 'Z' AS merged, CASE WHEN f THEN o_orderstatus ELSE 'Z' END AS merged_once, CASE WHEN f THEN 7 ELSE 2 END AS keys FROM (SELECT *, o_orderkey % 11 <> 0 AS f FROM orders)",
    "definition_overlay": f"SELECT r.workflow_id, n.node, l.id AS log_id, CASE WHEN l.id IS NULL THEN 'not_reached' WHEN n.kind = 'branch' THEN coalesce(h.status, 'not_reached') WHEN n.kind = 'repeat' THEN CASE WHEN l.state = 1 THEN 'done' ELSE 'active' END ELSE {_STATE.format('l.state')} END AS status, CASE WHEN n.kind = 'repeat' AND l.id IS NOT NULL THEN coalesce(p.n, 0) END AS repetitions FROM runs r CROSS JOIN named n LEFT JOIN el l ON l.workflow_id = r.workflow_id AND l.step_name = n.step_name LEFT JOIN health h ON h.branch_id = l.id LEFT JOIN reps p ON p.workflow_id = r.workflow_id UNION ALL SELECT r.workflow_id, d.node, f.log_id, coalesce({_STATE.format('f.state')}, 'not_reached'), NULL FROM runs r CROSS JOIN (SELECT node FROM nodes WHERE step_name IS NULL) d LEFT JOIN took t ON t.workflow_id = r.workflow_id AND t.node = d.node LEFT JOIN free f ON f.log_id = t.log_id UNION ALL SELECT workflow_id, 'log-' || log_id, log_id, 'unmapped', NULL FROM free f WHERE state = 1 AND NOT EXISTS (SELECT 1 FROM took t WHERE t.log_id = f.log_id)",
    "run_graphs": "SELECT workflow_id, '{\"nodes\":[' || string_agg(element, ',' ORDER BY place, log_id) || ',' || (SELECT ends FROM drawn) || '],\"edges\":[' || (SELECT edges FROM drawn) || ']}' AS document FROM elements GROUP BY 1",
    "bulk_insert": "SELECT 'wf-1$fulfil$mail_' || c_custkey AS key, c_mktsegment AS job_class FROM customer WHERE c_custkey >= 50 AND c_custkey % 10 <> 0",
    "upserted": f"SELECT id, CASE WHEN id % 7 = 0 THEN 4 ELSE state END AS state, strftime(CASE WHEN id % 7 = 0 THEN updated_at + INTERVAL '1' SECOND ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM wf UNION ALL SELECT id + 1000000000, 0, strftime(updated_at, '%Y-%m-%d %H:%M:%S') FROM wf WHERE id % 7 = 0",
    "resumed_by_count": "SELECT p_partkey, p_size, n FROM (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS n FROM part) WHERE n >= 100",
    "sleeps": f"SELECT id, workflow_id, strftime(u, '%Y-%m-%d %H:%M:%S') AS until, u <= TIMESTAMP '2024-01-20 00:00:00' AS done, CASE WHEN u > TIMESTAMP '2024-01-20 00:00:00' THEN CAST(epoch(u) - epoch(TIMESTAMP '2024-01-20 00:00:00') AS BIGINT) END AS left FROM (SELECT id, workflow_id, strptime(json_extract_string(metadata, '$.wait_until'), '%Y-%m-%dT%H:%M:%SZ') AS u FROM pa WHERE kind = 'sleep' AND state = 0)",
    "evaluated_waits": "SELECT *, outcome = 'timed_out' AS stalls FROM (SELECT id, kind, CASE WHEN id % 3 = 0 THEN 'met' WHEN kind = 'wait' AND strptime(json_extract_string(metadata, '$.timeout_at'), '%Y-%m-%dT%H:%M:%SZ') < TIMESTAMP '2024-01-20 00:00:00' THEN 'timed_out' ELSE 'waiting' END AS outcome FROM pa WHERE kind IN ('wait', 'continue') AND state = 0)",
    "repetition_meters": f"SELECT id, CASE WHEN late <= 0 THEN 'on time' ELSE {_human('late')} END AS late, CASE WHEN late > 0 THEN least(CAST(round(sqrt(late / coalesce(ml, 1)) * 20) AS INTEGER) * 5, 100) ELSE 0 END AS late_bar, {_human('took')} AS took, CASE WHEN took > 0 AND mt > 0 THEN least(CAST(round(sqrt(took / mt) * 20) AS INTEGER) * 5, 100) ELSE 0 END AS took_bar FROM (SELECT *, max(CASE WHEN late > 0 THEN late END) OVER () AS ml, coalesce(max(took) OVER (), 1) AS mt FROM (SELECT id, CAST(epoch(started_at) AS BIGINT) - number AS late, CAST(epoch(completed_at) - epoch(started_at) AS BIGINT) AS took, row_number() OVER (ORDER BY id DESC) AS n FROM pa WHERE starts_with(step_name, 'durably_repeat$sync_job$')) WHERE n <= 50)",
    "exec_time_percentiles": _percentiles("started_at", "completed_at"),
    "queue_wait_percentiles": _percentiles("created_at", "started_at"),
    "dispatch_throughput": "SELECT job_class, round(count(completed_at) / CAST(epoch(max(completed_at)) - epoch(min(created_at)) AS BIGINT), 9) AS completed_per_second, round(count(*) / CAST(epoch(max(created_at)) - epoch(min(created_at)) AS BIGINT), 9) AS dispatched_per_second FROM wf GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    walk = "walk AS (SELECT id, CAST(created_at - (400 + id % 13 * 366) * INTERVAL '1' DAY AS DATE) AS tick, CAST(0 AS BIGINT) AS n FROM wf UNION ALL SELECT id, CAST(tick + INTERVAL '1' MONTH AS DATE), n + 1 FROM walk WHERE tick < DATE '2024-01-31')"
    fold = f"vals AS (SELECT * FROM {_CONTEXT}), fold AS (SELECT id, place, key, value, bytes <= 30 AS kept, CASE WHEN bytes <= 30 THEN 30 - bytes ELSE 30 END AS room FROM vals WHERE place = 0 UNION ALL SELECT v.id, v.place, v.key, v.value, v.bytes <= f.room, CASE WHEN v.bytes <= f.room THEN f.room - v.bytes ELSE f.room END FROM fold f JOIN vals v ON v.id = f.id AND v.place = f.place + 1)"
    tree = f"tree(class, parent) AS (VALUES {', '.join(str(x) for x in ERROR_CLASSES)}), above(class, is_a) AS (SELECT class, class FROM tree UNION SELECT above.class, tree.parent FROM above JOIN tree ON tree.class = above.is_a)"
    firsts = f"{tree}, rules(place, policy, budget_key, cls, most, base) AS (VALUES (0, 'network', 'IOError', 'IOError', 5, 1.0), (1, 'strict', 'StrictError', 'StrictError', 1, 1.0), (2, 'even', 'Even', 'Even', 2, 2.0), (3, 'any', '*', 'StandardError', 3, 1.0)), firsts AS MATERIALIZED (SELECT * FROM (SELECT a.class, r.*, row_number() OVER (PARTITION BY a.class ORDER BY place) AS n FROM above a JOIN rules r ON r.cls = a.is_a) WHERE n = 1)"
    # Small parts, joined by equality on whole seconds.
    tasks = f"tasks AS MATERIALIZED (SELECT workflow_id, step, CAST(epoch({_LAST_AT}) AS BIGINT) AS frontier, CAST(epoch(started_at) AS BIGINT) AS began FROM pa WHERE kind = 'repeat_coordination'), finished AS MATERIALIZED (SELECT id, workflow_id, step, number, state FROM pa WHERE kind = 'repeat_run')"
    pruned = f"{tasks}, pruned AS (SELECT r.id FROM finished r JOIN tasks c ON c.workflow_id = r.workflow_id AND c.step = r.step WHERE r.state <> 0 AND r.number < 1704844800 AND r.number < c.frontier)"
    ticks = f"{tasks}, due AS MATERIALIZED (SELECT workflow_id, step, every, coalesce(frontier, began) + every AS first_tick FROM (SELECT *, (workflow_id % 5 + 1) * 3600 AS every FROM tasks)), ticks AS MATERIALIZED (SELECT workflow_id, step, unnest(range(first_tick, 1704132001, every)) AS number FROM due WHERE first_tick <= 1704132000)"
    bounded = f"{tasks}, due AS MATERIALIZED (SELECT workflow_id, step, every, coalesce(frontier + every, CASE WHEN workflow_id % 2 = 0 THEN 1704074400 + 60 * (workflow_id % 90) END, began + every) AS first_tick, CASE WHEN workflow_id % 3 = 0 THEN least(1704132000, 1704081600 + 3600 * (workflow_id % 12)) ELSE 1704132000 END AS last_tick FROM (SELECT *, (workflow_id % 5 + 1) * 3600 AS every FROM tasks)), ticks AS MATERIALIZED (SELECT workflow_id, step, unnest(range(first_tick, last_tick + 1, every)) AS number FROM due WHERE first_tick <= last_tick)"
    begun = "coalesce(started_at, created_at)"
    states = f"""changes AS MATERIALIZED (SELECT id AS workflow_id, created_at AS at_time, 'idle' AS state, 0 AS source, 0 AS rank FROM wf UNION ALL SELECT id, started_at, 'running', 0, 1 FROM wf UNION ALL SELECT id, completed_at, 'completed', id * 10 + 1, 2 FROM wf WHERE state = 2 UNION ALL SELECT id, updated_at, 'failed', id * 10 + 2, 2 FROM wf WHERE state = 3
 UNION ALL SELECT id, {begun} + INTERVAL '20' SECOND, 'idle', id * 10 + 4, 3 FROM wf WHERE id % 4 = 0 UNION ALL SELECT id, {begun} + INTERVAL '10' SECOND, 'failed', id * 10 + 3, 2 FROM wf WHERE id % 4 = 0 UNION ALL SELECT id, {begun} - INTERVAL '5' SECOND, 'idle', id * 10 + 5, 3 FROM wf WHERE id % 13 = 0),
ordered AS (SELECT workflow_id, row_number() OVER o AS place, state, at_time AS since, coalesce(lead(at_time) OVER o, {NOW}) AS until, lag(state) OVER o AS before FROM changes WHERE at_time <= {NOW} WINDOW o AS (PARTITION BY workflow_id ORDER BY at_time, rank, source)),
spans AS MATERIALIZED (SELECT *, CAST(epoch(until) - epoch(since) AS DOUBLE) AS seconds, CASE WHEN before IS NULL THEN state = 'idle' ELSE (before, state) IN (('idle', 'running'), ('running', 'idle'), ('running', 'completed'), ('running', 'failed'), ('running', 'stalled'), ('failed', 'idle'), ('stalled', 'idle')) END AS legal FROM ordered)"""
    sessions = """touched AS MATERIALIZED (SELECT workflow_id, 'worker-' || (CASE WHEN id % 5 = 0 THEN id ELSE workflow_id END % 7) AS owner, started_at AS t FROM el),
islands AS (SELECT *, sum(CASE WHEN t <= before + INTERVAL '600' SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY workflow_id, owner ORDER BY t) AS n FROM (SELECT *, lag(t) OVER (PARTITION BY workflow_id, owner ORDER BY t) AS before FROM touched)),
sessions AS MATERIALIZED (SELECT workflow_id, owner, min(t) AS since, max(t) + INTERVAL '600' SECOND AS until, count(*) AS touches FROM islands GROUP BY workflow_id, owner, n)"""
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    nodes = ", ".join(f"({k}, {quoted(n)}, {quoted(step or prefix + '…')}, {quoted(kind)}, {quoted(step)})" for k, (n, kind, step, prefix) in enumerate(DEFINITION))
    known = {n for n, *_ in DEFINITION}
    ends = ",".join(f'{{"data":{{"id":"{x}","label":"{x}"}},"classes":"kind-endpoint"}}' for x in dict.fromkeys(x for a, b, *_ in EDGES for x in (a, b)) if x not in known)
    lines = ",".join(f'{{"data":{{"id":"e{k}","source":"{a}","target":"{b}","label":"{guard or ""}"}},"classes":"kind-{kind}"}}' for k, (a, b, kind, guard) in enumerate(EDGES))
    tally = " || ".join(f"""CASE WHEN count(*) FILTER (WHERE state = {k}) > 0 THEN ',"{name}":' || count(*) FILTER (WHERE state = {k}) ELSE '' END""" for k, name in enumerate(("idle", "running", "completed", "failed", "stalled")))
    graphs = f"""{OVERLAY}, laid AS MATERIALIZED ({SELECTS['definition_overlay']}), tally AS (SELECT parent_execution_log_id AS log_id, '{{' || substr({tally}, 2) || '}}' AS counts FROM wf WHERE parent_execution_log_id IS NOT NULL GROUP BY 1),
drawn AS (SELECT '{ends}' AS ends, '{lines}' AS edges), spec(place, node, label, kind, step_name) AS (VALUES {nodes}),
elements AS MATERIALIZED (SELECT laid.workflow_id, coalesce(s.place, 1000) AS place, laid.log_id, '{{"data":{{"id":"' || laid.node || '","label":"' || coalesce(s.label, el.step_name) || '"' || coalesce(',"step_name":"' || coalesce(s.step_name, el.step_name) || '"', '') || coalesce(',"repetitions":' || laid.repetitions, '') || coalesce(',"counts":' || tally.counts, '') || '}},"classes":"kind-' || coalesce(s.kind, 'unmapped') || ' status-' || laid.status || '"}}' AS element
  FROM laid LEFT JOIN spec s ON s.node = laid.node LEFT JOIN el ON el.id = laid.log_id LEFT JOIN tally ON tally.log_id = laid.log_id)"""
    more = {"run_graphs": graphs} | dict.fromkeys(("state_intervals", "time_in_states", "illegal_transitions"), states) | dict.fromkeys(("lock_sessions", "lock_overlaps"), sessions) | {"tick_grid_bounded": bounded, "retry_routing_by_class": firsts, "repetition_prune": pruned, "tick_grid_runs": ticks, "tick_grid_calendar": walk, "context_budget": fold, "definition_overlay": OVERLAY} | dict.fromkeys(("drain_rate", "poll_cadence", "poll_counters", "fenced_polls", "merge_drain"), POLLS) | dict.fromkeys(("poll_overdue", "merge_throughput", "branch_counts_shown"), RECORDED)
    out = {name: f"{ALL}{', ' + more[name] if name in more else ''} {select}" for name, select in SELECTS.items()}
    out["stream_first_events"] = "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT DISTINCT user_id, event_type, ts FROM events)"
    out["stream_wait_outcomes"] = "SELECT event_id, user_id, strftime(met_at, '%Y-%m-%d %H:%M:%S') AS met_at, CASE WHEN met_at IS NULL THEN 'timed_out' ELSE 'met' END AS outcome FROM (SELECT w.event_id, w.user_id, w.ts, min(p.ts) AS met_at FROM events w LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = w.user_id AND p.ts BETWEEN w.ts AND w.ts + INTERVAL '1' HOUR WHERE w.event_type = 'signup' GROUP BY 1, 2, 3) WHERE met_at IS NOT NULL OR ts < (SELECT max(ts) FROM events) - INTERVAL '25' HOUR"
    out["stream_by_key"] = "SELECT c_custkey, c_mktsegment FROM customer"
    out["stream_bulk_insert"] = "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 3, ts, event_id) AS n FROM events) WHERE n = 1"
    out["stream_late_events"] = "SELECT event_id, event_id % 3 AS batch, coalesce(ts < upto - INTERVAL '1' DAY, false) AS late FROM events LEFT JOIN (SELECT 1 AS k, max(ts) AS upto FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 2, max(ts) FROM events WHERE event_id % 3 < 2) m ON m.k = event_id % 3"
    out["stream_drain"] = "SELECT user_id, s AS spawned, c AS completed, greatest(s - c, 0) AS pending FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY 1)"
    out["stream_daily_errors"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1"
    return out
