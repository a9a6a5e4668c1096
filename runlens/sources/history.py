"""The three history tables, derived from orders, lineitem and events.

The derivation uses integer arithmetic on keys alone, so that SQL elsewhere gives
the same rows.  ``load`` reads tables that exist already.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions.steps import iso, now_at, seconds_after

NOW = "2024-01-31 00:00:00"
#: Start of the grid of repetitions: unix seconds and the same as a timestamp.
GRID, GRID_AT = 1704067200, "2024-01-01 00:00:00"


@dataclass
class History:
    workflows: DataFrame
    logs: DataFrame
    errors: DataFrame


SCHEMAS = {
    "workflows": "id long, key string, job_class string, state int, created_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz, updated_at timestamp_ntz, locked_at timestamp_ntz, locked_by string, parent_execution_log_id long",
    "execution_logs": "id long, workflow_id long, step_name string, attempts int, started_at timestamp_ntz, completed_at timestamp_ntz, state int, error_class string, metadata string",
    "error_logs": "id long, workflow_id long, step_name string, attempt int, error_class string, created_at timestamp_ntz",
}


#: Formats of kept history, with what reading them as written takes.
FORMATS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true", "escape": '"', "multiLine": "true"}}


def load(spark: SparkSession, folder: str, source: str = "parquet") -> History:
    """History that is there, in files or folders named by table and format (``workflows.parquet``); columns that an older table lacks are null.

    Columns go by name in all formats; in CSV, which has no types, an empty text is null.
    """
    if source not in FORMATS:
        raise ValueError(f"history is read from {', '.join(FORMATS)}, not from {source}")

    def table(name: str, schema: str) -> DataFrame:
        path, reader = f"{folder}/{name}.{source}", spark.read.format(source).options(**FORMATS[source])
        if source != "csv":
            return reader.schema(schema).load(path)
        # A schema would go by place; so columns are read as text by their header's names.
        rows = reader.load(path)
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split() for x in schema.split(", "))))

    return History(*(table(name, schema) for name, schema in SCHEMAS.items()))


def _mod(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n))


def workflows(orders: DataFrame) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    state = F.when(status == "F", F.when(_mod(k, 10) == 1, 3).otherwise(2)).when(status == "O", F.when(_mod(k, 4) == 0, 0).otherwise(2)).otherwise(F.when(_mod(k, 3) == 0, 1).when(_mod(k, 3) == 1, 4).otherwise(3))
    created = seconds_after(now_at(NOW), -_mod(k * 7919, 3456000))
    d = orders.select(k.alias("k"), (k + 1).alias("id"), F.concat(F.lit("wf-"), k.cast("string")).alias("key"), F.col("o_orderpriority").alias("job_class"), state.alias("state"), created.alias("created_at"))
    k, state, created = F.col("k"), F.col("state"), F.col("created_at")
    ended, begun = seconds_after(created, 60 + _mod(k * 31, 5400)), seconds_after(created, _mod(k, 90))
    return d.select(
        "id", "key", "job_class", "state", "created_at",
        F.when((state == 0) & (_mod(k, 5) == 4), None).otherwise(begun).alias("started_at"),
        F.when(state == 2, ended).alias("completed_at"), ended.alias("updated_at"),
        F.when(state == 1, begun).alias("locked_at"), F.when(state == 1, F.concat(F.lit("worker-"), _mod(k, 7).cast("string"))).alias("locked_by"),
        F.when(_mod(k, 10) != 0, (k - _mod(k, 10)) * 100 + 98).alias("parent_execution_log_id"),
    )


def execution_logs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    d = lineitem.select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linestatus", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("rn"))
    k, rn = F.col("k"), F.col("rn")
    which, n, at = _mod(k + rn, 6), rn.cast("string"), (F.lit(GRID) + rn * 3600).cast("string")
    name = F.when(which == 0, F.concat(F.lit("wait_until$c"), n)).when(which == 1, F.concat(F.lit("continue_if$e"), n)).when(which == 2, F.concat(F.lit("durably_repeat$sync_job$"), at)).when(which == 3, F.concat(F.lit("durably_repeat$syncXjob$"), at)).when(which == 4, F.concat(F.lit("wait$w"), n)).otherwise(F.concat(F.lit("durably_execute$s"), n))
    created = seconds_after(now_at(NOW), -_mod(k * 7919, 3456000))
    repeats = which.isin(2, 3)
    started = F.when(repeats, seconds_after(now_at(GRID_AT), rn * 3600 + _mod(rn * 7, 300))).otherwise(seconds_after(created, rn * 60))
    d = d.select("k", "rn", (k * 100 + rn).alias("id"), (k + 1).alias("workflow_id"), name.alias("step_name"), (1 + _mod(rn, 3)).cast("int").alias("attempts"), F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("state"), started.alias("started_at"), repeats.alias("repeats"), which.alias("which"))
    state, started, which = F.col("state"), F.col("started_at"), F.col("which")
    timeout = F.when(F.col("step_name").startswith("wait_until$"), seconds_after(started, _mod(rn, 5) * 86400))
    steps = d.select(
        "id", "workflow_id", "step_name", "attempts", "started_at", F.when(state == 1, seconds_after(started, _mod(rn * 37, 400))).alias("completed_at"), "state",
        F.when(state == 2, F.when(F.col("repeats"), "TimeoutError").otherwise(F.concat(F.lit("Err"), _mod(rn, 5).cast("string")))).alias("error_class"),
        F.when(timeout.isNotNull(), F.concat(F.lit('{"timeout_at":"'), iso(timeout), F.lit('"}'))).when(which == 4, F.concat(F.lit('{"wait_until":"'), iso(seconds_after(started, _mod(rn, 4) * 21600)), F.lit('"}'))).when((state == 2) & F.col("repeats") & (_mod(k + rn, 12) == 2), F.concat(F.lit('{"fast_forwarded":'), (rn * 2).cast("string"), F.lit("}"))).alias("metadata"),
    )
    k = F.col("o_orderkey")
    created = seconds_after(now_at(NOW), -_mod(k * 7919, 3456000))
    row = lambda number, name, state, metadata: F.struct((k * 100 + number).alias("id"), (k + 1).alias("workflow_id"), F.lit(name).alias("step_name"), F.lit(1).alias("attempts"), created.alias("started_at"), F.when(state == 1, created).alias("completed_at"), state.alias("state"), F.lit(None).cast("string").alias("error_class"), metadata.alias("metadata"))
    none = F.lit(None).cast("string")
    rows = F.array_compact(F.array(
        F.when(_mod(k, 3) == 0, row(99, "durably_repeat$sync_job", F.lit(0), F.when(_mod(k, 9) != 0, '{"last_execution_at":"2024-01-01T05:00:00Z"}'))),
        F.when(_mod(k, 10) == 0, row(98, "branch$fulfil", F.lit(1), none)),
        F.when(_mod(k, 10) == 0, row(97, "merge$fulfil", F.when(_mod(k, 20) == 0, 1).otherwise(0), none)),
    ))
    return steps.unionByName(orders.select(F.inline(rows)))


def contexts(orders: DataFrame) -> DataFrame:
    """``id`` and ``context``: the JSON document of every workflow, with values of several types and sizes."""
    k = F.col("o_orderkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = {"customer": F.col("o_custkey").cast("string"), "memo": quoted(F.repeat(F.lit("x"), _mod(k, 40).cast("int"))), "lines": F.concat(F.lit("["), _mod(k, 7).cast("string"), F.lit(",2]")), "status": quoted(F.col("o_orderstatus")), "done": F.when(_mod(k, 3) == 0, "null").otherwise((_mod(k, 2) == 0).cast("string")), "share": F.concat(F.lit("0."), (_mod(k, 9) + 1).cast("string"))}
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in pairs.items()]
    return orders.select((k + 1).alias("id"), F.when(_mod(k, 11) != 0, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).otherwise("{}").alias("context"))


def failure_marks(errors: DataFrame) -> DataFrame:
    """A mark, as an execution log, for every second error; one in ten names an error that is gone."""
    named = F.when(_mod(F.col("id"), 10) == 0, F.col("id") + 1_000_000_000).otherwise(F.col("id"))
    return errors.where(_mod(F.col("id"), 2) == 0).select(F.col("id"), "workflow_id", F.concat(F.lit("$workflow_failure$"), named.cast("string")).alias("step_name"), F.lit(2).alias("state"))


def lifecycle_marks(wf: DataFrame) -> DataFrame:
    """Marks, as execution logs, of completions and failures; every fourth workflow failed and was tried again a little after its start, and every thirteenth has a retry of nothing."""
    k, begun = F.col("id"), F.coalesce("started_at", "created_at")
    row = lambda number, name, at: F.struct((k * 10 + number).alias("id"), k.alias("workflow_id"), F.lit(name).alias("step_name"), at.alias("started_at"))
    rows = F.array_compact(F.array(
        F.when(F.col("state") == 2, row(1, "$workflow_completion$", F.col("completed_at"))), F.when(F.col("state") == 3, row(2, "$workflow_failure$7", F.col("updated_at"))),
        F.when(_mod(k, 4) == 0, row(4, "$workflow_retry$2", seconds_after(begun, F.lit(20)))), F.when(_mod(k, 4) == 0, row(3, "$workflow_failure$5", seconds_after(begun, F.lit(10)))),
        F.when(_mod(k, 13) == 0, row(5, "$workflow_retry$1", seconds_after(begun, F.lit(-5)))), F.when(_mod(k, 13) == 0, row(6, "$workflow_odd$1", begun)),
    ))
    return wf.select(F.inline(rows))


def lock_touches(logs: DataFrame) -> DataFrame:
    """``workflow_id``, ``owner``, ``at``: who held a workflow's lock when a step began; every fifth step was another's."""
    k = F.col("id")
    owner = F.concat(F.lit("worker-"), F.when(_mod(k, 5) == 0, _mod(k, 7)).otherwise(_mod(F.col("workflow_id"), 7)).cast("string"))
    return logs.select("workflow_id", owner.alias("owner"), F.col("started_at").alias("at"))


def seals(wf: DataFrame) -> DataFrame:
    """``branch_id``, ``sealed_at``: when the last child of a branch was dispatched; none of every seventh, which goes on."""
    at = F.when(_mod(F.col("branch_id"), 7) != 0, F.col("last"))
    return wf.where(F.col("parent_execution_log_id").isNotNull()).groupBy(F.col("parent_execution_log_id").alias("branch_id")).agg(F.max("created_at").alias("last")).select("branch_id", at.alias("sealed_at"))


def polled_branches(logs: DataFrame, health: DataFrame) -> DataFrame:
    """The logs of two in three branches with the last poll in their metadata: it saw a little more pending than there is now (``health``).

    Some times are in UTC and some have an offset; a branch that goes on has no number spawned, and one that is done no next poll.
    """
    k, now = F.col("branch_id"), now_at(NOW)
    sealed, pending = _mod(k, 7) != 0, F.least("spawned", F.col("pending") + _mod(k, 3))
    at, interval = seconds_after(now, -_mod(k, 600)), 5 + _mod(k, 296)
    text = lambda t: F.when(_mod(F.floor(k / 1000), 2) == 0, iso(t)).otherwise(F.concat(F.date_format(seconds_after(t, F.lit(7200)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    rate = _mod(k, 9) * 0.125
    poll = {
        "last_polled_at": text(at), "next_poll_at": F.when(~sealed | (pending > 0), text(seconds_after(at, interval))), "pending": pending, "never_started": F.least(pending, F.col("never_started") + _mod(k, 2)), "spawned": F.when(sealed, F.col("spawned")),
        "sealed": sealed, "rate": rate, "eta_seconds": F.when(rate > 0, F.round(pending / rate)).cast("bigint"), "polls": 1 + _mod(k, 12), "rekick_total": _mod(k, 4),
    }
    metadata = F.to_json(F.struct(F.struct(*(v.alias(c) for c, v in poll.items())).alias("poll")))
    polls = health.where(_mod(k, 3) != 0).select(k.alias("id"), metadata.alias("metadata"))
    return logs.where(F.col("step_name").startswith("branch$")).drop("metadata").join(polls, "id")


def poll_tokens(wf: DataFrame, rotated_at: int = 4) -> DataFrame:
    """``branch_id``, ``token``, ``rotated_at`` (the number of a poll): every branch's first poller, and the one that replaced it."""
    branches = wf.where(F.col("parent_execution_log_id").isNotNull()).select(F.col("parent_execution_log_id").alias("branch_id")).distinct()
    return branches.select("branch_id", F.inline(F.array(*(F.struct(F.lit(t).alias("token"), F.lit(at).alias("rotated_at")) for t, at in (("first", 0), ("second", rotated_at))))))


def poll_owners(polled: DataFrame, rotated_at: int = 4) -> DataFrame:
    """Polls with the token of the poller that made them: the first poller of some branches goes on for a while after it was replaced."""
    late = (F.col("poll") < rotated_at) | ((F.col("poll") < rotated_at + 2) & (_mod(F.col("branch_id"), 300) == 98))
    return polled.withColumn("token", F.when(late, "first").otherwise("second"))


#: Nodes of the definition that the derived workflows follow: (node, kind, step name, prefix of names known at run time).
DEFINITION = (
    ("n1", "branch", "branch$fulfil", None), ("n2", "merge", "merge$fulfil", None), ("n3", "repeat", "durably_repeat$sync_job", None), ("n4", "execute", "durably_execute$s1", None),
    ("n5", "wait", "wait_until$c2", None), ("n6", "dynamic", None, "durably_execute$"), ("n7", "dynamic", None, "durably_execute$"), ("n8", "dynamic", None, "wait$"),
    ("n9", "dynamic", None, "wait$w1"), ("n10", "dynamic", None, "wait$"),
)


#: Its edges: (from, to, kind, guard); ``start``, ``halt`` and ``done`` are no nodes.
EDGES = (("start", "n1", "sequence", None), ("n1", "n2", "sequence", None), ("n2", "n3", "guard", "merged?"), ("n2", "halt", "guard", "failed?"), ("n3", "n4", "sequence", None), ("n4", "n5", "sequence", None), ("n5", "n6", "loop", "again"), ("n10", "done", "sequence", None))


def definition(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the definition as tables, labelled by their steps."""
    nodes = [("fulfilment", k, node, step or f"{prefix}…", kind, step) for k, (node, kind, step, prefix) in enumerate(DEFINITION)]
    edges = [("fulfilment", k, *e) for k, e in enumerate(EDGES)]
    return spark.createDataFrame(nodes, "definition string, place long, node string, label string, kind string, step_name string"), spark.createDataFrame(edges, "definition string, place long, source string, target string, kind string, guard string")


#: Classes of errors and their parents: one has two, two are each other's, and one stands below no standard error.
ERROR_CLASSES = (
    ("Err0", "NetworkError"), ("NetworkError", "IOError"), ("IOError", "StandardError"), ("Err1", "NetworkTimeout"), ("NetworkTimeout", "NetworkError"), ("NetworkTimeout", "TimeoutError"), ("TimeoutError", "StandardError"),
    ("Err2", "StrictError"), ("StrictError", "StandardError"), ("Err3", "Odd"), ("Odd", "Even"), ("Even", "Odd"), ("StandardError", "Exception"), ("Err4", "SystemFailure"), ("SystemFailure", "Exception"),
)


def error_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERROR_CLASSES, "class string, parent string")


def error_logs(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.where(F.col("event_type") == "error").select(
        (e + 1).alias("id"), (e + 1).alias("workflow_id"), F.when(_mod(e, 3) != 0, F.concat(F.lit("durably_execute$s"), _mod(e, 7).cast("string"))).alias("step_name"),
        (1 + _mod(e, 3)).cast("int").alias("attempt"), F.when(_mod(e, 50) != 0, F.concat(F.lit("Err"), _mod(e, 5).cast("string"))).alias("error_class"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


def derive(spark: SparkSession, folder: str) -> History:
    orders, lineitem, events = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("orders", "lineitem", "events"))
    return History(workflows(orders), execution_logs(orders, lineitem), error_logs(events))
