"""A definition's nodes with what the runs of a workflow made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.steps import LOG_COMPLETED, framework_step, of_kinds

#: Status by state of a log: pending, completed, failed.
STATUS = ("active", "done", "failed")


def _status(state: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in STATUS)), state)


@dataclass(frozen=True)
class Node:
    """A node of a definition; ``step_name`` is none where it is known at run time alone, by its ``prefix``."""

    node: str
    kind: str
    step_name: str | None = None
    prefix: str | None = None


def _listed(rows: list[tuple], schema: str) -> Column:
    """Rows as an array of structs, for ``inline``: a definition has few."""
    names = [c.split()[0] for c in schema.split(", ")]
    structs = (F.struct(*(F.lit(x).alias(n) for x, n in zip(r, names))) for r in rows)
    return F.array(*structs).cast(f"array<struct<{', '.join(':'.join(c.split()) for c in schema.split(', '))}>>")


def overlay(nodes: list[Node], logs: DataFrame, branches: DataFrame) -> DataFrame:
    """Status of every node in every workflow that has logs, and the logs that no node stands for."""
    return named_overlay(nodes, logs, branches).drop("log_name", "counts")


def named_overlay(nodes: list[Node], logs: DataFrame, branches: DataFrame) -> DataFrame:
    """``overlay`` with the step names of the logs that nodes were bound to in ``log_name``, and with ``counts`` (text) of logs that have it.

    ``nodes`` are one definition's.  ``branches`` is ``branch_health``.

    * Named nodes go by the log of that name; branches by their children; repeats are
      done or active, with the number of their runs.
    * Dynamic nodes take, one after the other in the definition's order, the first log whose
      name begins with their prefix and that neither a named node nor a dynamic one before
      them has.  Prefixes may overlap.
    * Completed logs that stay without a node are ``unmapped``; the engine's own are left out.
    """
    named = _listed([(x.node, x.kind, x.step_name) for x in nodes if x.step_name is not None], "node string, kind string, step_name string")
    dynamic = _listed([(x.node, x.prefix) for x in nodes if x.step_name is None and x.prefix is not None], "node string, prefix string")
    runs = logs.select("workflow_id").distinct()
    counts = F.col("counts") if "counts" in logs.columns else F.lit(None).cast("string").alias("counts")
    found = logs.select("workflow_id", "step_name", F.col("id").alias("log_id"), "state", counts)
    names = [x.step_name for x in nodes if x.step_name is not None]
    health = branches.select(F.col("branch_id").alias("log_id"), F.col("status").alias("fanout"))
    repetitions = of_kinds(logs, "repeat_run").select("workflow_id", F.concat(F.lit("durably_repeat$"), "step").alias("step_name")).groupBy("workflow_id", "step_name").agg(F.count("*").alias("n"))
    # What belongs to logs is joined with the logs of named nodes, which are fewer than such nodes of all runs.
    reached = found.where(F.col("step_name").isin(names)).join(health, "log_id", "left").join(repetitions, ["workflow_id", "step_name"], "left")
    at = runs.select("workflow_id", F.inline(named)).join(reached, ["workflow_id", "step_name"], "left")
    status = F.when(F.col("log_id").isNull(), "not_reached").when(F.col("kind") == "branch", F.coalesce("fanout", F.lit("not_reached"))).when(F.col("kind") == "repeat", F.when(F.col("state") == LOG_COMPLETED, "done").otherwise("active")).otherwise(_status(F.col("state")))
    known = at.select("workflow_id", "node", "log_id", status.alias("status"), F.when((F.col("kind") == "repeat") & F.col("log_id").isNotNull(), F.coalesce("n", F.lit(0))).alias("repetitions"), F.when(F.col("log_id").isNotNull(), F.col("step_name")).alias("log_name"), "counts")

    free = found.where(~F.col("step_name").isin(names) & ~framework_step(F.col("step_name")))
    bound = _bound(runs, free, dynamic, sorted({x.prefix for x in nodes if x.step_name is None and x.prefix is not None}), sum(x.step_name is None for x in nodes))
    unseen = [x.node for x in nodes if x.step_name is None and x.prefix is None]
    bound = bound.unionByName(runs.select("workflow_id", F.explode(F.array(*map(F.lit, unseen)).cast("array<string>")).alias("node"), F.lit(None).cast("bigint").alias("log_id"), F.lit(None).cast("string").alias("log_name"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("counts")))
    rest = free.where(F.col("state") == LOG_COMPLETED).join(bound.where("log_id is not null").select("workflow_id", "log_id"), ["workflow_id", "log_id"], "left_anti")
    unmapped = rest.select("workflow_id", F.concat(F.lit("log-"), F.col("log_id").cast("string")).alias("node"), "log_id", F.lit("unmapped").alias("status"), F.lit(None).cast("bigint").alias("repetitions"), F.col("step_name").alias("log_name"), "counts")
    bound = bound.select("workflow_id", "node", "log_id", F.coalesce(_status(F.col("state")), F.lit("not_reached")).alias("status"), F.lit(None).cast("bigint").alias("repetitions"), "log_name", "counts")
    return known.unionByName(bound).unionByName(unmapped)


def _bound(runs: DataFrame, free: DataFrame, dynamic: Column, prefixes: list[str], most: int) -> DataFrame:
    """``workflow_id``, ``node``, ``log_id``, ``log_name``, ``state``, ``counts`` of the dynamic nodes in every run: a fold over the nodes that keeps what is taken.

    A node finds its log among the first ``most`` of its prefix, as there are no more nodes
    to take one before it; so a run's candidates are few, however many logs it has.
    """
    log = "struct<log_id:bigint,step_name:string,state:int,counts:string>"
    state = f"struct<taken:array<bigint>,out:array<struct<node:string,log:{log}>>>"
    fits = F.filter(F.array(*map(F.lit, prefixes)).cast("array<string>"), lambda p: F.startswith(F.col("step_name"), p))
    nth = F.row_number().over(Window.partitionBy("workflow_id", "prefix").orderBy("log_id"))
    first = free.select("workflow_id", "log_id", "step_name", F.col("state").cast("int").alias("state"), "counts", F.explode(fits).alias("prefix")).withColumn("nth", nth).where(F.col("nth") <= most)
    candidates = first.groupBy("workflow_id").agg(F.array_sort(F.collect_set(F.struct("log_id", "step_name", "state", "counts"))).alias("logs"))

    def take(a: Column, x: Column) -> Column:
        found = F.filter("logs", lambda y: F.startswith(y["step_name"], x["prefix"]) & ~F.array_contains(a["taken"], y["log_id"]))
        one = F.transform(F.slice(found, 1, 1), lambda y: F.struct(F.concat(a["taken"], F.array(y["log_id"])).alias("taken"), F.array_append(a["out"], F.struct(x["node"].alias("node"), y.alias("log"))).alias("out")).cast(state))
        return F.coalesce(F.get(one, F.lit(0)), F.struct(a["taken"].alias("taken"), F.array_append(a["out"], F.struct(x["node"].alias("node"), F.lit(None).cast(log).alias("log"))).alias("out")).cast(state))

    start = F.struct(F.array().alias("taken"), F.array().alias("out")).cast(state)
    folded = runs.join(candidates, "workflow_id", "left").withColumn("logs", F.coalesce("logs", F.array().cast(f"array<{log}>"))).select("workflow_id", F.inline(F.aggregate(dynamic, start, take, lambda a: a["out"])))
    return folded.select("workflow_id", "node", "log.log_id", F.col("log.step_name").alias("log_name"), "log.state", "log.counts")
