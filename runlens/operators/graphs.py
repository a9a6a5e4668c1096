"""Definitions and runs as graphs: nodes with what runs made of them, endpoints, edges, and one JSON document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.steps import STATES


def child_counts(wf: DataFrame) -> DataFrame:
    """``log_id`` (of a branch), ``counts``: its children by state as JSON, states without any left out."""
    per_state = (F.nullif(F.count_if(F.col("state") == k), F.lit(0)).alias(name) for k, name in enumerate(STATES))
    d = wf.where("parent_execution_log_id is not null").groupBy(F.col("parent_execution_log_id").alias("log_id")).agg(*per_state)
    return d.select("log_id", F.to_json(F.struct(*STATES)).alias("counts"))


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``definition``, ``node``, ``place`` of ends of edges that are no nodes, in the order in which edges name them first."""
    ends = edges.select("definition", F.posexplode(F.array("source", "target")).alias("side", "node"), F.col("place").alias("edge"))
    first = ends.groupBy("definition", "node").agg(F.min(F.struct("edge", "side")).alias("place"))
    return first.join(nodes.select("definition", "node"), ["definition", "node"], "left_anti")


def _element(data: list[Column], classes: Column) -> Column:
    """One element's JSON; fields without a value are left out."""
    return F.to_json(F.struct(F.struct(*data).alias("data"), classes.alias("classes")))


def _listed(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The rows' ``element`` by key, in order, as the inside of a JSON list."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order, "element")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(sorted_, lambda x: x["element"]), ",").alias(name))


def documents(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """A JSON document of nodes and edges for every definition, or for every run of one.

    ``nodes`` has ``definition``, ``place``, ``node``, ``label``, ``kind``, ``step_name``; ``edges`` has
    ``definition``, ``place``, ``source``, ``target``, ``kind``, ``guard``.  ``found`` has ``definition``, ``workflow_id``,
    ``node``, ``status``, and, where there are any, ``repetitions``, ``counts`` (JSON), and of nodes that the definition
    lacks ``log_id`` and ``log_name``.  Nodes come in the definition's order, then those that it lacks
    by log, then endpoints; without ``found`` every node is ``not_reached``.  A document is as large as its graph.
    """
    keys = ["definition"] if found is None else ["definition", "workflow_id"]
    if found is None:
        rows = nodes.withColumns({"status": F.lit("not_reached"), "repetitions": F.lit(None).cast("bigint"), "counts": F.lit(None).cast("string"), "log_id": F.lit(None).cast("bigint"), "log_name": F.lit(None).cast("string")})
    else:
        rows = found.join(nodes, ["definition", "node"], "left")
    order = F.struct(F.col("place").isNull().alias("lacking"), F.coalesce("place", "log_id").alias("at")).alias("order")
    counts = F.from_json("counts", "struct<" + ",".join(f"{s}:bigint" for s in STATES) + ">").alias("counts")
    data = [F.col("node").alias("id"), F.coalesce("label", "log_name").alias("label"), F.coalesce("step_name", "log_name").alias("step_name"), F.col("repetitions"), counts]
    elements = rows.select(*keys, order, _element(data, F.concat(F.lit("kind-"), F.coalesce("kind", F.lit("unmapped")), F.lit(" status-"), "status")).alias("element"))
    drawn = _listed(elements, keys, "order", "nodes")
    ends = endpoints(nodes, edges).select("definition", F.col("place").alias("order"), _element([F.col("node").alias("id"), F.col("node").alias("label")], F.lit("kind-endpoint")).alias("element"))
    lines = edges.select("definition", F.col("place").alias("order"), _element([F.concat(F.lit("e"), F.col("place").cast("string")).alias("id"), "source", "target", F.coalesce("guard", F.lit("")).alias("label")], F.concat(F.lit("kind-"), "kind")).alias("element"))
    parts = drawn.join(_listed(ends, ["definition"], "order", "ends"), "definition", "left").join(_listed(lines, ["definition"], "order", "edges"), "definition", "left")
    inside = F.concat_ws(",", "nodes", "ends")
    return parts.select(*keys, F.concat(F.lit('{"nodes":['), inside, F.lit('],"edges":['), F.coalesce("edges", F.lit("")), F.lit("]}")).alias("document"))
