"""Reading on from where a reader stopped, and writing once: resumable sources and idempotent sinks as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.sources.history import SCHEMAS
from runlens.sources.shared import remove_folder, saved


def after_key(rows: DataFrame, key: str, cursor: int | None) -> DataFrame:
    """Rows from a primary key on, the cursor's own row included: the row after which a reader was cut off may come again.

    A range of the key, which a scan skips files by; no order is imposed.
    """
    return rows if cursor is None else rows.where(F.col(key) >= cursor)


def after_count(rows: DataFrame, order: list[str], done: int) -> DataFrame:
    """Rows without the first ``done`` in an order that is total, numbered from 0 as ``n``.

    Numbers without a single sorted task: rows are range-partitioned, sorted and saved
    with the number of their partition, and each partition's numbers begin where those
    before it end.  Saved, as ranges drawn once more could differ.
    """
    ordered = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_c"))  # a row per partition
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ordered.withColumn("_w", within).join(F.broadcast(offsets), "_p").withColumn("n", F.col("_before") + F.col("_w") - 1).where(F.col("n") >= done).drop("_p", "_w", "_before")


def children(source: DataFrame, key: Column, parent_key: Column, branch: str, spawn: str) -> DataFrame:
    """``source`` with ``child_key``: the key of the child that each row spawns, unique by parent, branch, spawn and row."""
    return source.withColumn("child_key", F.concat_ws("$", parent_key, F.lit(branch), F.concat_ws("_", F.lit(spawn), key.cast("string"))))


def insert_missing(existing: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``new`` that a bulk insert adds: one for each key that isn't there yet, so that a repeated batch adds nothing.

    Of rows with equal keys the least comes in.
    """
    rest = [c for c in new.columns if c not in by]
    one = new.groupBy(*by).agg(F.min(F.struct(*rest)).alias("x")).select(*by, "x.*") if rest else new.distinct()
    return one.select(new.columns).join(existing.select(*by), by, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``existing`` with changes applied: by key the row latest by ``order`` stays, and on ties a change wins over what is there."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in by]
    latest = both.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new", *(c for c in rest if c not in order))).alias("x"))
    return latest.select(*by, "x.*").select(existing.columns)


def contended(wf: DataFrame, now: Column, most_seconds: int = 600) -> DataFrame:
    """Workflows that another runner may not take: executable, and locked within the longest time a run may hold its lock."""
    return wf.where(F.col("state").isin(0, 1) & (F.col("locked_at") > F.timestamp_add("SECOND", F.lit(-most_seconds), now)))


def delete_expired(spark: SparkSession, folder: str, expired: Callable[[DataFrame], Column], partition: str = "month") -> dict[str, int]:
    """Delete workflows of which ``expired`` holds from a history kept as Parquet below ``folder``, with their logs and errors.

    ``workflows``, ``execution_logs`` and ``error_logs`` are tables partitioned by the text ``partition``.  Children of deleted workflows that stay lose their parent in the
    same pass.  Only partitions with a row that goes or changes are written anew;
    the others' files stay as they are.  New rows are saved before any partition is replaced.
    Logs and errors go first, so that a pass which stops in between finds the same workflows
    again.  Returns the rows deleted by table and the children cleared.
    """
    wf, logs, errors = (spark.read.schema(f"{schema}, {partition} string").parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items())
    gone = saved(wf.where(F.coalesce(expired(wf), F.lit(False))).select(F.col("id").alias("_gone")), "gone")
    orphaned = saved(logs.join(gone, logs["workflow_id"] == F.col("_gone"), "left_semi").select(F.col("id").alias("_log")), "orphaned")
    counts = {"workflows": gone.count()}
    for name, table in (("execution_logs", logs), ("error_logs", errors)):
        marked = table.join(gone, table["workflow_id"] == F.col("_gone"), "left").withColumn("_hit", F.col("_gone").isNotNull()).drop("_gone")
        counts[name] = _rewritten(marked, F.lit(False), f"{folder}/{name}", partition)[0]
    marked = wf.join(gone, wf["id"] == F.col("_gone"), "left").withColumn("_hit", F.col("_gone").isNotNull()).drop("_gone")
    marked = marked.join(orphaned, marked["parent_execution_log_id"] == F.col("_log"), "left").withColumn("_cleared", F.col("_log").isNotNull() & ~F.col("_hit"))
    marked = marked.withColumn("parent_execution_log_id", F.when(F.col("_log").isNull(), F.col("parent_execution_log_id"))).drop("_log")
    counts["orphaned_children"] = _rewritten(marked, F.col("_cleared"), f"{folder}/workflows", partition)[1]
    return counts


def _rewritten(marked: DataFrame, changed: Column, path: str, partition: str) -> tuple[int, int]:
    """Replace the partitions of ``marked`` that have a ``_hit`` (a row that goes) or a changed row; returns how many there were of both."""
    spark = marked.sparkSession
    d = marked.withColumn("_changed", changed)
    touched = saved(d.where("_hit or _changed").groupBy(F.col(partition).alias("_part")).agg(F.count_if("_hit").alias("hits"), F.count_if("_changed").alias("changes")), "touched")
    hits, changes = touched.agg(F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("changes"), F.lit(0))).first()
    if hits or changes:
        columns = [c for c in d.columns if c not in ("_hit", "_changed", "_cleared")]
        kept = saved(d.join(touched, F.col(partition).eqNullSafe(F.col("_part")), "left_semi").where(~F.col("_hit")).select(*columns), "kept")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        left = kept.select(partition).distinct()
        empty = [r._part for r in touched.join(left, F.col("_part").eqNullSafe(F.col(partition)), "left_anti").collect()]  # one row for each partition that lost all
        for value in empty:
            remove_folder(spark, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
    return hits, changes
