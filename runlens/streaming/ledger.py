"""Sinks of streams that survive replays: batches in folders of their own, and a ledger of those that count.

A batch writes its rows first and its row of the ledger last.  One that stops in between
is run again by the stream and replaces its rows; one that is in the ledger
does nothing when it comes again.  Readers see batches of the ledger alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch long, delivered long, kept long, upto timestamp"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: a row for every batch that counts; none before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{folder}/ledger/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def rows(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Rows of the table ``name`` that batches of the ledger wrote, with the number of their ``batch``."""
    numbers = [r.batch for r in entries(spark, folder).select("batch").collect()]  # a number a batch
    if not numbers:
        return spark.createDataFrame([], f"{schema}, batch long")
    found = spark.read.schema(schema).parquet(*(f"{folder}/{name}/{k}" for k in numbers))
    return found.withColumn("batch", F.regexp_extract(F.input_file_name(), rf"/{name}/(\d+)/[^/]*$", 1).cast("long"))


def _committed(spark: SparkSession, folder: str, number: int) -> bool:
    return not entries(spark, folder).where(F.col("batch") == number).isEmpty()


def _commit(spark: SparkSession, folder: str, number: int, delivered: int, kept: int, upto) -> None:
    row = spark.createDataFrame([(number, delivered, kept, upto)], LEDGER)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/{number}")


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def insert_once(folder: str, keys: list[str], order: list[str], before_commit: Callable[[int], None] | None = None):
    """A function for ``foreachBatch``: rows whose ``keys`` no batch before inserted, and of a batch's rows of one key the first by ``order``.

    ``before_commit`` is called between the rows and the ledger (tests stop a run there).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _committed(spark, folder, number):
            return
        rest = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("x"), F.count("*").alias("_n"))
        there = rows(spark, folder, "rows", schema_of(batch)).select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        fresh = first.join(there, same, "left_anti").select(*(F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in batch.columns))
        fresh.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        written = spark.read.schema(schema_of(batch)).parquet(f"{folder}/rows/{number}")
        if before_commit:
            before_commit(number)
        _commit(spark, folder, number, batch.count(), written.count(), None)

    return write


def split_late(folder: str, at: str, delay: str):
    """A function for ``foreachBatch``: rows as they come to ``rows``, late ones to ``late``; both tables have the batch's columns.

    A row is late if its time ``at`` is before the largest of all batches before, less
    ``delay``: what a watermark would drop without a trace.  The ledger has the numbers of
    rows delivered and kept, observed while they are written, and the latest time.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _committed(spark, folder, number):
            return
        mark = entries(spark, folder).agg((F.max("upto") - F.expr(f"INTERVAL {delay}")).alias("mark")).first().mark
        late = F.lit(False) if mark is None else F.coalesce(F.col(at) < F.lit(mark), F.lit(False))
        seen = {name: Observation() for name in ("delivered", "rows", "late")}
        counted = (F.count(F.lit(1)).alias("n"), F.max(at).alias("upto"))
        marked = batch.observe(seen["delivered"], *counted).withColumn("_late", late).persist()
        try:
            for name, part in (("rows", ~F.col("_late")), ("late", F.col("_late"))):
                marked.where(part).drop("_late").observe(seen[name], *counted).write.mode("overwrite").parquet(f"{folder}/{name}/{number}")
        finally:
            marked.unpersist()
        upto = max((x for x in (seen["delivered"].get["upto"], mark) if x is not None), default=None)
        _commit(spark, folder, number, seen["rows"].get["n"] + seen["late"].get["n"], seen["rows"].get["n"], upto)

    return write


def run(stream: DataFrame, folder: str, write) -> None:
    """Run what is there through ``write`` and stop."""
    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
