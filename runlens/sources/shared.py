"""Tables between jobs, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
#: Folders made, by open scope, the outermost first; it lasts as long as the program.
_scopes: list[list[str]] = [[]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the session has one.  Only on one machine
    (tests) a temporary folder stands in; a cluster's executors wouldn't see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-runlens-"))
    return _own_folder[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, for a table, an archive or a stream.

    ``released`` and ``release`` remove it once nothing reads it any more.
    """
    path = f"{shared_folder(spark)}/runlens-{name}-{uuid.uuid4().hex}"
    for folders in _scopes:
        folders.append(path)
    return path


def saved(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet, with options of its writer, to the shared folder and read it back.

    Cuts the lineage: what a lost executor had is read again, not computed again.
    """
    path = new_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder with all in it, wherever Spark can write; nothing happens if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        remove_folder(spark, path)
        for folders in _scopes:
            if path in folders:
                folders.remove(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Folders made within are removed at the end, with results that were not written elsewhere by then: write what is to stay first."""
    _scopes.append([])
    try:
        yield
    finally:
        _remove(spark, list(_scopes.pop()))


def release(spark: SparkSession) -> None:
    """Remove all folders that this program has made so far; DataFrames that read them can't be used any more."""
    _remove(spark, list(_scopes[0]))
