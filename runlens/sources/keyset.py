"""A streaming source of tables that grow by ascending keys; its offset in a checkpoint is the last key that was read."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Readers run in executors and travel by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Group(InputPartition):
    """A row group of a file, and the keys to take from it: over ``low``, up to ``high``."""

    def __init__(self, file: str, group: int, low: int | None, high: int):
        self.file, self.group, self.low, self.high = file, group, low, high


class _Reader(DataSourceStreamReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path, self.key = options["path"], options["key"]

    def _groups(self):
        """File, number, and least and largest key of every row group: footers alone are read here."""
        import pyarrow.fs as pf
        import pyarrow.parquet as pq

        fs, root = pf.FileSystem.from_uri(self.path) if "://" in self.path else (pf.LocalFileSystem(), self.path)
        for info in fs.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True)):
            if not info.is_file or not info.path.endswith(".parquet"):
                continue
            meta = pq.read_metadata(info.path, filesystem=fs)
            place = meta.schema.names.index(self.key)
            for k in range(meta.num_row_groups):
                stats = meta.row_group(k).column(place).statistics
                if stats is not None and stats.has_min_max:  # a group of null keys has none
                    yield info.path, k, stats.min, stats.max

    def initialOffset(self):
        return {"key": None}

    def latestOffset(self):
        return {"key": max((high for *_, high in self._groups()), default=None)}

    def partitions(self, start, end):
        low, high = start["key"], end["key"]
        if high is None:
            return []
        return [_Group(file, k, low, high) for file, k, least, most in self._groups() if least <= high and (low is None or most > low)]

    def read(self, partition):
        import pyarrow.compute as pc
        import pyarrow.fs as pf
        import pyarrow.parquet as pq

        fs = pf.FileSystem.from_uri(self.path)[0] if "://" in self.path else pf.LocalFileSystem()
        found = pq.ParquetFile(partition.file, filesystem=fs)
        for batch in found.iter_batches(batch_size=4096, row_groups=[partition.group], columns=self.names):
            keys = batch.column(batch.schema.names.index(self.key))
            taken = pc.less_equal(keys, partition.high)
            yield batch.filter(taken if partition.low is None else pc.and_(taken, pc.greater(keys, partition.low))).select(self.names)

    def commit(self, end):
        pass


class KeysetSource(DataSource):
    @classmethod
    def name(cls):
        return "keyset"

    def schema(self):
        return self.options["schema"]

    def streamReader(self, schema):
        return _Reader(schema, self.options)


def by_key(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Rows of the Parquet files below ``path`` as a stream, each once, in steps of what is there when a batch begins.

    ``schema`` names the columns that are read, ``key`` (an integer) among them.  Rows that are added with keys over the
    last one come in a later batch, also after a restart; rows with keys up to it, or
    null, are not read any more.  The driver reads the files' footers, and every row group is a task's own.
    """
    spark.dataSource.register(KeysetSource)
    return spark.readStream.format("keyset").option("path", path).option("key", key).option("schema", schema).load()
