"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import runlens.llm as _package
from runlens.sources.shared import new_folder, saved, shared_folder  # noqa: F401

# Functions that run in executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(_package)

#: Most rows, of a few numbers each, that are broadcast to drop them from a corpus; edges that a file of a saved edge list has at most, about.
BROADCAST_ROWS, FILE_EDGES = 400_000, 100_000


def without(docs: DataFrame, gone: DataFrame, same: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that are the ``same`` as one in ``gone`` (a saved table, so that counting it is cheap).

    Up to ``most`` rows are broadcast, and no text moves; more are joined by shuffling both sides.
    """
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, same, "left_anti")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body, or a lambda in it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a running fold appends to before it begins another chunk; code points of a piece.
_CHUNK, PIECE = 256, 4096


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results (inclusive) of an associative ``step`` over an array of int whose neutral element is 0.

    Appending copies what is there, so one fold over all would take quadratic time:
    results run within chunks, and the chunks' ends over these.
    """
    none = F.array().cast("array<int>")

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda out, x: F.array_append(out, step(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)), x)))

    def chunked(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(_CHUNK))
        return let(F.transform(starts, lambda at: fold(F.slice(xs, at, F.lit(_CHUNK)))), lifted)

    def lifted(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))))
        return let(ends, lambda before: F.flatten(F.transform(parts, lambda p, k: let(F.coalesce(F.get(before, k - 1), F.lit(0)), lambda b: F.transform(p, lambda x: step(b, x))))))

    return let(values, lambda xs: F.when(F.size(xs) > 0, chunked(xs)).otherwise(none))


def pieces(text: Column) -> Column:
    """``text`` in pieces of ``PIECE`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in ``pieces``: time grows with the length, not with the start."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(parts, first + 1, F.floor(F.greatest(end - 1, start) / PIECE).cast("int") - first + 1)
    return F.when(end > start, F.substr(F.array_join(some, ""), start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def star(roots: DataFrame) -> DataFrame:
    """A link ``a``, ``b`` of every ``node`` with its ``root``: as few as connect what ``components`` has found."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list with columns ``a`` and ``b`` (bigint).

    Alternating large-star and small-star rounds: every round is a grouped
    minimum and a join, and the number of rounds grows with the logarithm of
    the longest chain.  A round has no more edges than the one before, so these say
    how many files it needs.  Returns ``node``, ``root`` (the smallest node it is
    linked with) for every node that has an edge to another node.
    """
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = saved(oriented, "edges"), None
    while True:
        seen = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before or seen[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = seen
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = saved(small.where("u <> v").distinct().coalesce(-(-seen[0] // FILE_EDGES)), "edges")
