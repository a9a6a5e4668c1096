"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Vectors become integers and are packed into tiles of ``TILE`` rows, in the order of
their labels.  Anchors are a stated query set; they form tiles of their own.  Anchor
and candidate tiles meet in cells of bounded size: a tile goes to every cell of its
group, by an equi-join of group numbers.  Within a cell tiles are multiplied by
Strassen's recursion, padded with zeros to even sizes.  All additions are exact on
64-bit integers.

First only tiles that share a label meet, for the positives: a heap keeps the first
few of every anchor, heaps of tiles merge, and those of cells merge once more.
Positives give each anchor its windows of scores; then all tiles meet, and a heap for
every window keeps its first few rows of other labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows of a tile; anchor and candidate tiles of a cell; size at which the recursion ends.
TILE, ANCHOR_TILES, CANDIDATE_TILES, LEAF = 512, 8, 16, 16
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's: least and most.
WINDOW = (50, 95)
#: What stands for a missing id, so that it comes last of equal scores.
_NO_ID = np.iinfo(np.int64).max
_TILE = "tile long, n int, width int, bytes int, labels binary, ids binary, rows binary, values binary, kinds array<long>"
_HEAP = "tile long, anchor_row long, anchor_id long, id long, score long, row long"
_NEGATIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, id long, score long, row long"


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of small integer matrices: in floating point where every sum fits its 53 bits, else on integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 1 << 52 else a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two matrices of 64-bit integers with seven products of halves for each, down to ``leaf``."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return _product(a, b)
    a, b = np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2)))
    x, y, z = (n + 1) // 2, (k + 1) // 2, (m + 1) // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), np.int64)
    out[:x, :z], out[:x, z:], out[x:, :z], out[x:, z:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


@dataclass
class Heaps:
    """For every key the first ``most`` of what was seen: highest scores first, then smallest ids, then rows."""

    most: int
    key: np.ndarray
    score: np.ndarray
    id: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, most: int, *parts: Heaps) -> Heaps:
        """Heaps merged into one."""
        if not parts:
            return cls(most, *(np.zeros(0, np.int64) for _ in range(4)))
        key, score, ids, row = (np.concatenate([getattr(p, name) for p in parts]) for name in ("key", "score", "id", "row"))
        order = np.lexsort((row, ids, ~score, key))  # ~score falls as the score rises, for every integer
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else key
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        kept = order[rank < most]
        return cls(most, key[rank < most], score[kept], ids[kept], row[kept])


@dataclass
class Tile:
    """Rows of a tile by ascending id, so that of equal scores the first comes first."""

    label: np.ndarray
    id: np.ndarray
    row: np.ndarray
    value: np.ndarray

    @classmethod
    def read(cls, r: dict, width: int) -> Tile:
        label, ids, row = (np.frombuffer(r[name], np.int64) for name in ("labels", "ids", "rows"))
        value = np.frombuffer(r["values"], f"<i{r['bytes']}").reshape(r["n"], r["width"]).astype(np.int64)
        order = np.lexsort((row, ids))
        return cls(label[order], ids[order], row[order], np.pad(value, ((0, 0), (0, width - r["width"])))[order])


def _pack(batches):
    """Tiles of consecutive rows, in the smallest integers that hold their components; shorter vectors end with zeros."""
    at, k, none = [], 0, pa.RecordBatch.from_pydict({c.split()[0]: [] for c in _TILE.split(", ")}, schema=_schema(_TILE))

    def tile(rows: list[tuple]):
        nonlocal k
        width = max(len(r[3]) for r in rows)
        values = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            values[i, : len(r[3])] = r[3]
        most = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
        size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        label, ids, row = (np.array([r[c] for r in rows], np.int64).tobytes() for c in range(3))
        k += 1
        return pa.RecordBatch.from_pylist([{"tile": TaskContext.get().partitionId() << 32 | k - 1, "kinds": sorted({r[0] for r in rows}), "n": len(rows), "width": width, "bytes": size, "labels": label, "ids": ids, "rows": row, "values": values.astype(f"<i{size}").tobytes()}], schema=_schema(_TILE))

    for batch in batches:
        ids = batch.column("vec_id").fill_null(int(_NO_ID)).to_pylist()
        at += zip(batch.column("label").to_pylist(), ids, batch.column("row").to_pylist(), batch.column("q").to_pylist())
        while len(at) >= TILE:
            yield tile(at[:TILE])
            at = at[TILE:]
    yield tile(at) if at else none


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _table(ddl: str, columns: np.ndarray) -> pa.Table:
    return pa.table([pa.array(c, pa.int64(), mask=c == _NO_ID if name.endswith("id") else None) for c, name in zip(columns, _schema(ddl).names)], schema=_schema(ddl))


def _cell(anchors: pa.Table, candidates: pa.Table, alike: bool):
    """Every anchor tile of a cell with the candidate tiles that share a label with it (``alike``), or have another one, and their product."""
    left, right = anchors.to_pylist(), candidates.to_pylist()
    width = max([r["width"] for r in left + right], default=0)
    tiles = [Tile.read(r, width) for r in right]
    kinds = [np.unique(b.label) for b in tiles]
    for r in left:
        a = Tile.read(r, width)
        own = np.unique(a.label)
        met = lambda k: len(np.intersect1d(own, k)) > 0 if alike else len(np.union1d(own, k)) > 1
        yield r, a, ((b, strassen(a.value, np.ascontiguousarray(b.value.T))) for b, k in zip(tiles, kinds) if met(k))


def _positives(key, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    out = [np.zeros((6, 0), np.int64)]
    for r, a, products in _cell(anchors, candidates, True):
        merged = Heaps.of(POSITIVES)
        for b, scores in products:
            i, j = np.nonzero((a.label[:, None] == b.label[None, :]) & (a.row[:, None] != b.row[None, :]))
            merged = Heaps.of(POSITIVES, merged, Heaps(POSITIVES, i, scores[i, j], b.id[j], b.row[j]))
        out.append(np.stack([np.full(len(merged.key), r["tile"]), a.row[merged.key], a.id[merged.key], merged.id, merged.score, merged.row]))
    return _table(_HEAP, np.concatenate(out, axis=1))


def _negatives(key, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    """Anchor tiles have ``windows``: their rows' positives."""
    out = [np.zeros((8, 0), np.int64)]
    for r, a, products in _cell(anchors, candidates, False):
        owner, positive, score, row = (np.array([_NO_ID if w[name] is None else w[name] for w in r["windows"]], np.int64) for name in ("anchor_row", "id", "score", "row"))
        by_row = np.argsort(a.row)
        place = by_row[np.searchsorted(a.row[by_row], owner)]
        low, high = _bounds(score)
        merged = Heaps.of(NEGATIVES)
        for b, scores in products:
            other = a.label[:, None] != b.label[None, :]
            # Rows of the anchor's label go behind all others; the sort is stable, so equal scores stay by id.
            by_score = np.lexsort((~scores, ~other), axis=1)
            ordered, n_other = np.take_along_axis(scores, by_score, 1)[place], other.sum(axis=1)[place]
            ahead = ((ordered > high[:, None]) & (np.arange(ordered.shape[1]) < n_other[:, None])).sum(axis=1)
            for at in (ahead + step for step in range(NEGATIVES)):
                found = ordered[np.arange(len(place)), np.minimum(at, ordered.shape[1] - 1)]
                of = np.flatnonzero((at < n_other) & (found >= low) & (found <= high))
                j = by_score[place[of], at[of]]
                merged = Heaps.of(NEGATIVES, merged, Heaps(NEGATIVES, of, found[of], b.id[j], b.row[j]))
        k = merged.key
        out.append(np.stack([owner[k], a.id[place[k]], row[k], positive[k], score[k], merged.id, merged.score, merged.row]))
    return _table(_NEGATIVE, np.concatenate(out, axis=1))


def _bounds(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score of a window, on integers of any size; none fits where the most is below the least."""
    exact = [(-(-WINDOW[0] * s // 100), WINDOW[1] * s // 100) for s in score.tolist()]
    return tuple(np.array([x[k] for x in exact], np.int64) for k in (0, 1))


def _first(heaps: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of every key over all cells; tasks keep no more than that before they shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _grouped(tiles: DataFrame, per_group: int) -> tuple[DataFrame, int]:
    """Tiles with the group they fall to in their order, and the number of groups."""
    # A row for each task that wrote tiles; a task numbers its own from 0 on.
    sizes = sorted(tiles.groupBy(F.shiftright("tile", 32).alias("part")).agg(F.count("*").alias("n")).collect())
    before = list(accumulate((r.n for r in sizes), initial=0))
    starts = tiles.sparkSession.createDataFrame([(r.part, n) for r, n in zip(sizes, before)], "part long, before long")
    at = F.col("before") + F.col("tile").bitwiseAND(F.lit((1 << 32) - 1))
    placed = tiles.join(F.broadcast(starts), F.shiftright("tile", 32) == F.col("part"))
    return placed.withColumn("group", F.floor(at / per_group).cast("int")).drop("part", "before"), max(1, -(-before[-1] // per_group))


def _met(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """Tiles of every cell (``own``, ``other``) that has both."""
    ends = lambda d, *names: d.select(*(F.col(c).alias(n) for c, n in zip(("own", "other"), names)), *(c for c in d.columns if c not in ("own", "other", "group")))
    return ends(left, "a", "b").groupBy("a", "b").cogroup(ends(right, "c", "d").groupBy("c", "d")).applyInArrow(work, schema)


def mine(vectors: DataFrame, anchor: Column | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Hard negatives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` are rows with an id, a label and an array of numbers, of which each
    component x counts as ``floor(256 * x)``; anchors are those of which the condition
    ``anchor`` (on ``vec_id``) holds.  Rows with a null label, a null vector or any null
    or non-finite component take no part.  Shorter vectors count as ended with
    zeros.  Rows with a null id are never anchors, and come last of equal scores.
    Rows that repeat an id are rows of their own: an anchor's copy may be its positive,
    and a repeated anchor returns its rows as often as it comes.  Extra columns are
    ignored.  Scores are exact while they fit 64 bits.
    """
    anchor = F.col("vec_id") % 50 == 0 if anchor is None else anchor
    q = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(256.0) * x))
    fine = F.coalesce(F.forall(F.col(vector_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(F.col(label_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    pack = lambda d: saved(d.repartitionByRange("label", "vec_id", "row").sortWithinPartitions("label", "vec_id", "row").mapInArrow(_pack, _TILE), "tiles")
    (candidates, n_candidates), (anchors, n_anchors) = _grouped(pack(rows), CANDIDATE_TILES), _grouped(pack(rows.where(anchor)), ANCHOR_TILES)

    # Where a label is on both sides.  Tiles are in the order of labels, so most labels are in few groups.
    labels = lambda d, name: d.select(F.col("group").alias(name), F.explode("kinds").alias("label")).distinct()
    cells = saved(labels(anchors, "of_anchors").join(labels(candidates, "of_candidates"), "label").select("of_anchors", "of_candidates").distinct(), "cells")
    cell = (F.col("of_anchors").alias("own"), F.col("of_candidates").alias("other"))
    found = _met(anchors.join(cells, F.col("group") == F.col("of_anchors")).select(*anchors.columns, *cell), candidates.join(cells, F.col("group") == F.col("of_candidates")).select(*candidates.columns, *cell), _positives, _HEAP)
    windows = _first(found, ["anchor_row"], POSITIVES).groupBy("tile").agg(F.collect_list(F.struct("anchor_row", "id", "score", "row")).alias("windows"))
    anchors = saved(anchors.join(windows, "tile"), "windows")

    # All rows against the anchors, which are a stated share of them: cell by cell.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    found = _met(anchors.select("*", F.col("group").alias("own"), every(n_candidates).alias("other")), candidates.select("*", every(n_anchors).alias("own"), F.col("group").alias("other")), _negatives, _NEGATIVE)
    return _first(found, ["anchor_row", "positive_row"], NEGATIVES).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
