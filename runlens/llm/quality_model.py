"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a whole text go through cosines of random projections, which
approximate a Gaussian kernel.  Every partition sums its share of the normal
equations; the sums have a fixed size, whatever the corpus.  They are kept by fold,
so that the rows of a fold get scores from weights that never saw them; these scores
calibrate the ridge score by pooled adjacent violators over a fixed grid of bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, FILE_EDGES, saved, without

#: Random features, ridge penalty per row, seed, kernel width in standard deviations of the statistics, bins of the calibration.
FEATURES, PENALTY, SEED, WIDTH, BINS = 160, 1e-5, 17, 3.0, 400
#: Score range that the calibration's bins cover.
LOW, HIGH = -0.5, 1.5
#: Folds of the rows, by a hash of their id, for the scores that the calibration sees.
FOLDS = 5
#: Tasks that add up the partitions' sums before the driver adds these.
SUM_TASKS = 4

#: Classes of bytes whose shares of a text are statistics.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#*$%&", b"<>{}[]()=;:_/\\@+", bytes(range(0x80, 0x100)))
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c)] = _k
N_STATS = len(CLASSES) + 9


def statistics(text: bytes) -> np.ndarray:
    """Fixed statistics of one whole text in UTF-8; an empty text has zeros."""
    out = np.zeros(N_STATS, np.float32)
    if not text:
        return out
    counts = np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    letters = max(1, counts[0] + counts[1])
    k = len(CLASSES)
    out[:k] = np.sqrt(counts / len(text))
    out[k] = np.log1p(len(text)) / 5
    out[k + 1] = np.log1p(len(words)) / 5
    out[k + 2] = min(4.0, sum(map(len, words)) / n / 5)
    out[k + 3] = len(set(words)) / n
    out[k + 4] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[k + 5] = len(set(lines)) / len(lines)
    out[k + 6] = np.log1p(n / len(lines)) / 3
    out[k + 7] = counts[1] / letters
    out[k + 8] = sum(not w[-1:].isalnum() and w[-1] < 0x80 and w[-1:] not in b".,?" for w in words) / n
    return out


def _statistic_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [statistics(x.as_py() or b"") for x in part.column(part.num_columns - 1).cast(pa.binary())]
            flat = pa.array(np.concatenate(rows), pa.float32())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_STATS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], stats], [*part.schema.names[:-1], "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``stats`` (array of float) per row; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_statistic_batches, "id long, stats array<float>")


@dataclass
class Model:
    """A fitted classifier; small, of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    grid: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = (stats - self.mean) / self.scale
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1, between 0 and 1."""
        if not len(self.grid):
            return np.full(len(stats), self.level[0])
        return np.clip(np.interp(self.raw(stats), self.grid, self.level), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS).astype(np.float64)


def _summed(rows: DataFrame, function, size: int) -> np.ndarray:
    """Sum of ``function(stats, labels, folds)``, an array of ``size`` doubles, over all rows: by partition, by task, then here."""

    def partial(batches):
        total = np.zeros(size)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                total += function(_matrix(b.column(0)), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    sums = rows.mapInArrow(partial, "total binary").repartition(SUM_TASKS).mapInArrow(add, "total binary").collect()
    return sum((np.frombuffer(r.total) for r in sums), np.zeros(size))


def pooled(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least-squares fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks])


def fit(rows: DataFrame) -> Model:
    """Fit to ``rows``: ``id``, ``stats``, ``label`` (0 to 1; null: left out).

    All rows count; none are sampled.  Without rows every score is 0.5, and with
    one label alone every score is that label.
    """
    rows = rows.where("label is not null").select("stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"))
    moments = _summed(rows, lambda x, y, _: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * N_STATS)
    n, positive = moments[:2]
    none = np.zeros(0)
    if n == 0 or positive in (0, n):
        return Model(none, none, none, none, none, none, np.array([positive / n if n else 0.5]))
    mean = moments[2 : 2 + N_STATS] / n
    spread = np.sqrt(np.maximum(moments[2 + N_STATS :] / n - mean**2, 0))
    rng = np.random.default_rng(SEED)
    model = Model(mean, np.where(spread > 1e-6, spread, 1.0), rng.normal(size=(N_STATS, FEATURES)) / (WIDTH * np.sqrt(2)), rng.uniform(0, 2 * np.pi, FEATURES), none, none, none)
    size = FEATURES + N_STATS + 1

    def normal(x, y, folds):
        z = model.features(x)
        parts = ((z[folds == k], y[folds == k]) for k in range(FOLDS))
        return np.concatenate([s for z, y in parts for s in ((z.T @ z).ravel(), z.T @ y)])

    sums = _summed(rows, normal, FOLDS * (size * size + size)).reshape(FOLDS, -1)
    solved = lambda part: np.linalg.solve(part[: size * size].reshape(size, size) + PENALTY * n * np.eye(size), part[size * size :])
    model.weights = solved(sums.sum(axis=0))
    unseen = np.stack([solved(sums.sum(axis=0) - sums[k]) for k in range(FOLDS)])

    def bins(x, y, folds):
        raw = (model.features(x) * unseen[folds]).sum(axis=1)
        at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    counts, ones = np.split(_summed(rows, bins, 2 * BINS), 2)
    full = counts > 0
    model.grid = (LOW + (np.arange(BINS) + 0.5) / BINS * (HIGH - LOW))[full]
    model.level = pooled(counts[full], ones[full] / counts[full])
    return model


def score_statistics(stats: DataFrame, model: Model, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``stats`` (``id``, ``stats``) scored: the columns of bigint to ``keep`` and ``score``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(_matrix(b.column(len(keep)))))], [*keep, "score"])

    return stats.select(*keep, "stats").mapInArrow(run, ", ".join([*(f"{c} long" for c in keep), "score double"]))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``score_col``, a double.

    A column that has that name already is replaced, the text itself included; other
    columns may have any names.  Null texts score as empty ones.  A text that stays goes to Python once.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(place).cast(pa.binary())
                scores = model.score(np.stack([statistics(x.as_py() or b"") for x in texts]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], pa.array(scores)], [*part.schema.names[:n_kept], score_col])

    kept = [f for f in docs.schema.fields if f.name.lower() != score_col.lower()]
    names = {f.name.lower() for f in kept}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{score_col}` double"])
    columns = [F.col(f"`{f.name}`") for f in kept]
    found = [k for k, f in enumerate(kept) if f.name == text_col and f.dataType.simpleString() == "string"]
    if not found:
        columns.append(F.col(text_col).cast("string").alias(next(name for name in (f"_scored{k}" for k in range(len(names) + 1)) if name not in names)))
    place, n_kept = (found or [len(kept)])[0], len(kept)
    return docs.select(*columns).mapInArrow(run, schema)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit to the statistics that have a label; an id that is labelled more than once counts once, by its mean label.

    Rows without an id have no label; rows that repeat an id count each.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    return fit(stats.join(marks, "id"))


def without_rejected(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``, by a model fitted to ``labels`` (as in ``train``).

    A text goes to Python once: its statistics, kept on the executors' disks until this
    returns, serve the fit and the score.  A score follows from the text alone, so the
    ids and hashes of the texts to go say which rows these are, nulls and repeated rows included.
    """
    doc_id, key = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.select(doc_id.alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    stats = texts.mapInArrow(_statistic_batches, "id long, key long, stats array<float>").persist(StorageLevel.DISK_ONLY)
    try:
        model = train(stats, labels)
        low = score_statistics(stats, model, ("id", "key")).where(F.col("score") < threshold).select(F.col("id").alias("_id"), F.col("key").alias("_key"))
        gone = saved(low.coalesce(max(1, -(-low.count() // FILE_EDGES))), "rejected")
    finally:
        stats.unpersist()
    return without(docs, gone, doc_id.eqNullSafe(gone["_id"]) & (key == gone["_key"]), broadcast_rows)
