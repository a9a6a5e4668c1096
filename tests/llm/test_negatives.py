"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, row string, q int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (33, 64, 17), (64, 64, 64), (100, 37, 65), (3, 0, 4)])
def test_strassen(shape):
    n, k, m = shape
    rng = np.random.default_rng(n)
    for most in (4, 1 << 20, 1 << 40):
        a, b = rng.integers(-most, most, (n, k)), rng.integers(-most, most, (k, m))
        want = a.astype(object) @ b.astype(object) if k else np.zeros((n, m), object)
        if most < 1 << 40:
            assert (negatives.strassen(a, b, 4) == want.astype(np.int64)).all()
        else:  # exact on integers, modulo 2 ** 64
            assert (negatives.strassen(a, b, 4).astype(object) % (1 << 64) == want % (1 << 64)).all()


def test_heaps_merge_like_one():
    rng = np.random.default_rng(1)
    parts = [negatives.Heaps(3, *(rng.integers(0, 6, 40) for _ in range(3)), rng.integers(0, 1000, 40)) for _ in range(5)]
    one, merged = negatives.Heaps.of(3, *parts), negatives.Heaps.of(3)
    for p in parts:
        merged = negatives.Heaps.of(3, merged, p)
    assert all((getattr(one, c) == getattr(merged, c)).all() for c in ("key", "score", "id", "row"))


def brute(rows, anchor=lambda v: v % 50 == 0):
    kept = []
    for k, (vec_id, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, label, [math.floor(256 * x) for x in vector], k))
    order = lambda x: (-x[0], x[1] is None, x[1])
    out = []
    for vec_id, label, q, k in kept:
        if vec_id is None or not anchor(vec_id):
            continue
        scored = [(sum(x * y for x, y in zip(q, r[2])), r[0], r[1], r[3]) for r in kept if r[3] != k]
        for score, positive, _, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score), key=order)[:3]
            out += [(vec_id, positive, n, s[1], score, s[0]) for n, s in enumerate(fit, 1)]
    return out


def rows_of(n, seed, labels=4, width=9):
    rng = random.Random(seed)
    return [(k, [rng.choice([-0.5, 0.1, 0.25, 0.7, rng.random()]) for _ in range(width)], rng.choices(range(labels), [n, *[1] * (labels - 1)] if seed % 2 else None)[0]) for k in range(n)]


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(str, map(tuple, negatives.mine(df, **more).collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_mined(spark, monkeypatch, seed):
    for name, n in (("TILE", 16), ("ANCHOR_TILES", 2), ("CANDIDATE_TILES", 3), ("LEAF", 2)):
        monkeypatch.setattr(negatives, name, n)
    rows = rows_of(260, seed)
    assert mined(spark, rows, anchor=F.col("vec_id") % 5 == 0) == sorted(map(str, brute(rows, lambda v: v % 5 == 0)))


def test_odd_rows(spark):
    rows = rows_of(120, 4, 3, 5)
    rows += [(0, rows[0][1], rows[0][2]), (None, rows[7][1], 1), (None, rows[8][1], 0), (50, rows[50][1], 2), (900, [], 1), (901, rows[3][1][:2], 0), (902, rows[3][1] + [3.0], 0)]
    rows += [(950, None, 1), (1000, [1.0, None], 1), (1050, [float("nan")], 1), (1100, [float("inf"), 1.0], 2), (1150, rows[0][1], None), (100, [0.0] * 5, 1)]
    rows += [(2000 + k, rows[50][1], 1) for k in range(9)]
    assert mined(spark, rows) == sorted(map(str, brute(rows)))
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[1:40]) == []


def test_registered(spark, tmp_path):
    rows = rows_of(300, 6, 10)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    read = [tuple(r) for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).orderBy("vec_id").collect()]
    moved = [(v, x, (label + 1) % 10 if v % 7 == 0 else label) for v, x, label in read]
    assert sorted(map(tuple, queries.queries()["op12_hard_negatives"](spark, str(tmp_path)).collect())) == sorted(brute(moved))
