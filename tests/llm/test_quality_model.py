"""The quality classifier against dense numpy, and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import common, queries
from runlens.llm import quality_model as qm
from runlens.llm.common import id_remainder

FOLDER = "/root/testdata/sf0.001"


def isotonic(weight, mean):
    """Least squares under order, by the largest of all smallest means of what follows."""
    w, s = np.cumsum(np.append(0, weight)), np.cumsum(np.append(0, weight * mean))
    block = lambda i, j: (s[j + 1] - s[i]) / (w[j + 1] - w[i])
    return np.array([max(min(block(i, j) for j in range(k, len(mean))) for i in range(k + 1)) for k in range(len(mean))])


def dense(x, y, folds, unseen_x):
    """Ridge on the stacked features by augmented least squares; calibration with out-of-fold scores."""
    mean, spread = x.mean(0), x.std(0)
    scale = np.where(spread > 1e-6, spread, 1.0)
    rng = np.random.default_rng(qm.SEED)
    directions, phases = rng.normal(size=(x.shape[1], qm.FEATURES)) / (qm.WIDTH * np.sqrt(2)), rng.uniform(0, 2 * np.pi, qm.FEATURES)

    def features(v):
        z = (v - mean) / scale
        return np.hstack([np.sqrt(2 / qm.FEATURES) * np.cos(z @ directions + phases), z, np.ones((len(z), 1))])

    def ridge(z, t):
        size = z.shape[1]
        return np.linalg.lstsq(np.vstack([z, np.sqrt(qm.PENALTY * len(y)) * np.eye(size)]), np.append(t, np.zeros(size)), rcond=None)[0]

    z = features(x)
    out = np.empty(len(y))
    for k in range(qm.FOLDS):
        out[folds == k] = z[folds == k] @ ridge(z[folds != k], y[folds != k])
    at = np.clip(((out - qm.LOW) / (qm.HIGH - qm.LOW) * qm.BINS).astype(int), 0, qm.BINS - 1)
    bins = np.unique(at)
    count, ones = np.array([(at == b).sum() for b in bins]), np.array([y[at == b].sum() for b in bins])
    level = isotonic(count.astype(float), ones / count)
    return np.clip(np.interp(features(unseen_x) @ ridge(z, y), qm.LOW + (bins + 0.5) / qm.BINS * (qm.HIGH - qm.LOW), level), 0, 1)


def test_registered_query_matches_dense_numpy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(qm.FOLDS)).alias("fold")).toPandas()
    divisor, out = queries.QUALITY_FOLD
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet").where((id_remainder(F.col("doc_id"), divisor) != out) & F.col("quality").isNotNull()).toPandas().groupby("doc_id").quality.mean()
    stats = np.stack([qm.statistics((t or "").encode()) for t in docs.text]).astype(np.float64)
    labelled = docs.id.isin(marks.index).to_numpy()
    y = docs.id[labelled].map(marks).to_numpy(float)
    assert 0 < y.sum() < len(y)
    want = dict(zip(docs.id, dense(stats[labelled], y, docs.fold[labelled].to_numpy(), stats)))
    got = {r.doc_id: r.score for r in queries.queries()["op10_quality_classifier"](spark, FOLDER).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_pooled_is_isotonic():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 60):
        weight, mean = rng.integers(1, 9, n).astype(float), rng.random(n)
        assert np.allclose(qm.pooled(weight, mean), isotonic(weight, mean))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, ("good words here " if k % 2 else "BAD!!! $$$ ") * (k % 5 + 1), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return qm.train(qm.document_statistics(df), df)


def test_clashing_names(spark, model):
    rows = [(1, "good words here", 7, "a"), (2, None, 8, "b"), (3, "", 9, "c")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, x int, y string")
    want = {r.doc_id: r.score for r in qm.score_documents(plain, model).collect()}
    for x, y in (("_scored", "_scored0"), ("score", "stats"), ("Score", "_SCORED0"), ("a b", "id")):
        got = qm.score_documents(plain.withColumnsRenamed({"x": x, "y": y}), model)
        assert got.columns == ["doc_id", "text", *(c for c in (x, y) if c.lower() != "score"), "score"]
        assert {r.doc_id: r.score for r in got.collect()} == want
        assert {r.doc_id: r[1] for r in got.collect()} == {r[0]: r[1] for r in rows}
    assert {r.doc_id: r.text for r in qm.score_documents(plain, model, score_col="text").collect()} == want
    assert qm.score_documents(plain.limit(0), model).count() == 0


def test_a_text_that_stays_goes_to_python_once(spark, model, capsys):
    plain = spark.createDataFrame([(1, "good words here", 7)], "doc_id long, text string, x int")
    plan = lambda d: (d.explain(True), capsys.readouterr().out)[1]
    assert "_scored0" not in plan(qm.score_documents(plain, model))
    assert "_scored0" in plan(qm.score_documents(plain, model, score_col="text"))


def test_rejected_rows_go_and_texts_come_to_python_once(spark, capsys, monkeypatch):
    good, bad = "good words here ", "BAD!!! $$$ "
    rows = [(k, (good if k % 2 else bad) * (k % 5 + 1), k % 2) for k in range(60)]
    marks = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    odd = [(None, bad), (None, good), (None, None), (7, bad), (7, good), (7, good), (8, ""), (9, None), (9, bad), (9, bad)]
    docs = spark.createDataFrame([*odd, *((i, t) for i, t, _ in rows if i > 9)], "doc_id long, text string").repartition(5)
    model = qm.train(qm.document_statistics(docs), marks)
    scored = qm.score_documents(docs, model).collect()
    want = sorted((str(r.doc_id), str(r.text)) for r in scored if r.score >= queries.THRESHOLD)
    assert 0 < len(want) < len(scored)
    files = []
    monkeypatch.setattr(qm, "saved", lambda df, name: (files.append(df.rdd.getNumPartitions()), common.saved(df, name))[1])
    for most in (qm.BROADCAST_ROWS, 0):
        got = qm.without_rejected(docs, marks, queries.THRESHOLD, broadcast_rows=most)
        assert got.schema == docs.schema
        assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == want
        got.explain()
        assert "MapInArrow" not in capsys.readouterr().out  # the texts that stay are read and written without Python
    assert files == [1, 1]  # a file for the rejected rows, none for the statistics


def test_pipeline_s_stage_writes_texts_without_python(spark, capsys):
    corpus_pipeline.quality(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER).explain()
    assert "MapInArrow" not in capsys.readouterr().out
