"""Models from sums over rows against the same models fitted on each split's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import models as D
from retort.operators import moments as X

R = np.random.default_rng(7)
LABELS = R.integers(0, 3, 90)
DATA = R.normal(size=(90, 6)) + LABELS[:, None] * np.array([1.5, 0, -1, 0, 0, 0.5])
TARGETS = DATA @ R.normal(size=(6, 2)) + R.normal(size=(90, 2))


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, [float(v) for v in x], [float(v) for v in y]) for k, (x, y) in enumerate(zip(DATA, TARGETS, strict=True))], "sample_id long, x array<double>, y array<double>")
    return df.repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, f"c{v}") for k, v in enumerate(LABELS)], "sample_id long, label string")


def folds(spark, n=5):
    return spark.createDataFrame([(k % n, k) for k in range(90)], "split_id int, sample_id long")


def test_ridge_of_each_split(spark, rows):
    got = {(r.sample_id, r.attribute): r.y_pred for r in X.regress(rows, ["a", "b"], folds(spark), 2.0).collect()}
    for f in range(5):
        test = np.arange(90) % 5 == f
        want = D.dual_ridge(DATA @ DATA.T, TARGETS, np.flatnonzero(~test), np.flatnonzero(test), 2.0)
        assert np.allclose([[got[k, a] for a in "ab"] for k in np.flatnonzero(test)], want)


@pytest.mark.parametrize("model", ["ridge", "lda", "knn"])
def test_classes_of_each_split(spark, rows, labels, model):
    got = {r.sample_id: r.y_pred for r in X.classify(rows.drop("y"), labels, folds(spark), model).collect()}
    names = np.array([f"c{v}" for v in LABELS])
    for f in range(5):
        test = np.arange(90) % 5 == f
        want = D.CLASSIFIERS[model](DATA @ DATA.T, names, np.flatnonzero(~test), np.flatnonzero(test))[0]
        assert [got[k] for k in np.flatnonzero(test)] == list(want)


@pytest.mark.parametrize("tile", [7, 2048])
def test_neighbours_do_not_depend_on_tiles(spark, rows, labels, monkeypatch, tile):
    monkeypatch.setattr(X, "TILE_ROWS", tile)
    got = {r.sample_id: r.y_pred for r in X.classify(rows.drop("y"), labels, folds(spark), "knn").collect()}
    names = np.array([f"c{v}" for v in LABELS])
    test = np.arange(90) % 5 == 2
    assert [got[k] for k in np.flatnonzero(test)] == list(D.knn_classes(DATA @ DATA.T, names, np.flatnonzero(~test), np.flatnonzero(test))[0])


def test_leave_one_out_in_closed_form(spark, rows):
    keyed = rows.withColumn("half", F.col("sample_id") % 2)
    got = {r.sample_id: r.y_pred for r in X.leave_one_out(keyed, "half", alpha=0.7).collect()}
    for h in (0, 1):
        own = np.arange(h, 90, 2)
        k = DATA[own] @ DATA[own].T
        for i, s in enumerate(own):
            want = D.dual_ridge(k, TARGETS[own, :1], np.delete(np.arange(len(own)), i), np.array([i]), 0.7)[0, 0]
            assert abs(got[s] - want) < 1e-9


def test_pca_is_that_of_the_gram_matrix(rows):
    got = {}
    for r in X.pca(rows, components=3).collect():
        got[r.sample_id, r.component] = r.score
    scores = np.array([[got[k, c] for c in range(3)] for k in range(90)])
    want = D.gram_scores(DATA @ DATA.T, np.arange(90), components=3)
    assert np.allclose(np.abs(scores), np.abs(want))


def test_empty_tables(spark, rows, labels):
    assert X.classify(rows.drop("y").limit(0), labels, folds(spark)).collect() == [] and X.regress(rows.limit(0), ["a", "b"], folds(spark)).collect() == []


def scaled_by(train, x):
    spread = x[train].std(0)
    return (x - x[train].mean(0)) / np.where(spread > 0, spread, 1)


@pytest.mark.parametrize("model", ["ridge", "lda", "knn"])
def test_scaled_classes_of_each_split(spark, labels, model):
    data = np.c_[DATA * [1, 100, 0.01, 1, 5, 3] + [0, 1e6, 0, -7, 0, 1e3], np.full(90, 4.0)]
    rows = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(data)], "sample_id long, x array<double>").repartition(3)
    got = {r.sample_id: r.y_pred for r in X.classify(rows, labels, folds(spark), model, scale="standard").collect()}
    names = np.array([f"c{v}" for v in LABELS])
    for f in range(5):
        test = np.arange(90) % 5 == f
        z = scaled_by(~test, data)
        want = D.CLASSIFIERS[model](z @ z.T, names, np.flatnonzero(~test), np.flatnonzero(test))[0]
        assert [got[k] for k in np.flatnonzero(test)] == list(want)


def test_flat_features_with_a_large_offset(spark):
    """Features of deviation 1 at a mean of 1e8 keep their weights."""
    x = np.random.default_rng(1).normal(size=(400, 3))
    y = x @ [1.0, 2.0, 3.0]
    rows = spark.createDataFrame([(k, [float(v) for v in a + 1e8], [float(b + 1e8)]) for k, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id long, x array<double>, y array<double>").repartition(7)
    model = X.fitted(X.sums(rows), lambda s: X.ridge_fit(s, 1e-6)).collect()[0]
    assert np.allclose(model.weights[0], [1, 2, 3], atol=1e-6)
    test = spark.createDataFrame([(k % 4, k) for k in range(400)], "split_id int, sample_id long")
    out = X.regress(rows, ["y"], test, 1e-6, scale="standard").toPandas()
    assert np.abs(out.y_pred - out.y_true).max() < 1e-3
    loo = X.leave_one_out(rows, alpha=1e-6, scale="standard").toPandas()
    assert np.abs(loo.y_pred - loo.y_true).max() < 1e-3


@pytest.mark.parametrize("scale", [None, "standard"])
def test_leave_one_out_with_coefficients(spark, rows, monkeypatch, scale):
    monkeypatch.setattr(X, "LOO_ROWS", 7)
    monkeypatch.setattr(X, "LOO_CELLS", 150)
    keyed = rows.withColumn("half", (F.col("sample_id") % 2).cast("string"))
    frame = X.leave_one_out(keyed, "half", alpha=0.7, scale=scale, coefficients=True)
    got = {r.sample_id: r for r in frame.collect()}
    assert len(got) == 90
    for h in (0, 1):
        own = np.arange(h, 90, 2)
        for i, s in enumerate(own):
            train = np.delete(own, i)
            z = scaled_by(train, DATA) if scale else DATA - DATA[train].mean(0)
            mean = TARGETS[train, 0].mean()
            w = np.linalg.solve(z[train].T @ z[train] + 0.7 * np.eye(6), z[train].T @ (TARGETS[train, 0] - mean))
            assert abs(got[s].y_pred - (mean + z[s] @ w)) < 1e-9 and np.allclose(got[s].weights, w)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and X.leave_one_out(rows.limit(0)).collect() == []
    assert X.leave_one_out(rows.where("sample_id = 3"), scale=scale).collect()[0].y_pred is None


def test_hold_out_scaled_by_itself(spark, rows, labels):
    far = rows.drop("y").withColumn("x", F.when(F.col("sample_id") % 3 == 1, F.transform("x", lambda v: v * 40 + 900)).otherwise(F.col("x")))
    origin = labels.select((F.col("sample_id") % 3).alias("split_id"), "sample_id")
    got = {r.sample_id: r.y_pred for r in X.hold_out(far, labels, origin).collect()}
    data = DATA.copy()
    data[1::3] = data[1::3] * 40 + 900
    names = np.array([f"c{v}" for v in LABELS])
    for f in range(3):
        test = np.arange(90) % 3 == f
        z = scaled_by(~test, data)
        z[test] = scaled_by(test, data)[test]
        train_only = z - z[~test].mean(0)
        want = D.CLASSIFIERS["ridge"](train_only @ train_only.T, names, np.flatnonzero(~test), np.flatnonzero(test))[0]
        assert [got[k] for k in np.flatnonzero(test)] == list(want)
