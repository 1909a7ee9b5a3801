"""Ridge of more samples than features beside the form from one Gram matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import models as D
from retort.operators import wide as W
from retort.plans import jobs as J


@pytest.fixture()
def made(spark):
    g = np.random.default_rng(3)
    x, label = g.poisson(1.0, (90, 12)).astype(float) + 50, g.integers(0, 3, 90)
    x[:, 4] += 2 * label
    cells = [(k, 10 * j, float(x[k, j])) for k in range(90) for j in range(12) if (k + j) % 4]
    x[(np.add.outer(np.arange(90), np.arange(12)) % 4) == 0] = 0
    features = spark.createDataFrame(cells, "sample_id long, pos long, value double")
    labels = spark.createDataFrame([(k, f"c{v}") for k, v in enumerate(label)], "sample_id long, label string")
    return x, label, features, labels


def test_more_samples_than_one_gram_matrix_holds(spark, made, monkeypatch):
    """Rows of no split train only, rows of two splits are tested by both."""
    x, label, features, labels = made
    monkeypatch.setattr(D, "DUAL_MOST", 50)
    monkeypatch.setattr(W, "MATRIX_ROWS", 20)
    monkeypatch.setattr(W, "TOLD_ROWS", 30)
    monkeypatch.setattr(W, "STRIP", 5)
    monkeypatch.setattr(W, "BATCH_CELLS", 100)
    test = labels.where("sample_id >= 10").select((F.col("sample_id") % 3).alias("split_id"), "sample_id")
    test = test.unionByName(labels.where("sample_id BETWEEN 40 AND 49 AND sample_id % 3 <> 1").select(F.lit(1).cast("long").alias("split_id"), "sample_id"))
    got = {r.split_id: r.accuracy for r in J.wide_classification_job(features, labels, test).collect()}
    held = {s: sorted(r.sample_id for r in test.where(F.col("split_id") == s).collect()) for s in range(3)}
    assert sorted(got) == [0, 1, 2]
    for s, ids in held.items():
        train = np.setdiff1d(np.arange(90), ids)
        told = D.ridge_classes(x @ x.T, label, train, np.array(ids))[0]
        assert got[s] == pytest.approx(np.mean(told == label[ids]), abs=1e-9)


def test_few_samples_take_the_gram_matrix(spark, made):
    x, label, features, labels = made
    few = labels.where("sample_id < 9")
    test = few.select((F.col("sample_id") % 2).alias("split_id"), "sample_id")
    got = {r.split_id: r.accuracy for r in J.wide_classification_job(features.where("sample_id < 9"), few, test).collect()}
    for s in (0, 1):
        ids = np.arange(s, 9, 2)
        train = np.arange(1 - s, 9, 2)
        told = D.ridge_classes(x[:9] @ x[:9].T, label[:9], train, ids)[0]
        assert got[s] == pytest.approx(np.mean(told == label[ids]), abs=1e-9)
