"""Composed jobs against plain numpy, and readers that must refuse unlike files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.plans import jobs as J
from retort.sources import runs as R

G = np.random.default_rng(11)
WINES, TASTERS = 30, 4
X = G.normal(size=(WINES, 3))
Y = (X @ G.normal(size=(3, 2)))[:, None, :] + G.normal(size=(WINES, TASTERS, 2)) * 0.3


@pytest.fixture(scope="module")
def wines(spark):
    return spark.createDataFrame([(f"w{k}", [float(v) for v in x]) for k, x in enumerate(X)], "wine string, x array<double>")


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(f"w{k}", f"t{t}", [float(v) for v in Y[k, t]]) for k in range(WINES) for t in range(TASTERS)], "wine string, taster string, y array<double>")


def ridge(x, y, at, alpha=1.0):
    d, e = x - x.mean(0), y - y.mean(0)
    w = np.linalg.solve(d.T @ d + alpha * np.eye(x.shape[1]), d.T @ e)
    return (at - x.mean(0)) @ w + y.mean(0)


def r2(true, told):
    return 1 - ((true - told) ** 2).sum() / ((true - true.mean()) ** 2).sum()


def test_own_and_group_models(spark, wines, scores):
    got = {(r.taster, r.attribute): r for r in J.self_and_group_models(wines, scores, ["a", "b"]).collect()}
    fold = {r.wine: r.fold for r in J._folded(scores, 5, 0).select("wine", "fold").distinct().collect()}
    f = np.array([fold[f"w{k}"] for k in range(WINES)])
    assert np.bincount(f).tolist() == [6] * 5
    for t in range(TASTERS):
        others = np.delete(Y, t, axis=1).mean(1)
        for c, name in enumerate("ab"):
            own, group = np.zeros(WINES), np.zeros(WINES)
            for k in range(5):
                own[f == k] = ridge(X[f != k], Y[f != k, t], X[f == k])[:, c]
                group[f == k] = ridge(X[f != k], others[f != k], X[f == k])[:, c]
            assert abs(got[f"t{t}", name].r2_self - r2(Y[:, t, c], own)) < 1e-9
            assert abs(got[f"t{t}", name].r2_group - r2(Y[:, t, c], group)) < 1e-9


def test_models_of_each_taster(spark, wines, scores):
    few = scores.where("taster <> 't0' OR wine IN ('w1', 'w2')")
    metrics, weights = J.taster_models(wines, few, ["a", "b"], repeats=4)
    m = metrics.collect()
    assert {r.taster for r in m} == {"t1", "t2", "t3"} and all(r.repeats == 4 and 0.5 < r.r2 <= 1 for r in m)
    assert weights.count() == 3 * 2 * 3


def test_sensory_controls_fail(spark, wines, scores):
    rows = scores.withColumn("row_id", F.concat("wine", "taster"))
    names = [f"t{k}" for k in range(TASTERS)]
    score = lambda **o: {r.attribute: r.r2 for r in J.M.regression_metrics(J.sensory_model(wines, rows, ["a", "b"], names, **o), "attribute").collect()}
    real, control = score(), score(shuffled=True)
    assert all(real[a] > 0.7 > 0.3 > control[a] for a in "ab")
    swapped = J.exchanged(rows.select("row_id", "y"))
    assert swapped.count() == rows.count() and sorted(map(str, swapped.select("y").collect())) == sorted(map(str, rows.select("y").collect()))


def test_labels_and_ages_from_rows(spark):
    rows = spark.createDataFrame([(k, [float(k), float(k % 3)]) for k in range(120)], "sample_id long, x array<double>")
    ages = rows.select("sample_id", F.col("sample_id").cast("double").alias("age"))
    assert all(r.r2 > 0.99 for r in J.age_regression(rows, ages).collect()) and J.age_regression(rows, ages).count() == 3
    labels = rows.select("sample_id", (F.col("sample_id") % 3).cast("string").alias("label"))
    found, shares = J.profile_labels(rows.select("sample_id", F.slice("x", 2, 1).alias("x")), labels, J.P.stratified_folds(labels, "label", 4, 2), 4, "knn")
    assert [r.accuracy for r in found.collect()] == [1.0, 1.0] and {(r.y_true, r.y_pred, r.share) for r in shares.collect()} == {(c, c, 1.0) for c in "012"}
    spread = rows.withColumn("x", F.array(F.col("x")[0], F.col("x")[1] + (F.col("sample_id") % 7) / 20))  # classes need some width
    once = J.pca_classification(spread, labels, repeats=5, variance=1.0).collect()[0]
    assert once.repeats == 5 and once["mean"] > 0.6


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(x, y) for x, y in zip("aaabbbcc", "ppqqqrrr", strict=True)], "x string, y string")
    assert abs(J.T.adjusted_rand(df, "x", "y").collect()[0][0] - (3 - 7 * 7 / 28) / (7 - 7 * 7 / 28)) < 1e-12
    assert J.T.adjusted_rand(df, "x", "x").collect()[0][0] == 1.0


def test_runs_of_other_channels_are_refused(spark, tmp_path):
    for name, mz in (("A", "40,41"), ("B", "50,51")):
        (tmp_path / f"{name}.D").mkdir()
        (tmp_path / f"{name}.D" / f"{name}.csv").write_text(f"rt,{mz}\n1,2,3\n2,3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        R.read_runs(spark, str(tmp_path)).collect()
    a, b = (spark.createDataFrame([("s", 0, m)], "sample_id string, scan_idx int, mz int") for m in (40, 50))
    with pytest.raises(Exception, match="different channels"):
        R.join_datasets([a, b]).collect()
    assert R.join_datasets([a, a]).count() == 2
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        R.read_sensory(spark, str(tmp_path / "empty.csv"))
