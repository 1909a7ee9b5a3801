"""Dual regression, peak matches, lag profiles and summaries of all pairs against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import align as A
from retort.operators import models as D
from retort.operators import moments as X
from retort.operators import statistics as T


def rows_of(spark, n=12, p=5):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(n, p)), r.normal(size=n)
    return x, y, spark.createDataFrame([(k, x[k].tolist(), [float(y[k])]) for k in range(n)], "sample_id long, x array<double>, y array<double>")


def test_dual_and_primal_ridge_agree(spark):
    _, _, rows = rows_of(spark)
    long = rows.select("sample_id", F.posexplode("x").alias("pos", "value"))
    test = rows.select((F.col("sample_id") % 3).alias("split_id"), "sample_id")
    targets = rows.select("sample_id", F.lit("a").alias("attribute"), F.col("y")[0].alias("value"))
    dual = {(r.split_id, r.sample_id): r.y_pred for r in D.regress_splits(T.gram(long), targets, test).collect()}
    primal = {(r.split_id, r.sample_id): r.y_pred for r in X.regress(rows, ["a"], test).collect()}
    assert dual.keys() == primal.keys() and all(abs(dual[k] - primal[k]) < 1e-8 for k in dual)


def test_pearson_summary(spark):
    x, _, rows = rows_of(spark)
    long = rows.select("sample_id", F.posexplode("x").alias("pos", "value"))
    r = np.corrcoef(x)[np.triu_indices(len(x), 1)]
    got = T.pearson_summary(long).collect()[0]
    assert abs(got["mean"] - r.mean()) < 1e-9 and abs(got["std"] - r.std()) < 1e-9 and got["n"] == len(r)
    assert T.pearson_summary(long.where("sample_id = 0")).collect() == []
    with pytest.raises(Exception, match="unlike lengths"):
        T.pearson_summary(long.where("sample_id > 0 OR pos < 3")).collect()


def test_matched_peaks_run_forward():
    ref, own = np.array([10, 20, 30]), np.array([12, 19, 31])
    spectra = np.eye(3)
    assert A.match_peaks(ref, spectra, own, spectra, 5, 0.8) == [(10, 12), (20, 19), (30, 31)]
    assert A.match_peaks(ref, spectra, own, spectra[[1, 0, 2]], 15, 0.8) == [(10, 19), (30, 31)]
    assert A.match_peaks(ref, spectra, own[:0], spectra[:0], 5, 0.8) == []


def test_lag_profile_smooths_and_fills(spark):
    t = np.arange(60)
    trace = lambda shift: 10 + np.sin((t - shift) / 4)
    tics = spark.createDataFrame([(k, int(s), float(v)) for k, shift in ((1, 0), (2, 3)) for s, v in zip(t, trace(shift), strict=True)], "sample_id long, scan_idx int, tic double")
    ref = tics.where("sample_id = 1").select("sample_id").distinct()
    got = {(r.sample_id, r.window): r.lag for r in A.lag_profile(tics, ref, 60, 20, 5, "mse", 1.0).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (2, 0): 3, (2, 1): 3, (2, 2): got[(2, 2)]}
    assert A.lag_profile(tics.limit(0), ref, 60, 20, 5).collect() == []
