"""K-means for all numbers of clusters at once, against Spark's silhouette and plain costs."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from retort.operators import clustering as C
from retort.operators import models as D

R = np.random.default_rng(3)
#: Five groups, the last of them far away and of copies of one point.
SPOTS = np.r_[np.repeat([[0, 0], [4, 0], [0, 4], [4, 4]], 60, axis=0) + R.normal(size=(240, 2)) * 0.4, np.repeat([[30.0, 30.0]], 9, axis=0)] + 1e4


def points(spark, x, parts):
    return spark.createDataFrame([tuple(map(float, p)) for p in x], "x double, y double").repartition(parts)


def test_few_jobs_and_the_same_result_for_any_partitions(spark):
    spark.sparkContext.setJobGroup("k-means", "")
    one = D.kmeans_best(points(spark, SPOTS, 1), ["x", "y"]).collect()
    spark.sparkContext.setJobGroup("", "")
    # a fit for each k took more than a hundred
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("k-means")) < 60
    other = D.kmeans_best(points(spark, SPOTS[R.permutation(len(SPOTS))], 7), ["x", "y"]).collect()
    assert [r.k for r in one] == list(range(2, 10)) and [r.best for r in one] == [r.best for r in other]
    assert [r.silhouette for r in other] == pytest.approx([r.silhouette for r in one], abs=1e-9)
    assert [r.k for r in one if r.best] == [max(one, key=lambda r: (r.silhouette, -r.k)).k]


def test_costs_and_silhouettes(spark):
    held = C.Points(points(spark, SPOTS, 3), ["x", "y"])
    centres = C.kmeans(held, [2, 5, 6])
    got = held.silhouettes(centres)
    truth = np.r_[[SPOTS[60 * k : 60 * k + 60].mean(0) for k in range(4)], [SPOTS[-1]]]
    assert np.allclose(sorted(map(tuple, centres[5] + held.middle)), sorted(map(tuple, truth)), atol=1e-3)
    for k, c in centres.items():
        d = ((SPOTS[:, None] - c - held.middle) ** 2).sum(-1)
        rows = [([float(v) for v in p], float(a)) for p, a in zip(SPOTS - 1e4, d.argmin(1), strict=True)]
        spark_rows = spark.createDataFrame(rows, "features array<double>, prediction double").withColumn("features", array_to_vector(F.col("features")))
        assert got[k] == pytest.approx(ClusteringEvaluator().evaluate(spark_rows), abs=1e-7)
        assert held.moments({k: c})[k][:, 1].sum() == pytest.approx(d.min(1).sum(), rel=1e-6)


def test_fewer_points_than_clusters(spark):
    got = D.kmeans_best(points(spark, [[1, 1], [1, 1], [3, 1]], 2), ["x", "y"], 4).collect()
    assert [(r.k, r.best) for r in got] == [(2, True), (3, False), (4, False)]
    with pytest.raises(ValueError):
        C.Points(points(spark, [[1, 1]], 1).where("x > 5"), ["x", "y"])
