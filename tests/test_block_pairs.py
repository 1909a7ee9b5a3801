"""Pairs of blocks: whole results from several blocks, without a shuffle that grows with the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import moments as X
from retort.operators import statistics as T

G = np.random.default_rng(3)


@pytest.fixture(scope="module")
def points():
    return np.round(G.normal(size=(90, 5)), 3)


def shuffled_rows(spark, frame):
    """Rows that the exchanges of a query's last run wrote, and rows of the result."""
    found = frame.collect()
    names, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if "Exchange" in node.nodeName() and metrics.contains("shuffleRecordsWritten"):
            names += metrics.get("shuffleRecordsWritten").get().value()
        inner = [node.children().apply(k) for k in range(node.children().size())]
        inner += [getattr(node, m)() for m in ("executedPlan", "plan") if m in dir(node)]
        todo += inner
    return names, found


def rows_of(spark, points):
    return spark.createDataFrame([(k, [float(v) for v in p], f"c{k % 3}") for k, p in enumerate(points)], "sample_id long, x array<double>, label string")


def test_gram_shuffles_no_pairs(spark, points):
    long = spark.createDataFrame([(k, j, float(v)) for k, p in enumerate(points) for j, v in enumerate(p)], "sample_id long, pos long, value double")
    moved, got = shuffled_rows(spark, T.gram(long, block=2, sample_block=10))
    want = points @ points.T
    assert len(got) == 90 * 91 // 2 and all(r.a <= r.b for r in got)
    assert np.allclose([r.dot for r in got], [want[r.a, r.b] for r in got])
    assert 0 < moved < len(got) / 2


def test_distance_sums_of_many_blocks(spark, points):
    rows = rows_of(spark, points)
    moved, got = shuffled_rows(spark, T.distance_sums(rows.select("sample_id", "x"), rows.select("sample_id", "label"), tile=10))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert len(got) == 270 and moved > 0
    for r in got:
        other = [k for k in range(90) if k % 3 == int(r.other[1]) and k != r.sample_id]
        assert r.n == len(other) and abs(r.d - d[r.sample_id, other].sum()) < 1e-6 and r.label == f"c{r.sample_id % 3}"


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours_of_equal_rows_go_by_id(spark, points, scaled, monkeypatch):
    """Copies far from the origin, in several blocks: distances of copies are equal, so ids decide."""
    monkeypatch.setattr(X, "TILE_ROWS", 12)
    x = np.r_[points[:30], points[:30], points[:30]] + 1e5
    rows = rows_of(spark, x)
    test = rows.select((F.col("sample_id") % 4).alias("split_id"), "sample_id")
    by = G.uniform(0.5, 2, size=(4, 5)) if scaled else np.ones((4, 5))
    scales = spark.createDataFrame([(k, [float(v) for v in b]) for k, b in enumerate(by)], "split_id long, by array<double>") if scaled else None
    got = {r.sample_id: [t.other for t in r.t] for r in X.nearest_rows(rows, test, 4, scales).collect()}
    assert len(got) == 90
    for k, near in got.items():
        other = [o for o in range(90) if o % 4 != k % 4]
        gap = (((x[k] - x[other]) / by[k % 4]) ** 2).sum(1)
        assert near == [o for _, o in sorted(zip(gap, other, strict=True))][:4]


def test_rows_without_a_split_train_and_rows_of_two_splits_are_told_twice(spark, points):
    rows = rows_of(spark, points)
    test = spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "split_id long, sample_id long")
    got = {(r.split_id, r.sample_id): [t.other for t in r.t] for r in X.nearest_rows(rows, test, 2).collect()}
    for (s, k), near in got.items():
        other = [o for o in range(90) if o not in ({1} if s == 0 else {1, 2})]
        assert near == [o for _, o in sorted((((points[k] - points[o]) ** 2).sum(), o) for o in other)][:2]
    assert set(got) == {(0, 1), (1, 1), (1, 2)}
