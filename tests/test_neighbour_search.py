"""Neighbours: 32-bit products sort out no row that counts, copies and far blocks cost little, and pairs are met once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import moments as X


@pytest.mark.parametrize("trial", range(24))
def test_no_near_row_is_sorted_out(trial):
    """Features of unlike units and offsets, near copies and equal rows."""
    g = np.random.default_rng(trial)
    n, m, p = g.integers(1, 300), g.integers(2, 300), g.integers(1, 70)
    unit = 10.0 ** g.uniform(-12, 12, p) if trial % 3 == 0 else np.full(p, 10.0 ** g.uniform(-60, 60))
    offset, base = g.normal(size=p) * unit * (1e5 if trial % 2 else 0), g.normal(size=(40, p))
    x, y = ((base[g.integers(0, 40, k)] + g.normal(size=(k, p)) * 10.0 ** g.uniform(-9, 0)) * unit + offset for k in (n, m))
    y[g.integers(0, m, m // 3)] = y[0]
    by, k, train = (unit if trial % 4 else np.ones(p)), int(g.integers(1, 6)), np.r_[0, np.flatnonzero(g.random(m - 1) < 0.8) + 1]
    d = (((x[:, None] - y[None, train]) / by) ** 2).sum(2)
    last = np.sort(d, 1)[:, min(k, len(train)) - 1]
    t, j = np.nonzero(d <= last[:, None])
    own, others = X._centred(x, y.mean(0)), X._centred(y, y.mean(0))
    for most in (np.full(n, np.inf), last, last * 1.5):
        one, other, _ = X._candidates(own, 0, n, others, train, by, k, most)
        assert set(zip(t, train[j], strict=True)) <= set(zip(one, other, strict=True))


def test_nothing_beyond_the_known_neighbours_is_looked_at():
    g = np.random.default_rng(0)
    x, y = g.normal(size=(50, 8)), g.normal(size=(400, 8)) + 100
    found = X._candidates(X._centred(x, y.mean(0)), 0, 50, X._centred(y, y.mean(0)), np.arange(400), np.ones(8), 3, np.full(50, 10.0))
    assert [len(c) for c in found] == [0, 0, 0]


def test_copies_and_metrics_of_one_search(spark, monkeypatch):
    """600 equal rows: only the first few of each block are compared, and the told rows hang on no pairs of blocks."""
    monkeypatch.setattr(X, "TILE_ROWS", 200)
    rows = spark.range(600).select(F.col("id").alias("sample_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"), (F.col("id") % 3).cast("string").alias("label"))
    near = X.nearest_rows(rows, rows.select((F.col("sample_id") % 2).alias("split_id"), "sample_id"), 3)
    assert "CartesianProduct" not in near._jdf.queryExecution().toString()
    got = {r.sample_id: [t.other for t in r.t] for r in near.collect()}
    assert got == {k: [1, 3, 5] if k % 2 == 0 else [0, 2, 4] for k in range(600)}
