"""Greedy selection on larger tables: what is read once, and what a step sends to its tasks."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from retort.operators import moments as X
from retort.operators import selection as G
from retort.plans import model_queries as Q


def test_cells_are_read_once(spark, data):
    """Steps read the written sums; before, each of them added up all scans again."""
    rows, labels = Q._cells(spark, data)
    spectra, _ = Q._spectra(spark, data)
    for written in (rows, labels, spectra):
        assert not any("lineitem" in f for f in written.inputFiles())
    want = duckdb.sql(f"SELECT l_suppkey AS s, (l_partkey % 200) // 50 * 7 + l_linenumber - 1 AS k, sum(l_quantity) AS v FROM '{data}/lineitem.parquet' GROUP BY ALL").df()
    cells = {s: np.zeros(28) for s in want["s"].unique()}
    for s, k, v in want.itertuples(index=False):
        cells[s][int(k)] = v
    got = {r.sample_id: np.array(r.x) for r in rows.collect()}
    assert got.keys() == cells.keys() == {r.sample_id for r in labels.collect()} and all(np.allclose(got[s], cells[s]) for s in cells)
    assert all(np.allclose(r.x, cells[r.sample_id].reshape(4, 7).sum(0)) for r in spectra.collect())


def test_test_rows_are_blocks_and_parts_of_the_sets_change_nothing(spark, monkeypatch):
    """A fold's test rows are a few blocks; before, every row was there and was sent to each chunk of 256 sets."""
    r = np.random.default_rng(1)
    n = 120
    rows = spark.createDataFrame([(k, [float(v) for v in r.normal(size=5)]) for k in range(n)], "sample_id long, x array<double>")
    labels = spark.createDataFrame([(k, f"c{k % 3}") for k in range(n)], "sample_id long, label string")
    dealt = X.with_classes(rows, labels).select(F.lit(0).alias("group"), (F.col("sample_id") % 3 % 2).cast("int").alias("fold"), F.lit(True).alias("trains"), "sample_id", "x", "y", "label", "classes")
    sets = [(0, c, [[p] for p in range(5) if c >> p & 1]) for c in range(32)]
    tests, sums = G.folded(dealt)
    assert tests.count() == 2 and len(set(tests.columns) & {"sample_id", "classes"}) == 0
    whole = sorted(map(tuple, G.candidate_scores(tests, sums, sets).collect()))
    assert len(whole) == 64
    for name, value in (("BLOCK_ROWS", 9), ("CHUNK", 2), ("PAIRS", 40), ("SCORES", 16)):
        monkeypatch.setattr(G, name, value)
    tests, sums = G.folded(dealt)
    assert tests.count() > 6
    assert np.allclose(sorted(map(tuple, G.candidate_scores(tests, sums, sets).collect())), whole)


def test_sets_solved_together(spark):
    """Weights and hits are those of each set by itself; a class without rows is never told, ties go to the first class."""
    r = np.random.default_rng(2)
    x, label = r.normal(size=(90, 6)), np.arange(90) % 3
    z = np.c_[np.ones(90), x, label[:, None] == np.arange(4)]
    s = X.Sums(6, (z.T @ z).ravel())
    sets = [[[0], [4]], [], [[1, 2], [5]], [[3]], [[2], [2]], [[5], [1]]]
    w, b = G.subset_ridges(s, sets, 1.0)
    hits = G.hits_by_class(x, label, w, b)
    for k, places in enumerate(sets):
        own, at = G.subset_ridge(s, places, 1.0)
        told = (x @ own + at).argmax(1)
        assert np.allclose(w[:, :, k], own) and np.allclose(b[:, k], at)
        assert hits[:, k].tolist() == np.bincount(label, told == label, 4).tolist()
    assert np.isinf(b[3]).all() and hits[:, 1].tolist() == [30, 0, 0, 0]
