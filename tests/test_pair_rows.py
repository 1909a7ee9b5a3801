"""Rows of all pairs of samples: the same as SQL's, and small once they are written."""

import glob
import os

import duckdb
import numpy as np
import pytest

from retort.operators import statistics as T
from retort.plans import registry

G = np.random.default_rng(11)


def long_rows(spark, x):
    return spark.createDataFrame([(k, j, float(v)) for k, row in enumerate(x) for j, v in enumerate(row)], "sample_id long, pos int, value double")


@pytest.mark.parametrize("name", ["gram_matrix", "pairwise_pearson"])
def test_pairs_are_those_of_sql(spark, data, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = db.execute(registry.ORACLES[name]).df().sort_values(["a", "b"]).to_numpy()
    got = registry.QUERIES[name](spark, data).toPandas().sort_values(["a", "b"]).to_numpy()
    assert got.shape == want.shape and (got == want).all()


def test_a_constant_row_has_no_correlation(spark):
    got = {(r.a, r.b): r.r for r in T.pairwise_pearson(long_rows(spark, [[1, 2, 4], [5, 5, 5], [2, 4, 8]]), digits=5).collect()}
    assert got[0, 2] == 1.0 and set(got) == {(0, 1), (0, 2), (1, 2)}
    assert np.isnan(got[0, 1]) and np.isnan(got[1, 2])


def test_equal_correlations_are_stored_once(spark, tmp_path):
    """Written in the order of pairs, a correlation takes its 8 bytes in each row."""
    T.pairwise_pearson(long_rows(spark, G.normal(size=(1500, 64))), digits=5).write.parquet(str(tmp_path / "out"))
    rows = 1500 * 1499 // 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows
    assert sum(map(os.path.getsize, glob.glob(f"{tmp_path}/out/*.parquet"))) < 5 * rows


def test_halves_are_rounded_away_from_zero():
    assert T.rounded(np.array([0.125, -0.125, 0.375, -0.001]), 2).tolist() == [0.13, -0.13, 0.38, 0.0]
