"""Every query with SQL against DuckDB, and the others for rows."""

import glob
import os

import duckdb
import pytest

from retort.plans import registry

COSTLY = {"kmeans_best_k", "classify_knn", "classify_lda", "pairwise_pearson", "gram_matrix"}


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(frame):
    def one(v):
        if v is None or v != v:
            return ""
        kind = getattr(getattr(v, "dtype", None), "kind", "")
        return f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float)) or (kind and kind in "fiu") else str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES.keys() - COSTLY))
def test_oracle(spark, data, db, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    want = db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys() - COSTLY))
def test_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
