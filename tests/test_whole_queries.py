"""Registered queries that SQL cannot state, on whole tables against plain numpy."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import models as D
from retort.operators import splits as P
from retort.operators import survival as V
from retort.plans import registry


@pytest.fixture(scope="module")
def vectors(data):
    t = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{data}/embeddings.parquet' ORDER BY vec_id").df()
    return t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float), t["label"].astype(str).to_numpy()


@pytest.fixture(scope="module")
def cells(data):
    """Suppliers in the order of their ids as text, sums by scan and channel, and their classes."""
    t = duckdb.sql(f"SELECT l_suppkey AS s, l_partkey % 200 AS scan, l_linenumber AS c, sum(l_quantity) AS v FROM '{data}/lineitem.parquet' GROUP BY ALL").df()
    ids = sorted(t["s"].unique(), key=str)
    cube = np.zeros((len(ids), 200, 7))
    cube[[ids.index(s) for s in t["s"]], t["scan"], t["c"] - 1] = t["v"]
    return np.array(ids), cube, np.array([f"c{s % 4}" for s in ids])


def folds_of(spark, ids, label, folds):
    frame = spark.createDataFrame([(int(i), str(v)) for i, v in zip(ids, label, strict=True)], "sample_id long, label string")
    held = {r.sample_id: r.split_id for r in P.stratified_folds(frame, "label", folds).collect()}
    return np.array([held[int(i)] for i in ids])


def balanced(true, told):
    return np.mean([np.mean(told[true == c] == c) for c in np.unique(true)])


@pytest.mark.parametrize("scaled", ["", "_scaled"])
@pytest.mark.parametrize("model", ["ridge", "knn", "lda"])
def test_classification_by_folds(spark, data, vectors, model, scaled):
    ids, x, label = vectors
    fold = folds_of(spark, ids, label, 5)
    got = {r.split_id: r for r in registry.QUERIES[f"classify_{model}{scaled}"](spark, data).collect()}
    for f in range(5):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        z = (x - x[train].mean(0)) / (x[train].std(0) if scaled else 1)
        told = D.CLASSIFIERS[model](z @ z.T, label, train, test)[0]
        assert got[f].accuracy == pytest.approx(np.mean(told == label[test]), abs=1e-6) and got[f].balanced_accuracy == pytest.approx(balanced(label[test], told), abs=1e-6)


def cubes_of(cube, kind):
    """Each cube's features by name: 4 retention bins of 50 scans and 2 channel bins."""
    out = {}
    for b in range(4):
        for m, channels in ((0, range(3)), (1, range(3, 7))):
            part = cube[:, 50 * b : 50 * b + 50][:, :, list(channels)]
            out[b * 10_000 + m] = part.sum(1) if kind == "tis" else part.sum(2)
    return out


def names_of(spark, data):
    """The bins that the query's own cubes have, from the binned scans."""
    from retort.plans.model_queries import _binned

    return {(r.mz, r.mz_bin) for r in _binned(spark, data)[0].select("mz", "mz_bin").distinct().collect()}, {(r.scan_idx, r.rt_bin) for r in _binned(spark, data)[0].select("scan_idx", "rt_bin").distinct().collect()}


@pytest.mark.parametrize(("name", "mode", "folds", "steps", "ahead"), [("survival_remove", "remove", 3, 99, 0.0), ("survival_add", "add", 3, 99, 0.0), ("survival_look_ahead", "add", 2, 3, 0.5)])
def test_survival(spark, data, cells, name, mode, folds, steps, ahead):
    ids, cube, label = cells
    by_channel, by_scan = names_of(spark, data)
    channel_bin, scan_bin = {m - 41: b for m, b in by_channel}, dict(by_scan)
    matrices = {}
    for rb in set(scan_bin.values()):
        for mb in set(channel_bin.values()):
            part = cube[:, [s for s, b in scan_bin.items() if b == rb]][:, :, [c for c, b in channel_bin.items() if b == mb]].sum(1)
            matrices[rb * 10_000 + mb] = part @ part.T
    fold = folds_of(spark, ids, label, folds)
    got = {(r.fold, r.step): r for r in registry.QUERIES[name](spark, data).collect()}
    for f in range(folds):
        want = V.greedy(matrices, label, np.flatnonzero(fold != f), np.flatnonzero(fold == f), mode, steps, 3, 1.0, ahead)
        assert len(want) == len([k for k in got if k[0] == f])
        for step, c, inner, outer in want:
            r = got[f, step]
            assert (r.rt_bin * 10_000 + r.mz_bin, r.inner_accuracy, r.outer_accuracy) == (c, pytest.approx(inner, abs=1e-6), pytest.approx(outer, abs=1e-6))


def test_cells_and_ranked_channels(spark, data, cells):
    ids, cube, label = cells
    by_channel, by_scan = names_of(spark, data)
    channel_bin, scan_bin = {m - 41: b for m, b in by_channel}, dict(by_scan)
    rows = np.arange(len(ids))
    for r in registry.QUERIES["cell_accuracy_map"](spark, data).collect():
        part = cube[:, [s for s, b in scan_bin.items() if b == r.rt_bin]][:, :, [c for c, b in channel_bin.items() if b == r.mz_bin]].sum(2)
        assert r.accuracy == pytest.approx(V.cv_score(part @ part.T, label, rows, 3, 1.0), abs=1e-6)
    spectrum = cube.sum(1)
    own = [V.cv_score(np.outer(c, c), label, rows, 3, 1.0) for c in spectrum.T]
    order = sorted(range(7), key=lambda c: (-round(own[c], 12), c))
    got = {r.k: r.accuracy for r in registry.QUERIES["ranked_channel_addition"](spark, data).collect()}
    for k in range(1, 8):
        x = spectrum[:, order[:k]]
        assert got[k] == pytest.approx(V.cv_score(x @ x.T, label, rows, 3, 1.0), abs=1e-6)


def test_random_channel_sets(spark, data, vectors):
    ids, x, label = vectors
    order = np.array(sorted(range(len(ids)), key=lambda k: str(ids[k])))
    got = registry.QUERIES["random_channel_sets"](spark, data).collect()
    assert len(got) == 16_000 and {r.k for r in got} == set(range(1, 33))
    for r in sorted(got, key=lambda r: r.set_id)[::997]:
        channels = [int(c) for c in r.channels.split(",")]
        z = x[order][:, channels]
        assert len(channels) == r.k == r.set_id // 500 + 1
        assert r.accuracy == pytest.approx(V.cv_score(z @ z.T, label[order], np.arange(len(ids)), 3, 1.0), abs=1e-6)


def test_concatenated_features(spark, data, cells):
    ids, cube, label = cells
    fold = folds_of(spark, ids, label, 5)
    x = cube.reshape(len(ids), -1)
    got = {r.split_id: r for r in registry.QUERIES["classify_ridge_concatenated"](spark, data).collect()}
    for f in np.unique(fold):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        assert got[int(f)].accuracy == pytest.approx(np.mean(D.ridge_classes(x @ x.T, label, train, test)[0] == label[test]), abs=1e-6)


def test_leave_one_out_on_all_features(spark, data, vectors):
    ids, x, label = vectors
    y = label.astype(float)[:, None]
    got = {r.sample_id: r.y_pred for r in registry.QUERIES["vintage_loo_all_features"](spark, data).collect()}
    for k in range(0, len(ids), 17):
        train = np.delete(np.arange(len(ids)), k)
        assert got[ids[k]] == pytest.approx(D.dual_ridge(x @ x.T, y, train, np.array([k]), 1.0)[0, 0], abs=1e-5)
    weights = []
    for k in range(len(ids)):
        train = np.delete(np.arange(len(ids)), k)
        z = (x[train] - x[train].mean(0)) / x[train].std(0)
        weights.append(np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y[train, 0] - y[train].mean())))
    told = {r.pos: r for r in registry.QUERIES["vintage_loo_scaled_all_features"](spark, data).collect()}
    assert np.allclose([told[p]["mean"] for p in range(x.shape[1])], np.mean(weights, 0), atol=1e-5) and np.allclose([told[p]["std"] for p in range(x.shape[1])], np.std(weights, 0), atol=1e-5)


def test_embedding_quality_and_best_k(spark, data, vectors):
    ids, x, label = vectors
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    own = np.array([d[k, (label == label[k]) & (np.arange(len(ids)) != k)].mean() if (label == label[k]).sum() > 1 else np.nan for k in range(len(ids))])
    apart = np.array([min(d[k, label == c].mean() for c in np.unique(label) if c != label[k]) for k in range(len(ids))])
    s = np.where(np.isnan(own), 0, (apart - own) / np.maximum(own, apart))
    q = registry.QUERIES["embedding_quality"](spark, data).collect()[0]
    assert q.silhouette == pytest.approx(s.mean(), abs=1e-5)
    best = registry.QUERIES["kmeans_best_k"](spark, data).collect()
    assert sorted(r.k for r in best) == list(range(2, 10))
    assert [r.k for r in best if r.best] == [max(best, key=lambda r: (r.silhouette, -r.k)).k]
