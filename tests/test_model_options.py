"""Dual folds, target components, taster factors, split numbering, prefix means and window indices against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import models as D
from retort.operators import moments as X
from retort.operators import signals as S
from retort.operators import splits as P
from retort.operators import statistics as T
from retort.plans import jobs as J

R = np.random.default_rng(11)


def test_dual_folds_are_those_of_the_primal_form(spark):
    n, p = 40, 70
    label = np.arange(n) % 3
    label[0] = 9  # a class that has no training row in one fold
    x = R.normal(size=(n, p)) + label[:, None] * (np.arange(p) < 5)
    rows = spark.createDataFrame([(k, [float(v) for v in a]) for k, a in enumerate(x)], "sample_id long, x array<double>")
    labels = spark.createDataFrame([(k, f"c{v}") for k, v in enumerate(label)], "sample_id long, label string")
    test = spark.createDataFrame([(f, k) for f in range(5) for k in range(n) if k % 5 == f] + [(7, k) for k in (0, 1, 2, 3)], "split_id int, sample_id long")
    long = rows.select("sample_id", F.posexplode("x").alias("pos", "value"))
    got = {(r.split_id, r.sample_id): (r.y_true, r.y_pred) for r in D.dual_folds(T.gram(long), labels, test, 2.0).collect()}
    want = {(r.split_id, r.sample_id): (r.y_true, r.y_pred) for r in X.classify(rows, labels, test, alpha=2.0).collect()}
    assert got == want and len(got) == n + 4


def test_too_many_samples_for_one_matrix(spark, monkeypatch):
    monkeypatch.setattr(D, "DUAL_MOST", 2)
    g = spark.createDataFrame([(a, b, float(a == b)) for a in range(3) for b in range(a, 3)], "a long, b long, dot double")
    labels = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(3)], "sample_id long, label string")
    with pytest.raises(Exception, match="too many"):
        D.dual_folds(g, labels, labels.select(F.lit(0).alias("split_id"), "sample_id").limit(1)).collect()


def test_target_components(spark):
    x, w = R.normal(size=(60, 4)), R.normal(size=(4, 3))
    y = x @ w + R.normal(size=(60, 3))
    rows = spark.createDataFrame([(k, [float(v) for v in a], [float(v) for v in b]) for k, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id long, x array<double>, y array<double>")
    test = spark.createDataFrame([(k % 4, k) for k in range(60)], "split_id int, sample_id long")
    told = lambda c: {(r.sample_id, r.attribute): r.y_pred for r in X.regress(rows, list("abc"), test, 1.0, components=c).collect()}
    plain, every, one = told(None), told(3), told(1)
    assert all(abs(plain[k] - every[k]) < 1e-9 for k in plain)
    for f in range(4):
        train, held = np.flatnonzero(np.arange(60) % 4 != f), np.flatnonzero(np.arange(60) % 4 == f)
        d, mean = x[train] - x[train].mean(0), y[train].mean(0)
        v = np.linalg.svd(y[train] - mean)[2][0]
        c = np.linalg.solve(d.T @ d + np.eye(4), d.T @ ((y[train] - mean) @ v))
        want = mean + np.outer((x[held] - x[train].mean(0)) @ c, v)
        assert np.allclose([[one[k, a] for a in "abc"] for k in held], want)


def test_taster_factors_from_inner_folds(spark):
    wines, tasters = [f"w{k:02d}" for k in range(12)], ["t1", "t2", "t3"]
    x = {w: R.normal(size=3) for w in wines}
    rows = [(f"{w}/{t}", w, t, [float(2 * x[w][0] * (1 + k) + R.normal() * 0.1), float(R.normal())]) for w in wines for k, t in enumerate(tasters)]
    wine_rows = spark.createDataFrame([(w, [float(a) for a in v]) for w, v in x.items()], "wine string, x array<double>")
    frame = spark.createDataFrame(rows, "row_id string, wine string, taster string, y array<double>")
    plain, scaled = (t.collect() for t in J.scaled_taster_model(wine_rows, frame, ["a", "b"], tasters, folds=3, inner=2, alpha=0.5))
    assert len(plain) == len(scaled) == 72 and {r.split_id for r in plain} == {0, 1, 2}
    full = {i: (w, t, np.r_[x[w], [float(t == o) for o in tasters]], np.array(y)) for i, w, t, y in rows}
    held = {r.split_id: {full[q.row_id][0] for q in plain if q.split_id == r.split_id} for r in plain}

    def ridge(train, test):
        a, b = np.array([full[i][2] for i in train]), np.array([full[i][3] for i in train])
        d = a - a.mean(0)
        w = np.linalg.solve(d.T @ d + 0.5 * np.eye(6), d.T @ (b - b.mean(0)))
        return {i: b.mean(0) + (full[i][2] - a.mean(0)) @ w for i in test}

    order = {}
    for split in held:
        h = {w: spark.createDataFrame([(w, split)], "wine string, split_id int").select(F.xxhash64("wine", "split_id", F.lit(1))).first()[0] for w in wines if w not in held[split]}
        order[split] = {w: k % 2 for k, w in enumerate(sorted(h, key=lambda w: (h[w], w)))}
    for split, out in held.items():
        train, test = [i for i in full if full[i][0] not in out], [i for i in full if full[i][0] in out]
        told = ridge(train, test)
        inner = {}
        for f in (0, 1):
            part = [i for i in train if order[split][full[i][0]] == f]
            inner |= ridge([i for i in train if i not in part], part)
        for t in tasters:
            own = [i for i in train if full[i][1] == t]
            p, y = np.array([inner[i] for i in own]), np.array([full[i][3] for i in own])
            factor = np.maximum(0, (p * y).sum(0) / (p * p).sum(0))
            for q, r in zip(sorted(plain, key=str), sorted(scaled, key=str), strict=True):
                if q.split_id == split and q.taster == t:
                    k = "ab".index(q.attribute)
                    assert abs(q.y_pred - told[q.row_id][k]) < 1e-9
            for r in scaled:
                if r.split_id == split and r.taster == t:
                    k = "ab".index(r.attribute)
                    assert abs(r.y_pred - told[r.row_id][k] * factor[k]) < 1e-9


def test_split_numbers_are_digits(spark):
    units = {"a": ["a1", "a2", "a3"], "b": ["b1", "b2"], "c": ["c1"]}
    samples = spark.createDataFrame([(f"{u}-{r}", c, u) for c, us in units.items() for u in us for r in (1, 2)], "sample_id string, label string, base string")
    got = {}
    for r in P.all_one_per_class(samples, "label", unit="base").collect():
        got.setdefault(r.split_id, set()).add(r.sample_id)
    want = [{f"{u}-{r}" for u in pick for r in (1, 2)} for pick in ((a, b, c) for c, b, a in itertools.product(units["c"], units["b"], units["a"]))]
    assert [got[k] for k in range(6)] == want and len(got) == 6
    part = {r.split_id for r in P.all_one_per_class(samples, "label", 4, 10, unit="base").collect()}
    assert part == {4, 5} and P.all_one_per_class(samples, "label", 6, 2, unit="base").count() == 0
    drawn = P.drawn_one_per_class(samples, "label", 300, unit="base").collect()
    assert len(drawn) == 300 * 6
    share = sum(r.sample_id == "a2-1" for r in drawn) / 300
    assert 0.2 < share < 0.47 and len({frozenset(r.sample_id for r in drawn if r.split_id == k) for k in range(300)}) == 6


def test_prefix_means_and_wines_without_replicates(spark):
    rows = [("D1-1", 0, 2.0), ("D1-2", 0, 4.0), ("D1-2", 1, float("nan")), ("D12", 0, 9.0), ("E1", 0, None), ("X", 0, 1.0)]
    traces = spark.createDataFrame(rows, "sample_id string, scan_idx int, value double")
    wines = spark.createDataFrame([("D1",), ("D1",), ("E1",), ("F",), (None,)], "wine string")
    got = {(r.wine, r.scan_idx): r.value for r in S.replicate_average(traces, wines, "scan_idx").collect()}
    assert got == {("D1", 0): 5.0, ("D1", 1): 0.0, ("E1", 0): None}
    assert {r.wine for r in S.without_replicates(traces, wines).collect()} == {"F", None}


def test_window_index_on_an_uneven_axis(spark):
    times = [(0, 5.0), (1, 9.0), (2, 7.0), (3, 30.0), (3, 31.0), (4, 31.0), (5, 400.0)]
    scans = spark.createDataFrame(times, "scan_idx int, rt_ms double")
    starts = [("a", -3.0), ("b", 5.0), ("c", 5.5), ("d", 9.0), ("e", 9.1), ("f", 31.0), ("g", 32.0), ("h", 400.0), ("i", 401.0)]
    got = {r.name: r.idx for r in S.window_index(scans, spark.createDataFrame(starts, "name string, at_ms double")).collect()}
    assert got == {n: min([i for i, t in times if t >= at], default=6) for n, at in starts}
