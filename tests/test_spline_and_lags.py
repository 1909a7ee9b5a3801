"""Smoothing splines against dense solutions, lags against plain sums, peak matches against the match in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import align as A
from retort.operators import spline as S

R = np.random.default_rng(2)


@pytest.mark.parametrize("degree", [1, 2, 3, 4, 5])
def test_zero_smoothing_interpolates_and_much_gives_the_polynomial(degree):
    x = np.sort(R.choice(500, 14, replace=False)).astype(float)
    y = R.normal(size=14).cumsum()
    assert np.allclose(S.SmoothingSpline(x, y, 0.0, degree)(x), y)
    flat = S.SmoothingSpline(x, y, 1e9, degree)
    assert np.allclose(flat(x), np.polyval(np.polyfit(x, y, degree), x), atol=1e-4)
    for s in (flat.most * 0.1, flat.most * 0.7):
        assert abs(flat.smooth(s).residual(flat.c) - s) < 1e-6 * flat.most


@pytest.mark.parametrize("degree", [1, 3])
def test_banded_equals_dense(degree):
    x = np.sort(R.choice(300, 20, replace=False)).astype(float)
    spline = S.SmoothingSpline(x, R.normal(size=20), 1.0, degree)
    for weight in (1e-6, 1.0, 1e4):
        a = spline._gram + weight * spline._penalty
        assert np.allclose(np.triu(a, degree + 2), 0) and np.allclose(spline._fit(weight), np.linalg.solve(a, spline._b.T @ spline.y))


def test_basis_is_a_partition_of_one_with_known_derivatives():
    x = np.array([0, 1, 2, 4, 7, 8, 9.5, 11])
    t = S.knots_of(x, 3)
    at = np.linspace(0, 11, 50)
    assert np.allclose(S.basis(t, 3, at).sum(1), 1) and len(t) == len(x) + 4
    cubic = np.linalg.solve(S.basis(t, 3, x), x**3)
    assert np.allclose(S.jumps(t, 3) @ cubic, 0, atol=1e-9)  # a cubic has one third derivative everywhere
    one = S.SmoothingSpline(np.array([0.0, 1, 3]), np.array([0.0, 2, 2]), 0, 1)
    assert np.allclose(one._d @ one.c * 1.0, (0 - 2 * 3))  # slopes over the range: 2 then 0, times its length


def test_bound_is_chosen_by_the_loss():
    x = np.linspace(0, 100, 15)
    true = 3 + 0.05 * x
    spline = S.SmoothingSpline(x, true + R.normal(size=15), 0.0, 3)
    chosen = S.best_smoothing(spline, lambda s: float(((s(x) - true) ** 2).mean()))
    assert chosen.s > 0 and ((chosen(x) - true) ** 2).mean() < 0.6
    assert S.best_smoothing(S.SmoothingSpline(x, np.sin(x), 0.0, 3), lambda s: float(((s(x) - np.sin(x)) ** 2).mean())).s == 0
    with pytest.raises(ValueError):
        S.SmoothingSpline(np.array([0.0, 0.0]), np.array([1.0, 2.0]))


def test_spline_alignment_follows_a_bent_axis(spark):
    at = np.arange(200)
    bent = 3 * np.sin(at / 60)
    peak = lambda t: sum(np.exp(-(((t - c) / 3.0) ** 2)) * h for c, h in ((25, 9), (60, 7), (95, 10), (130, 6), (170, 8)))
    rows = [("r", int(k), m, float(v * m)) for m in (41, 42) for k, v in zip(at, peak(at), strict=True)] + [("s", int(k), m, float(v * m)) for m in (41, 42) for k, v in zip(at, peak(at - bent), strict=True)]
    scans = spark.createDataFrame(rows, "sample_id string, scan_idx int, mz int, intensity double")
    lost = {}
    for how in ("curve", "smooth"):
        out = A.align_to_reference(scans, "r", 200, sigma=1, most=3, ref_segments=5, segments=5, tolerance=8, how=how).where("sample_id = 's'")
        got = out.groupBy("scan_idx").agg(F.sum("intensity").alias("v")).orderBy("scan_idx").toPandas()["v"].to_numpy()
        lost[how] = ((got - 83 * peak(at)) ** 2).mean()
    raw = ((83 * (peak(at - bent) - peak(at))) ** 2).mean()
    assert max(lost.values()) < 0.1 * raw


def test_lags_are_those_of_plain_sums(spark):
    x, y = R.random(90), R.random(90)
    for most in (5, 80):
        plain = [sum(x[t + lag] * y[t] for t in range(90) if 0 <= t + lag < 90) for lag in range(-most, most + 1)]
        assert np.allclose(A.cross_correlation(x, y, most), plain)
    moved = np.r_[np.zeros(7), x[:-7]]
    assert A.scale_and_lag(x, moved, 20, [1.0])[1] == -7
    hills = sum(np.exp(-(((np.arange(90) - c) / 2.5) ** 2)) for c in (10, 31, 55))
    long = A.scaled_trace(hills, 1.25)
    assert len(long) == 112 and A.scale_and_lag(hills, long[:90], 4, [0.5, 0.8, 1.0])[:2] == (0.8, 0)
    assert A.leading_lag(x, moved, 0, 4)[0] == -4 and A.leading_lag(x, moved, 0, 10)[0] == -7
    tics = spark.createDataFrame([(n, k, float(v)) for n, t in (("a", x), ("b", moved)) for k, v in enumerate(t)], "sample_id string, scan_idx int, tic double")
    ref = tics.where("sample_id = 'a'").select("sample_id").distinct()
    for how in ("scale", "leading"):
        assert {r.sample_id: r.lag for r in A.global_lag(tics, ref, 90, 20, how=how).collect()} == {"a": 0, "b": -7}


def test_matches_over_tables_are_those_in_memory(spark):
    channels, runs = np.arange(40, 46), {}
    for n in ("r", "s", "t", "u"):
        at = np.sort(R.choice(120, 14, replace=False))
        runs[n] = (at, np.where(R.random((14, 6)) < 0.3, 0, R.integers(1, 50, (14, 6))).astype(float))
    runs["u"][1][3] = 7.0  # a flat spectrum
    rows = [(n, int(p), int(m), float(v)) for n, (at, spectra) in runs.items() for p, row in zip(at, spectra, strict=True) for m, v in zip(channels, row, strict=True) if v]
    scans = spark.createDataFrame(rows, "sample_id string, scan_idx int, mz int, intensity double")
    peaks = spark.createDataFrame([(n, int(p)) for n, (at, _) in runs.items() for p in at], "sample_id string, scan_idx int")
    candidates = A.peak_candidates(peaks, scans.where("sample_id = 'r'").drop("sample_id"), scans, 9)
    got = {}
    for r in A.matched_peaks(candidates, 0.1).orderBy("ref_at").collect():
        got.setdefault(r.sample_id, []).append((r.ref_at, r.own_at))
    ref_at, ref = runs["r"]
    for n, (at, spectra) in runs.items():
        assert got.get(n, []) == A.match_peaks(ref_at, ref, at, spectra, 9, 0.1)
