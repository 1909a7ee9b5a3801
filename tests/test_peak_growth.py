"""Steps on peaks whose cost must not be that of a group for each sample, or of samples times reference peaks."""

import numpy as np

from retort.operators import align as A
from retort.operators import signals as S


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_prominences_of_many_samples(spark):
    g = np.random.default_rng(5)
    traces = {k: [float(v) for v in g.integers(0, 6, 40)] for k in range(30)}
    traces[30] = [1.0, float("nan"), 3.0, 2.0, 5.0, 1.0]
    traces[31] = [1.0, 1.0]
    tics = spark.createDataFrame([(k, 3 * j, v) for k, t in traces.items() for j, v in enumerate(t)], "sample_id long, scan_idx int, tic double").repartition(5)
    out = S.peak_prominences(tics)
    got = {(r.sample_id, r.scan_idx): (r.tic, r.prominence) for r in out.collect()}
    want = {}
    for r in S.local_maxima(tics).collect():
        if r.scan_idx % 3 == 0 and r.scan_idx // 3 < len(traces[r.sample_id]):
            v = np.array(traces[r.sample_id])
            want[r.sample_id, r.scan_idx] = (float(v[r.scan_idx // 3]), float(S.prominence(v, np.array([r.scan_idx // 3]))[0]))
    want = {k: tuple(None if np.isnan(x) else x for x in v) for k, v in want.items()}  # NaN leaves a task as null
    assert len(got) > 100 and str(sorted(got.items())) == str(sorted(want.items()))
    assert "CoGroup" not in plan(out)


def test_distance_makes_no_product_with_the_reference(spark):
    peaks = spark.range(4000).selectExpr("id div 4 AS sample_id", "cast(id % 4 * 10 AS int) AS scan_idx", "1.0D AS prominence")
    ref = spark.createDataFrame([(k, 1.0) for k in range(1, 40)], "scan_idx int, prominence double")
    out = S.weighted_peak_distance(peaks, ref)
    assert {r.distance for r in out.collect()} == {0.25} and "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_candidates_meet_in_one_join(spark):
    """A spectrum is one row: its cells are not joined with the pairs of peaks; a channel without a name counts in the sums alone."""
    scans = spark.createDataFrame([(s, k, m, float((s + 2) * k % 5 + m % 3 * k)) for s in range(3) for k in range(1, 9) for m in (1, 2, 3)] + [(1, 4, None, 2.0)], "sample_id long, scan_idx int, mz int, intensity double")
    peaks = scans.where("scan_idx % 2 = 0").select("sample_id", "scan_idx").distinct()
    out = A.peak_candidates(peaks, scans.where("sample_id = 0 AND scan_idx % 2 = 0").drop("sample_id"), scans, 2)
    cells = {}
    for r in scans.collect():
        cells.setdefault((r.sample_id, r.scan_idx), {})[r.mz] = r.intensity
    want = {}
    for (s, k), y in cells.items():
        for j in range(2, 9, 2):
            if k % 2 == 0 and abs(k - j) <= 2:
                x = cells[0, j]
                a, b, ab = sum(x.values()), sum(y.values()), sum(x[m] * y[m] for m in x)
                norm = (3 * sum(v * v for v in x.values()) - a * a) * (3 * sum(v * v for v in y.values()) - b * b)
                if norm > 0:
                    want[s, j, k] = round((3 * ab - a * b) / norm**0.5, 9)
    assert want and {(r.sample_id, r.ref_at, r.own_at): round(r.r, 9) for r in out.collect()} == want
    assert plan(out).split("Initial Plan")[-1].count("Join") <= 3
