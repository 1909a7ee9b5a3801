"""Alignment by chains of peaks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import align as A


def test_chain_moves_later_peaks_along():
    one = np.ones(4)
    # 20 -> 23 moves the peak at 40 to 43, near 45, and that moves 60 to 65
    assert A.chain_peaks(np.array([23, 45, 66]), one[:3], np.array([20, 40, 60]), one[:3], 4) == [(0, 0), (23, 20), (45, 40), (66, 60)]
    # without the chain 60 would be 6 away, beyond the tolerance; a peak too far is passed over
    assert A.chain_peaks(np.array([23, 45, 66]), one[:3], np.array([20, 60]), one[:2], 3) == [(0, 0), (23, 20), (66, 60)]
    assert A.chain_peaks(np.array([23]), one[:1], np.array([20, 22]), one[:2], 5) == [(0, 0), (23, 20)]
    assert A.chain_peaks(np.array([], int), one[:0], np.array([20]), one[:1], 5) == [(0, 0)]


def test_neighbours_are_judged_by_the_later_peaks():
    ref, own = np.array([10, 16, 30, 50]), np.array([12, 26, 46])
    w = np.ones(4)
    assert A.chain_peaks(ref, w, own, w[:3], 6)[1] == (10, 12)
    assert A.chain_peaks(ref, w, own, w[:3], 6, 1) == [(0, 0), (16, 12), (30, 26), (50, 46)]


@pytest.mark.parametrize("neighbours", [0, 1])
def test_stretched_run_is_brought_back(spark, neighbours):
    at = np.arange(120)
    run = lambda peaks: sum(np.exp(-0.5 * ((at - p) / 2.5) ** 2) * h for p, h in zip(peaks, (90, 60, 80), strict=True))
    data = [(i, int(t), m, float(v * (m - 39))) for i, peaks in (("ref", (25, 60, 95)), ("own", (25, 64, 101))) for m in (40, 41) for t, v in enumerate(run(peaks))]
    scans = spark.createDataFrame(data, "sample_id string, scan_idx int, mz int, intensity double").repartition(3)
    ref = spark.createDataFrame([("ref",)], "sample_id string")
    out = A.align_to_reference(scans, ref, 120, sigma=1, most=8, ref_segments=3, segments=3, tolerance=8, how="chain", neighbours=neighbours)
    v = np.array([r.intensity for r in out.where("mz = 41 AND sample_id = 'own'").orderBy("scan_idx").collect()])
    assert A.segment_peaks(v, 3).tolist() == [25, 60, 95]
    assert out.where("sample_id = 'ref'").agg(F.max(F.abs("scan_lag"))).first()[0] == 0
    with pytest.raises(ValueError):
        A.align_to_reference(scans, "ref", 120, how="spline")
