"""Retention-time alignment of chromatograms to a reference run.

Only the reference's chromatogram and peak spectra are sent to the samples; each sample
is one row. The lag curve through matched peaks is piecewise linear, or a smoothing
spline whose bound is chosen by what the warped chromatogram loses to the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.operators.signals import gaussian_kernel, prominence
from retort.operators.spline import SmoothingSpline, best_smoothing


def smooth_trace(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the edges reflected."""
    k = np.array(gaussian_kernel(sigma))
    r = len(k) // 2
    return np.convolve(np.pad(x, r, mode="symmetric") if r <= len(x) else np.pad(x, r, mode="edge"), k, mode="valid")


def best_lag(reference: np.ndarray, target: np.ndarray, most: int) -> int:
    """How many scans the target lags behind the reference, by mean-centred cross-correlation within +-most; ties to the smallest."""
    n = min(len(reference), len(target))
    a, b = reference[:n] - reference[:n].mean(), target[:n] - target[:n].mean()
    size = 1 << (2 * n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)
    lags = np.array(sorted(range(-min(most, n - 1), min(most, n - 1) + 1), key=lambda v: (abs(v), v)))
    return int(lags[np.argmax(np.round(c[lags % size], 9))])


def window_lags(reference: np.ndarray, target: np.ndarray, size: int, most: int, how: str = "corr") -> np.ndarray:
    """Best lag of each window by correlation, or by the smallest l1, l2 or mse distance, of standardised signals."""

    def z(x: np.ndarray) -> np.ndarray:
        s = x.std()
        return (x - x.mean()) / s if s > 0 else x * 0

    out = []
    for a in range(0, len(reference) - size + 1, size):
        best, found = -np.inf, 0
        for lag in sorted(range(-most, most + 1), key=lambda v: (abs(v), v)):
            if 0 <= a + lag and a + lag + size <= len(target):
                x, y = z(reference[a : a + size]), z(target[a + lag : a + lag + size])
                s = {"corr": lambda x=x, y=y: x @ y, "l1": lambda x=x, y=y: -np.abs(x - y).sum(), "l2": lambda x=x, y=y: -np.sqrt(((x - y) ** 2).sum()), "mse": lambda x=x, y=y: -((x - y) ** 2).mean()}[how]()
                if s > best + 1e-12:
                    best, found = s, lag
        out.append(found)
    return np.array(out)


def scaled_trace(x: np.ndarray, scale: float) -> np.ndarray:
    """The trace resampled to ``scale`` times its length, the ends kept."""
    return np.interp(np.linspace(0, len(x) - 1, int(len(x) * scale)), np.arange(len(x)), x)


def cross_correlation(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The sums over t of x[t + lag] * y[t] for the lags -most to most, by one product of transforms."""
    size = 1 << (len(x) + len(y) + most).bit_length()
    c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    return c[np.arange(-most, most + 1) % size]


def scale_and_lag(reference: np.ndarray, target: np.ndarray, most: int, scales: list[float]) -> tuple[float, int, float]:
    """(scale, lag, score): the stretch of the target, and the scans by which it then has to move, that agree best with the reference.

    ``score`` is the plain cross-correlation, rounded to 9 digits; ties go to the first
    scale, then to the smallest lag.
    """
    best = (-np.inf, 0.0, 0)
    for scale in scales:
        c = np.round(cross_correlation(reference, scaled_trace(target, scale), most), 9)
        k = int(np.argmax(c))
        if c[k] > best[0]:
            best = (float(c[k]), scale, k - most)
    return best[1], best[2], best[0]


def leading_lag(reference: np.ndarray, target: np.ndarray, sigma: float, most: int, share: int = 3) -> tuple[int, float]:
    """(lag, score) by the mean-centred leading parts of the smoothed traces: the best lag of all, then brought into -most to most."""
    n = min(len(reference), len(target)) // share
    x, y = (smooth_trace(t, sigma)[:n] if sigma else t[:n] for t in (reference, target))
    c = np.round(cross_correlation(x - x.mean(), y - y.mean(), n - 1), 9)
    k = int(np.argmax(c))
    return int(np.clip(k - (n - 1), -most, most)), float(c[k])


def global_lag(tics: DataFrame, reference: DataFrame, n_scans: int, most: int = 300, scales: list[float] | None = None, how: str = "scale", sigma: float = 0.0) -> DataFrame:
    """(sample_id, scale, lag, score) of each sample's chromatogram against that of the reference, a table of one sample_id.

    With ``how`` scale the stretches in ``scales`` are tried with all lags from -most to
    most (:func:`scale_and_lag`); with leading the mean-centred first thirds of the traces
    are compared at every lag and the best lag is cut to ``most`` (:func:`leading_lag`,
    scale 1). Traces are smoothed first if ``sigma`` is given. Missing scans count as 0,
    scans outside 0 to n_scans - 1 are left out. A sample is one row beside the
    reference's trace, and a lag search is one product of Fourier transforms.
    """
    if how not in ("scale", "leading"):
        raise ValueError("how must be scale or leading")
    trace = F.collect_list(F.struct("scan_idx", F.col("tic").cast("double").alias("tic"))).alias("_t")
    inside = tics.where(F.col("scan_idx").between(0, n_scans - 1))
    ref = inside.join(F.broadcast(reference.select("sample_id")), "sample_id", "left_semi").agg(trace).select(F.col("_t").alias("_ref"))  # one row

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                x, y = (np.zeros(n_scans) for _ in range(2))
                for t, cells in ((x, row[2]), (y, row[1])):
                    for cell in cells:
                        t[cell["scan_idx"]] += cell["tic"] or 0
                if how == "leading":
                    lag, score = leading_lag(x, y, sigma, most)
                    out.append((row[0], 1.0, lag, score))
                else:
                    x, y = (smooth_trace(t, sigma) if sigma else t for t in (x, y))
                    out.append((row[0], *scale_and_lag(x, y, most, scales or [1.0])))
            yield pd.DataFrame(out, columns=["sample_id", "scale", "lag", "score"])

    each = inside.groupBy("sample_id").agg(trace).crossJoin(ref)
    return each.mapInPandas(run, f"sample_id {dict(tics.dtypes)['sample_id']}, scale double, lag int, score double")


def peak_candidates(peaks: DataFrame, reference: DataFrame, scans: DataFrame, tolerance: int) -> DataFrame:
    """(sample_id, ref_at, own_at, r): peaks of samples within the tolerance of a peak of the reference, and the correlation of their spectra.

    ``peaks`` is (sample_id, scan_idx), ``reference`` (scan_idx), the reference's peaks with
    their spectra (scan_idx, mz, intensity). Peaks meet by stretches of the tolerance, an
    equi join of each peak's whole spectrum with those of the reference. r is over all channels of the table, missing cells as 0; a flat spectrum
    has none and its pairs are left out.
    """
    channels = scans.agg(F.count_distinct("mz").alias("_m"))

    def spectrum(cells: DataFrame, *keys: str) -> DataFrame:
        """Each scan's cells as one array, with their sum and sum of squares."""
        v = cells.groupBy(*keys, "mz").agg(F.sum("intensity").alias("v"))
        return v.groupBy(*keys).agg(F.collect_list(F.struct("mz", "v")).alias("_v"), F.sum("v").alias("_s"), F.sum(F.col("v") * F.col("v")).alias("_q"))

    width = max(1, tolerance)
    own = spectrum(scans.join(peaks.select("sample_id", "scan_idx").distinct(), ["sample_id", "scan_idx"], "left_semi"), "sample_id", "scan_idx").select("sample_id", F.col("scan_idx").alias("own_at"), F.expr(f"scan_idx div {width}").alias("_at"), F.col("_v").alias("_y"), F.col("_s").alias("_b"), F.col("_q").alias("_bb"))
    x = F.map_from_entries(F.filter("_v", lambda e: e["mz"].isNotNull()))
    ref = spectrum(reference, "scan_idx").select(F.col("scan_idx").alias("ref_at"), x.alias("_x"), F.col("_s").alias("_a"), F.col("_q").alias("_aa"))
    near = ref.withColumn("_at", F.explode(F.expr(f"sequence(ref_at div {width} - 1, ref_at div {width} + 1)")))
    full = own.join(F.broadcast(near), "_at").where(F.abs(F.col("own_at") - F.col("ref_at")) <= tolerance).crossJoin(channels)  # the peaks of one run, and one number
    both = F.aggregate("_y", F.lit(0.0), lambda t, e: t + F.coalesce(e["v"] * F.try_element_at("_x", e["mz"]), F.lit(0.0)).cast("double"))
    norm = F.sqrt((F.col("_m") * F.col("_aa") - F.col("_a") * F.col("_a")) * (F.col("_m") * F.col("_bb") - F.col("_b") * F.col("_b")))
    r = (F.col("_m") * both - F.col("_a") * F.col("_b")) / norm
    return full.where(norm > 0).select("sample_id", "ref_at", "own_at", r.alias("r"))


def matched_peaks(candidates: DataFrame, least_r: float) -> DataFrame:
    """(sample_id, ref_at, own_at, r) of the candidates that match: reference peaks in order each take the best correlated peak after the last one taken.

    r is rounded to 12 digits, has to be above ``least_r``, and ties go to the earlier
    peak. A sample's candidates are one array, folded from left to right.
    """
    kind = dict(candidates.dtypes)["own_at"]
    one = F.struct(F.round("r", 12).alias("r"), (-F.col("own_at")).cast(kind).alias("back"))
    by_ref = candidates.where(F.col("r") > least_r).groupBy("sample_id", "ref_at").agg(F.collect_list(one).alias("found"))
    listed = by_ref.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ref_at", "found"))).alias("refs"))
    empty = F.expr(f"named_struct('last', cast(-1 AS {kind}), 'taken', cast(array() AS array<struct<ref_at: {dict(candidates.dtypes)['ref_at']}, own_at: {kind}, r: double>>))")

    def take(state, ref):
        best = F.array_max(F.filter(ref["found"], lambda c: -c["back"] > state["last"]))
        new = F.struct((-best["back"]).cast(kind).alias("last"), F.concat(state["taken"], F.array(F.struct(ref["ref_at"].alias("ref_at"), (-best["back"]).cast(kind).alias("own_at"), best["r"].alias("r")))).alias("taken"))
        return F.when(best.isNull(), state).otherwise(new)

    folded = listed.select("sample_id", F.explode(F.aggregate("refs", empty, take, lambda s: s["taken"])).alias("t"))
    return folded.select("sample_id", "t.ref_at", "t.own_at", "t.r")


def lag_profile(tics: DataFrame, reference: DataFrame, n_scans: int, size: int, most: int, how: str = "corr", sigma: float = 0) -> DataFrame:
    """(sample_id, window, lag): where each window of the reference's chromatogram lies best in each sample (``window_lags``).

    ``tics`` is (sample_id, scan_idx, tic), ``reference`` a table of one sample_id. Missing
    scans count as 0, scans from ``n_scans`` on are left out, and with ``sigma`` both
    traces are smoothed first. Each sample is one row beside the reference's short trace.
    """
    trace = F.collect_list(F.struct("scan_idx", F.col("tic").cast("double").alias("tic"))).alias("_t")
    inside = tics.where(F.col("scan_idx").between(0, n_scans - 1))
    ref = inside.join(F.broadcast(reference.select("sample_id")), "sample_id", "left_semi").agg(trace).select(F.col("_t").alias("_ref"))  # one row
    kind = dict(tics.dtypes)["sample_id"]

    def dense(cells) -> np.ndarray:
        x = np.zeros(n_scans)
        for cell in cells:
            x[cell["scan_idx"]] += cell["tic"] or 0
        return smooth_trace(x, sigma) if sigma else x

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                lags = window_lags(dense(row[2]), dense(row[1]), size, most, how)
                yield pd.DataFrame({"sample_id": row[0], "window": np.arange(len(lags), dtype=np.int32), "lag": lags.astype(np.int32)})

    each = inside.groupBy("sample_id").agg(trace).crossJoin(ref)
    return each.mapInPandas(run, f"sample_id {kind}, window int, lag int")


def segment_peaks(x: np.ndarray, segments: int) -> np.ndarray:
    """The tallest strict local maximum of each equal segment; segments without one are passed over."""
    inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
    edges = [k * (len(x) // segments) for k in range(segments)] + [len(x)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = inner[(inner >= a) & (inner < b)]
        if len(own):
            out.append(own[x[own].argmax()])
    return np.array(out, int)


def match_peaks(ref_at: np.ndarray, ref_spectra: np.ndarray, at: np.ndarray, spectra: np.ndarray, tolerance: int, least_r: float) -> list[tuple[int, int]]:
    """(reference, target) places: the best correlated spectrum within the tolerance, target places increasing."""

    def unit(m: np.ndarray) -> np.ndarray:
        c = m - m.mean(1, keepdims=True)
        n = np.linalg.norm(c, axis=1, keepdims=True)
        return np.divide(c, n, out=np.zeros_like(c), where=n > 0)

    r = unit(ref_spectra) @ unit(spectra).T if len(at) and len(ref_at) else np.zeros((len(ref_at), len(at)))
    pairs, last = [], -1
    for k, p in enumerate(ref_at):
        near = [j for j in range(len(at)) if abs(at[j] - p) <= tolerance and at[j] > last and r[k, j] > least_r]
        if near:
            j = max(near, key=lambda j: (r[k, j], -j))
            pairs.append((int(p), int(at[j])))
            last = at[j]
    return pairs


def chain_peaks(ref_at: np.ndarray, ref_weight: np.ndarray, at: np.ndarray, weight: np.ndarray, tolerance: int, neighbours: int = 0) -> list[tuple[int, int]]:
    """(reference, target) places of a chain of peaks, from (0, 0) on; each link moves all later target peaks by its lag.

    A target peak meets the reference peak nearest to where the chain has moved it, or,
    with ``neighbours``, that one of so many on either side after which the later peaks
    lie nearest to reference peaks, weighted by the smaller over the larger prominence.
    Links outside the tolerance, or that would go backwards, are passed over.
    """

    def distance(k: int, lag: int) -> float:
        later = at[k:] + lag
        near = np.abs(ref_at[None, :] - later[:, None]).argmin(1)
        low, high = np.minimum(ref_weight[near], weight[k:]), np.maximum(ref_weight[near], weight[k:])
        w = np.divide(low, high, out=np.zeros(len(later)), where=high > 0)
        return float((np.abs(ref_at[near] - later) * w).sum() / w.sum()) if w.sum() else np.inf

    chain, lag = [(0, 0)], 0
    for k, t in enumerate(at if len(ref_at) else []):
        nearest = int(np.abs(ref_at - (t + lag)).argmin())
        close = [j for j in range(max(0, nearest - neighbours), min(len(ref_at), nearest + neighbours + 1)) if abs(ref_at[j] - (t + lag)) <= tolerance and ref_at[j] > chain[-1][0] and t > chain[-1][1]]
        if close:
            j = min(close, key=lambda j: (distance(k, int(ref_at[j] - t)), abs(ref_at[j] - (t + lag)), j)) if neighbours else close[0]
            lag = int(ref_at[j] - t)
            chain.append((int(ref_at[j]), int(t)))
    return chain


def _unit_range(x: np.ndarray) -> np.ndarray:
    return (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else x * 0


def spline_shift(reference: np.ndarray, target: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """The shift at each scan of the reference from matched (reference, target) places, by the spline that warps the target best."""
    at = np.arange(len(reference))
    x, y = _unit_range(reference), _unit_range(target)
    loss = lambda s: float(((np.interp(at + s(at), at, y) - x) ** 2).mean())
    return best_smoothing(SmoothingSpline(knots[:, 0], knots[:, 1] - knots[:, 0], 0.0, degree), loss)(at)


def align_to_reference(scans: DataFrame, reference, n_scans: int, sigma: float = 50, most: int = 100, ref_segments: int = 5, segments: int = 15, tolerance: int = 150, least_r: float = 0.8, how: str = "curve", neighbours: int = 0, degree: int = 3) -> DataFrame:
    """Scans with intensities warped onto the retention axis of the reference, a sample_id or a table of one.

    The whole sample is moved by its global lag, then by the lag curve through matched
    peaks; with fewer than two matches only the global lag applies. With ``how`` smooth the
    curve is a smoothing spline of the degree, whose bound gives the warped chromatogram
    the least squared distance from the reference, both from 0 to 1. With ``how`` chain the
    stretches between successive matched peaks are scaled to those of the reference
    instead (``chain_peaks``), and what follows the last one moves by its lag. Missing
    cells count as 0. The result has a row for each scan and channel of the reference's
    axis, with the global lag and the lag at the scan.
    """
    if how not in ("curve", "smooth", "chain"):
        raise ValueError("how must be curve, smooth or chain")
    sides = ["scan_idx", "mz", "intensity"]
    lists = [F.col(f"_c.{s}") for s in sides]
    collected = F.array_sort(F.collect_list(F.struct(*sides))).alias("_c")
    own = scans.join(F.broadcast(reference.select("sample_id")), "sample_id", "left_semi") if isinstance(reference, DataFrame) else scans.where(F.col("sample_id") == reference)  # one row
    ref = own.agg(collected).select(*[c.alias(f"ref_{s}") for c, s in zip(lists, sides, strict=True)])
    kind = dict(scans.dtypes)["sample_id"]

    def dense(scan: np.ndarray, mz: np.ndarray, value: np.ndarray, channels: np.ndarray) -> np.ndarray:
        m = np.zeros((n_scans, len(channels)))
        inside = (scan >= 0) & (scan < n_scans)
        np.add.at(m, (scan[inside], np.searchsorted(channels, mz[inside])), value[inside].astype(float))
        return m

    def moved(m: np.ndarray, to: np.ndarray) -> np.ndarray:
        at = np.arange(n_scans)
        return np.stack([np.interp(to, at, c) for c in m.T], 1)

    def warp(row) -> pd.DataFrame:
        channels = np.unique(np.r_[row.ref_mz, row.mz])
        a, b = dense(row.ref_scan_idx, row.ref_mz, row.ref_intensity, channels), dense(row.scan_idx, row.mz, row.intensity, channels)
        x, y = a.sum(1), b.sum(1)
        lag = best_lag(smooth_trace(x, sigma)[: max(2, n_scans // 3)], smooth_trace(y, sigma)[: max(2, n_scans // 3)], most)
        at = np.arange(n_scans)
        b = moved(b, at + lag)
        y = b.sum(1)
        p, q = segment_peaks(x, ref_segments), segment_peaks(y, segments)
        shift = np.zeros(n_scans)
        if how != "chain":
            pairs = match_peaks(p, a[p], q, b[q], tolerance, least_r)
            if len(pairs) >= 2:
                knots = np.array(pairs)
                shift = np.interp(at, knots[:, 0], knots[:, 1] - knots[:, 0]) if how == "curve" else spline_shift(x, y, knots, degree)
        else:
            knots = np.array(chain_peaks(p, prominence(x, p), q, prominence(y, q), tolerance, neighbours))
            shift = np.interp(at, knots[:, 0], knots[:, 1] - knots[:, 0])
        b = moved(b, at + shift)
        return pd.DataFrame({"sample_id": row.sample_id, "scan_idx": np.repeat(at, len(channels)), "mz": np.tile(channels, n_scans), "intensity": b.ravel(), "lag": lag, "scan_lag": np.repeat(lag + shift, len(channels))})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield warp(row)

    each = scans.groupBy("sample_id").agg(collected).select("sample_id", *[c.alias(s) for c, s in zip(lists, sides, strict=True)]).crossJoin(ref)  # one row
    return each.mapInPandas(run, f"sample_id {kind}, scan_idx int, mz int, intensity double, lag int, scan_lag double")
