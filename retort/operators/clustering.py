"""K-means for several numbers of clusters at once, from weighted sums over points.

Equal points are one row with their number. A job passes once over the points for all
numbers of clusters, and its tasks return a few sums for each cluster, so the number of
jobs is that of one fit and none of them moves a point. Draws are hashes of the points
themselves, so a result does not depend on the order or partitions of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.sources.shared import stored

#: Rounds that draw candidates for the first centres, and starts from those for each k.
ROUNDS, STARTS = 5, 10


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c."""
    return ((x[:, None] - c) ** 2).sum(-1)


def _shifted(frames: Iterator[pd.DataFrame], columns: list[str], middle: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points less the middle, their numbers) of each frame."""
    for frame in frames:
        x = frame[columns].to_numpy(float)
        if not np.isfinite(x).all():
            raise ValueError("k-means needs finite points")
        if len(x):
            yield x - middle, frame["_n"].to_numpy(float)


class Points:
    """Distinct points of some columns with their numbers, written once."""

    def __init__(self, points: DataFrame, columns: list[str]):
        self.columns = columns
        same = points.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count("*").alias("_n"))
        self.data = stored(same.repartition(points.sparkSession.sparkContext.defaultParallelism), "points")
        about = self.data.agg(*[e for c in columns for e in (F.sum(F.col(c) * F.col("_n")) / F.sum("_n"), F.stddev_pop(c))]).collect()[0]
        if any(v is None or not np.isfinite(v) for v in about):
            raise ValueError("k-means needs points, and finite ones")
        self.middle, self.spread = np.array(about[::2]), np.array(about[1::2])

    def _added(self, each: dict[int, object], sums) -> dict[int, np.ndarray]:
        """The sums over all points of ``sums(x, n, what)`` for each of the given."""
        columns, middle = self.columns, self.middle

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for x, n in _shifted(frames, columns, middle):
                for k, what in each.items():
                    own = sums(x, n, what)
                    held[k] = held[k] + own if k in held else own
            if held:
                yield pd.DataFrame({"k": list(held), "m": [v.ravel() for v in held.values()]})

        out: dict[int, np.ndarray] = {}
        for r in self.data.mapInPandas(run, "k int, m array<double>").collect():  # a few rows of each task
            out[r["k"]] = out.get(r["k"], 0) + np.array(r["m"])
        return out

    def drawn(self, seed: int, known: np.ndarray, most: int) -> np.ndarray:
        """So many points, each with a chance by its number and squared distance from the known ones."""
        columns, middle, unit, width = self.columns, self.middle, np.where(self.spread > 0, self.spread, 1.0), len(self.columns)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, at = np.empty(0), np.empty((0, width))
            for x, n in _shifted(frames, columns, middle):
                # a last digit that differs by the order of a sum draws no other number
                own = pd.DataFrame(np.round(x / unit * 1e6).astype(np.int64)).assign(seed=seed)
                u = (pd.util.hash_pandas_object(own, index=False).to_numpy() >> np.uint64(11)) / 2.0**53
                key = n * (_squares(x, known).min(1) if len(known) else 1.0) / -np.log(np.maximum(u, 2.0**-60))
                best, at = np.r_[best, key], np.r_[at, x]
                top = np.argsort(-best, kind="stable")[:most]
                best, at = best[top], at[top]
            if len(best):
                yield pd.DataFrame({"key": best, "x": list(at)})

        found = [r for r in self.data.mapInPandas(run, "key double, x array<double>").collect() if r["key"] > 0]  # ``most`` rows of each task
        return np.array([r["x"] for r in sorted(found, key=lambda r: (-r["key"], r["x"]))[:most]], float).reshape(-1, width)

    def moments(self, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each k a row a centre: number of its points, sum of squared distances, sum of differences."""

        def sums(x: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
            d = _squares(x, c)
            a = d.argmin(1)
            return np.c_[np.bincount(a, n, len(c)), np.bincount(a, n * d.min(1), len(c)), *[np.bincount(a, n * (v - m[a]), len(c)) for v, m in zip(x.T, c.T, strict=True)]]

        return {k: m.reshape(len(centres[k]), -1) for k, m in self._added(centres, sums).items()}

    def silhouettes(self, centres: dict[int, np.ndarray]) -> dict[int, float]:
        """The mean silhouette by squared distances of each k, that of a point alone, or of one cluster, being 0."""
        about = {}
        for k, m in self.moments(centres).items():
            n = np.maximum(m[:, :1], 1)
            gap = m[:, 2:] / n
            about[k] = (centres[k], m[:, 0], centres[k] + gap, np.maximum(m[:, 1] / n[:, 0] - (gap * gap).sum(1), 0))

        def sums(x: np.ndarray, n: np.ndarray, what: tuple) -> np.ndarray:
            c, members, mean, spread = what
            a, row = _squares(x, c).argmin(1), np.arange(len(x))
            d = np.where(members > 0, _squares(x, mean) + spread, np.inf)  # the mean squared distance from a cluster's points
            own = d[row, a] * members[a] / np.maximum(members[a] - 1, 1)
            d[row, a] = np.inf
            apart = d.min(1)
            good = (members[a] > 1) & np.isfinite(apart) & (np.maximum(own, apart) > 0)
            s = np.where(good, (np.where(good, apart, 0) - own) / np.where(good, np.maximum(own, apart), 1), 0)
            return np.array([(n * s).sum(), n.sum()])

        return {k: float(s[0] / s[1]) for k, s in self._added(about, sums).items()}


def _first_centres(x: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The best of several weighted k-means++ fits of a few candidates."""
    if len(x) <= k:
        return x
    r, found = np.random.default_rng([0, k]), []
    for _ in range(STARTS):
        c = x[[r.choice(len(x), p=n / n.sum())]]
        while len(c) < k:
            d = n * _squares(x, c).min(1)
            if not d.sum() > 0:
                break
            c = np.r_[c, x[[r.choice(len(x), p=d / d.sum())]]]
        for _ in range(20):
            a = _squares(x, c).argmin(1)
            w = np.bincount(a, n, len(c))
            c = np.where(w[:, None] > 0, np.stack([np.bincount(a, n * v, len(c)) for v in x.T], 1) / np.maximum(w, 1e-300)[:, None], c)
        found.append(((n * _squares(x, c).min(1)).sum(), len(found), c))
    return min(found, key=lambda f: f[:2])[2]


def kmeans(points: Points, ks: list[int], iterations: int = 20, tolerance: float = 1e-4) -> dict[int, np.ndarray]:
    """Centres, less the middle of the points, for each k: Lloyd's steps from candidates drawn in rounds over all points."""
    known = points.drawn(0, np.empty((0, len(points.columns))), 1)
    for seed in range(1, ROUNDS + 1):
        known = np.r_[known, points.drawn(seed, known, 2 * max(ks))]
    weight = points.moments({0: known})[0][:, 0]
    centres = {k: _first_centres(known, weight, k) for k in ks}
    moving = dict(centres)
    for _ in range(iterations):
        for k, m in (points.moments(moving) if moving else {}).items():
            step = m[:, 2:] / np.maximum(m[:, :1], 1)
            centres[k] = moving[k] + step
            moving[k] = centres[k]
            if (step * step).sum(1).max() <= tolerance * tolerance:
                del moving[k]
    return centres
