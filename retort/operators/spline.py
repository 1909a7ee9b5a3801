"""Smoothing splines through a few points, in numpy: of a degree, with a bound on the squared residuals.

The spline has a knot at nearly every point, so that it can pass through all of them. What
is penalised is the jump of its last derivative at the inner knots: as the bound grows it
goes from interpolation to the polynomial of its degree. The normal equations are banded.
"""

from __future__ import annotations

import numpy as np


def knots_of(x: np.ndarray, degree: int) -> np.ndarray:
    """Knots of as many B-splines as points: the points but those next to the ends; for even degrees the places between points."""
    inner = x[(degree + 1) // 2 : len(x) - (degree + 1) // 2] if degree % 2 else ((x[1:] + x[:-1]) / 2)[degree // 2 : len(x) - 1 - degree // 2]
    return np.r_[[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)]


def basis(knots: np.ndarray, degree: int, at: np.ndarray) -> np.ndarray:
    """The values of all B-splines at the given places, a row each; beyond the ends the outer pieces go on."""
    n = len(knots) - degree - 1
    piece = np.clip(np.searchsorted(knots, at, side="right") - 1, degree, n - 1)
    local = np.ones((len(at), 1))
    for d in range(1, degree + 1):
        right = knots[piece[:, None] + np.arange(1, d + 1)]
        left = knots[piece[:, None] + np.arange(1 - d, 1)]
        part = local / (right - left)
        local = np.zeros((len(at), d + 1))
        local[:, :-1] = (right - at[:, None]) * part
        local[:, 1:] += (at[:, None] - left) * part
    out = np.zeros((len(at), n))
    np.put_along_axis(out, piece[:, None] + np.arange(-degree, 1), local, 1)
    return out


def jumps(knots: np.ndarray, degree: int) -> np.ndarray:
    """The matrix from B-spline coefficients to the jumps of the last derivative at the inner knots."""
    n = len(knots) - degree - 1
    m = np.eye(n)
    for d in range(degree):
        width = knots[degree + 1 : degree + n - d] - knots[d + 1 : n]
        m = (degree - d) * np.diff(m, axis=0) / width[:, None]
    return np.diff(m, axis=0)


def banded_solve(bands: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x of A x = y for a symmetric positive definite A; ``bands[d, i]`` is A[i + d, i]. Cholesky factors keep the band."""
    width, n = bands.shape
    low, x = bands.astype(float).copy(), y.astype(float).copy()
    for i in range(n):
        low[0, i] = np.sqrt(low[0, i])
        m = min(width - 1, n - 1 - i)
        low[1 : m + 1, i] /= low[0, i]
        for d in range(1, m + 1):
            low[: m - d + 1, i + d] -= low[d, i] * low[d : m + 1, i]
    for i in range(n):
        x[i] /= low[0, i]
        m = min(width - 1, n - 1 - i)
        x[i + 1 : i + m + 1] -= low[1 : m + 1, i] * x[i]
    for i in range(n - 1, -1, -1):
        m = min(width - 1, n - 1 - i)
        x[i] = (x[i] - low[1 : m + 1, i] @ x[i + 1 : i + m + 1]) / low[0, i]
    return x


def _bands(a: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, len(a)))
    for d in range(min(width, len(a))):
        out[d, : len(a) - d] = np.diagonal(a, -d)
    return out


class SmoothingSpline:
    """The spline of a degree whose jumps are least among those with squared residuals of at most ``s`` in sum.

    The points' places must rise. A degree that is too high for their number is lowered.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, s: float = 0.0, degree: int = 3) -> None:
        if s < 0 or degree < 1 or len(x) < 2 or (np.diff(x) <= 0).any():
            raise ValueError("at least two rising places, s from 0 on and a degree from 1 on are needed")
        self.degree = min(degree, len(x) - 1)
        self.start, self.unit = float(x[0]), float(x[-1] - x[0])
        self.x, self.y = (np.asarray(x, float) - self.start) / self.unit, np.asarray(y, float)
        self.knots = knots_of(self.x, self.degree)
        self._b, self._d = basis(self.knots, self.degree, self.x), jumps(self.knots, self.degree)
        d = self._d / max(np.abs(self._d).max(), 1e-300) if self._d.size else np.zeros((0, len(self.x)))
        self._gram, self._penalty = self._b.T @ self._b, d.T @ d
        # the largest sum of squares: that of the polynomial, which has no jumps
        power = np.vander(self.x, self.degree + 1)
        self._line = power @ np.linalg.lstsq(power, self.y, rcond=None)[0]
        self.most = float(((self.y - self._line) ** 2).sum())
        self.smooth(s)

    def _fit(self, weight: float) -> np.ndarray:
        width = self.degree + 2  # a jump reaches over one B-spline more than a point
        return banded_solve(_bands(self._gram + weight * self._penalty, width), self._b.T @ self.y)

    def residual(self, c: np.ndarray) -> float:
        return float(((self.y - self._b @ c) ** 2).sum())

    def smooth(self, s: float) -> SmoothingSpline:
        """The same points with another bound: the weight of the jumps is found by bisection, as residuals rise with it."""
        self.s = s
        low, high = -14.0, 12.0
        if s <= 0 or not len(self._d):
            self.c = np.linalg.solve(self._b, self.y)
        elif s >= self.most * (1 - 1e-9):
            self.c = np.linalg.solve(self._b, self._line)
        else:
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if self.residual(self._fit(10.0**middle)) < s else (low, middle)
            self.c = self._fit(10.0**low)
        return self

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return basis(self.knots, self.degree, (np.asarray(at, float) - self.start) / self.unit) @ self.c


def best_smoothing(spline: SmoothingSpline, loss, tries: int = 9, turns: int = 12) -> SmoothingSpline:
    """The spline with the bound of the least ``loss(spline)``: 0 and a ladder up to the polynomial, then golden sections beside the best; ties to the smallest."""
    ladder = [0.0, *(spline.most * 10.0 ** np.linspace(-4, 0, tries - 1))] if spline.most > 0 else [0.0]
    told = [loss(spline.smooth(s)) for s in ladder]
    k = int(np.argmin(np.round(told, 12)))
    best, least = ladder[k], told[k]
    a, b = ladder[max(0, k - 1)], ladder[min(len(ladder) - 1, k + 1)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(turns if b > a else 0):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        lc, ld = loss(spline.smooth(c)), loss(spline.smooth(d))
        for s, v in ((c, lc), (d, ld)):
            if v < least - 1e-12:
                best, least = s, v
        a, b = (a, d) if lc <= ld else (c, b)
    return spline.smooth(best)
