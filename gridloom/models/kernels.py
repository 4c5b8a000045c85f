"""Dense kernels for one block of at most a few thousand cells."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from gridloom.functions.covariance import Matern, bisquare_np, wendland_np


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def design(xy: np.ndarray, trend: str = "linear", nx: float = 1.0, ny: float = 1.0) -> np.ndarray:
    """The trend's columns on a lattice of nx by ny: none, constant, linear, quadratic, or linear with 16 bisquare functions."""
    x, y = xy[:, 0] / nx, xy[:, 1] / ny
    if trend == "none":
        return np.zeros((len(xy), 0))
    columns = [np.ones(len(xy))]
    if trend != "constant":
        columns += [x, y]
    if trend == "quadratic":
        columns += [x * x, x * y, y * y]
    if trend == "bisquare":
        at = (np.arange(4) + 0.5) / 4
        centres = np.array([(a * nx, b * ny) for a in at for b in at])
        columns += list(bisquare_np(distances(xy, centres), 0.5 * max(nx, ny)).T)
    return np.column_stack(columns)


#: A correlation by distance and range.
Family = Callable[[np.ndarray, float], np.ndarray]


def matern(smoothness: float) -> Family:
    """The Matern family of smoothness 1/2, 3/2 or 5/2."""
    return lambda d, range_: Matern(1.0, range_, smoothness).np(d)


def correlation(d: np.ndarray, range_: float, taper: float | None = None, family: Family | None = None) -> np.ndarray:
    """The family's correlation (by default exponential), tapered by a Wendland function of that reach."""
    r = np.exp(-d / range_) if family is None else family(d, range_)
    return r if taper is None else r * wendland_np(d, taper)


def gls_grid(xy: np.ndarray, x: np.ndarray, y: np.ndarray, grid: list[tuple[float, float]], taper: float | None = None, family: Family | None = None) -> np.ndarray:
    """For each (range, share) the sufficient statistics of y = X b + e, e with correlation (1 - share) r(d) + share I.

    A row of xx (p * p), xy (p), yy, logdet, n. One eigendecomposition of r serves all shares of a range.
    """
    d, out = distances(xy, xy), {}
    for range_ in sorted({g[0] for g in grid}):
        values, vectors = np.linalg.eigh(correlation(d, range_, taper, family))
        u, v = vectors.T @ x, vectors.T @ y
        for share in (s for r, s in grid if r == range_):
            s = np.maximum(1e-10, (1 - share) * values + share)
            w = u / s[:, None]
            out[range_, share] = np.concatenate([(u.T @ w).ravel(), w.T @ v, [float(v @ (v / s)), float(np.log(s).sum()), float(len(y))]])
    return np.array([out[g] for g in grid])


def profile(stats: np.ndarray, p: int) -> tuple[np.ndarray, float, float]:
    """Coefficients, variance and profile log likelihood from (sums of) rows of gls_grid."""
    xx, xy = stats[: p * p].reshape(p, p), stats[p * p : p * p + p]
    yy, logdet, n = stats[-3:]
    beta = np.linalg.solve(xx + 1e-9 * np.eye(p), xy) if p else np.zeros(0)
    variance = max(1e-12, (yy - 2 * beta @ xy + beta @ xx @ beta) / n)
    return beta, float(variance), float(-0.5 * (n * np.log(variance) + logdet + n))


def krige(xy: np.ndarray, rest: np.ndarray, to: np.ndarray, variance: float, range_: float, share: float, taper: float | None = None, family: Family | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the residual and variance of an observation at new places, from residuals at known ones."""
    if not len(xy):
        return np.zeros(len(to)), np.full(len(to), variance)
    r = (1 - share) * correlation(distances(xy, xy), range_, taper, family)
    r[np.diag_indices(len(xy))] = 1.0 + 1e-10
    w = np.linalg.solve(np.linalg.cholesky(r), np.column_stack([(1 - share) * correlation(distances(xy, to), range_, taper, family), rest]))
    return w[:, :-1].T @ w[:, -1], np.maximum(1e-12, variance * (1 - (w[:, :-1] ** 2).sum(axis=0)))


def t_quantile(p: float, df: float) -> float:
    """Student's t quantile by bisection of its distribution function (a sum of Simpson's rule)."""
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def cdf(t: float) -> float:
        z = np.linspace(0, abs(t), 2001)
        f = const * (1 + z * z / df) ** (-(df + 1) / 2)
        area = abs(t) / 6000 * (f[0] + f[-1] + 4 * f[1::2].sum() + 2 * f[2:-1:2].sum())
        return 0.5 + math.copysign(area, t)

    low, high = -1.0, 1.0
    while cdf(low) > p:
        low *= 2
    while cdf(high) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def gaussian_crps(mean: np.ndarray, sd: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (y - mean) / sd
    cdf = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))
    return sd * (z * (2 * cdf - 1) + 2 * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def median_of_posteriors(draws: list[np.ndarray], steps: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Weights of distributions, given by draws, in their geometric median in the space of a Gaussian kernel."""
    every = np.concatenate(draws)
    scale = np.maximum(1e-9, every.std(axis=0))
    parts = [d / scale for d in draws]
    gram = np.array([[np.exp(-(distances(a, b) ** 2) / (2 * a.shape[1])).mean() for b in parts] for a in parts])
    weights = np.full(len(parts), 1 / len(parts))
    for _ in range(steps):
        away = np.sqrt(np.maximum(1e-12, np.diag(gram) - 2 * gram @ weights + weights @ gram @ weights))
        fresh = (1 / away) / (1 / away).sum()
        if np.abs(fresh - weights).max() < tolerance:
            return fresh
        weights = fresh
    return weights


def embed(nx: int, ny: int, variance: float, range_: float, seed: list[int], draws: int, family: Family | None = None) -> np.ndarray:
    """Draws of a stationary field on a lattice by circulant embedding.

    The torus is doubled until less than 1e-3 of its spectrum's mass is negative; that part is then cut.
    """
    for grow in (2, 4, 8):
        mx, my = grow * nx, grow * ny
        dx, dy = np.minimum(np.arange(mx), mx - np.arange(mx)), np.minimum(np.arange(my), my - np.arange(my))
        spectrum = np.fft.fft2(variance * correlation(np.sqrt(dx[:, None] ** 2.0 + dy[None, :] ** 2.0), range_, None, family)).real
        if -spectrum[spectrum < 0].sum() < 1e-3 * spectrum.sum():
            break
    else:
        raise ValueError(f"range {range_} is too long for a lattice of {nx} by {ny}")
    rng = np.random.Generator(np.random.PCG64(seed))
    noise = rng.standard_normal((draws, mx, my)) + 1j * rng.standard_normal((draws, mx, my))
    return np.fft.fft2(np.sqrt(np.maximum(0, spectrum) / (mx * my)) * noise).real[:, :nx, :ny]


class MarkovBlocks:
    """Precision of (kappa^2 - Laplacian) x = noise on a lattice with free edges, ix-major, times `scale`, plus a diagonal.

    Two lattice columns make a block, so the matrix is block tridiagonal: its factor, solutions, determinant and the diagonal
    of its inverse (by the recursion from the last block back) take a few products of blocks of two columns; the matrix
    itself is never made.
    """

    def __init__(self, nx: int, ny: int, kappa: float, scale: float, diagonal: np.ndarray):
        self.nx, self.ny, self.kappa, self.scale = nx, ny, kappa, scale
        self.bounds = [(i * ny, min(i + 2, nx) * ny) for i in range(0, nx, 2)]
        self.inverses, self.links, self.logdet = [], [], 0.0
        before = None
        for k, (a, b) in enumerate(self.bounds):
            s = self._block(2 * k, 2 * k) + np.diag(diagonal[a:b])
            if k:
                link = self._block(2 * k - 2, 2 * k)
                self.links.append(link)
                s = s - link.T @ before @ link
            sign, logdet = np.linalg.slogdet(s)
            before = np.linalg.inv(s)
            self.inverses.append(before)
            self.logdet += float(logdet)

    def _column(self, i: int) -> np.ndarray:
        """A column's own part of kappa^2 - Laplacian."""
        ny = self.ny
        sides = np.full(ny, (i > 0) + (i < self.nx - 1), float)
        ends = np.full(ny, 2.0)
        ends[0] -= 1
        ends[-1] -= 1
        t = np.diag(self.kappa**2 + sides + ends)
        at = np.arange(ny - 1)
        t[at, at + 1] = t[at + 1, at] = -1
        return t

    def _pair(self, i: int, j: int) -> np.ndarray:
        """The square of kappa^2 - Laplacian between two columns."""
        if i == j:
            t = self._column(i)
            return t @ t + ((i > 0) + (i < self.nx - 1)) * np.eye(self.ny)
        if j == i + 1:
            return -(self._column(i) + self._column(j))
        return np.eye(self.ny) if j == i + 2 else np.zeros((self.ny, self.ny))

    def _block(self, i: int, j: int) -> np.ndarray:
        rows, columns = ([c for c in (k, k + 1) if c < self.nx] for k in (i, j))
        return self.scale * np.block([[self._pair(r, c) if r <= c else self._pair(c, r).T for c in columns] for r in rows])

    def prior_logdet(self) -> float:
        """The log determinant without the diagonal, from the eigenvalues of the Laplacian with free edges."""
        x, y = (2 - 2 * np.cos(np.pi * np.arange(n) / n) for n in (self.nx, self.ny))
        return float(2 * np.log(self.kappa**2 + x[:, None] + y[None, :]).sum() + self.nx * self.ny * math.log(self.scale))

    def solve(self, right: np.ndarray) -> np.ndarray:
        parts = [right[a:b].copy() for a, b in self.bounds]
        for k, link in enumerate(self.links):
            parts[k + 1] -= link.T @ (self.inverses[k] @ parts[k])
        parts[-1] = self.inverses[-1] @ parts[-1]
        for k in range(len(parts) - 2, -1, -1):
            parts[k] = self.inverses[k] @ (parts[k] - self.links[k] @ parts[k + 1])
        return np.concatenate(parts)

    def inverse_diagonal(self) -> np.ndarray:
        below = self.inverses[-1]
        out = [np.diag(below)]
        for inverse, link in zip(self.inverses[-2::-1], self.links[::-1]):
            step = inverse @ link
            below = inverse + step @ below @ step.T
            out.append(np.diag(below))
        return np.concatenate(out[::-1])
