"""Low-rank models: every task sums its part of a few Gram matrices, Spark adds them, the driver solves systems of the rank."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.covariance import bisquare_np, wendland_np
from gridloom.models import kernels as K
from gridloom.models.fields import OUT, _xy, summed
from gridloom.operators.aggregates import variogram
from gridloom.operators.joins import knots


def gram_sums(df: DataFrame, basis: Callable[[np.ndarray], np.ndarray], rank: int, folds: int = 1) -> list[np.ndarray]:
    """By fold (a hash of the cell) the sums of (B, y)'(B, y), with B the basis at the observed cells and y their values."""
    size = rank + 1

    def part(frames):
        sums = np.zeros((folds, size + 1, size))
        for f in frames:
            by = np.column_stack([basis(_xy(f)), f["val"].to_numpy(float)])
            for k in range(folds):
                own = by[f["fold"].to_numpy() == k]
                sums[k, :size] += own.T @ own
                sums[k, size, 0] += len(own)
        yield pd.DataFrame({"g": np.repeat(np.arange(folds), size + 1) * (size + 1) + np.tile(np.arange(size + 1), folds), "v": list(sums.reshape(-1, size))})

    known = df.where("val is not null").select("ix", "iy", "val", F.pmod(F.xxhash64(F.lit("fold"), "cell_id"), F.lit(folds)).cast("int").alias("fold"))
    found = summed(known.mapInPandas(part, "g int, v array<double>"))
    empty = np.zeros(size)
    return [np.array([found.get(k * (size + 1) + i, empty) for i in range(size + 1)]) for k in range(folds)]


def _parts(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    rank = sums.shape[1] - 1
    return sums[:rank, :rank], sums[:rank, rank], float(sums[rank, rank]), float(sums[rank + 1, 0])


def predict_basis(df: DataFrame, basis: Callable[[np.ndarray], np.ndarray], coefficients: np.ndarray, spread: np.ndarray, noise: float) -> DataFrame:
    """mean = B c and sd from B spread B' + noise at the missing cells."""

    def run(frames):
        for f in frames:
            b = basis(_xy(f))
            yield pd.DataFrame({"cell_id": f["cell_id"], "mean": b @ coefficients, "sd": np.sqrt(np.maximum(1e-12, noise + np.einsum("ij,ij->i", b @ spread, b)))})

    return df.where("val is null").select("cell_id", "ix", "iy").mapInPandas(run, OUT)


Boxes = list[tuple[float, float, float, float]]  # centre, width and height


def quadtree(df: DataFrame, nx: int, ny: int, depth: int = 5, coarsest: int = 1, least: int = 3, split: int = 24, y0: int = 1) -> list[Boxes]:
    """By resolution the boxes of a tree over the observed cells: a box that holds more than `split` of them is cut in four, and
    boxes with fewer than `least` are left out. Counts of the finest boxes come from one aggregation, 4**depth rows at most."""
    side = 2**depth
    part = lambda c, low, n: F.least(F.lit(side - 1), F.floor((F.col(c) - low) * F.lit(side / n))).cast("int")
    counts = np.zeros((side, side), np.int64)
    for r in df.where("val is not null").groupBy(part("ix", 0, nx).alias("i"), part("iy", y0, ny).alias("j")).agg(F.count("*").alias("n")).collect():
        counts[r["i"], r["j"]] = r["n"]
    out: list[Boxes] = []
    open_ = {(i, j) for i in range(2**coarsest) for j in range(2**coarsest)}
    for level in range(coarsest, depth + 1):
        k = 2**level
        held = counts.reshape(k, side // k, k, side // k).sum(axis=(1, 3))
        kept = sorted(x for x in open_ if held[x] >= least)
        if not kept:
            break
        out.append([((i + 0.5) * nx / k, y0 + (j + 0.5) * ny / k, nx / k, ny / k) for i, j in kept])
        open_ = {(2 * i + a, 2 * j + b) for i, j in kept if held[i, j] > split for a in (0, 1) for b in (0, 1)}
    return out


def bisquares(nx: int, ny: int, resolutions: list[Boxes], reach: float = 1.5) -> Callable[[np.ndarray], np.ndarray]:
    """A linear trend and, for each box, a bisquare function about its centre that ends `reach` sides away."""
    grids = [(np.array([b[:2] for b in boxes]), reach * max(boxes[0][2:])) for boxes in resolutions]
    return lambda xy: np.hstack([K.design(xy, "linear", nx, ny)] + [bisquare_np(K.distances(xy, at), r) for at, r in grids])


@dataclass
class RankFit:
    """A fixed-rank model: coefficients, their spread, a variance for each resolution, and what is left as the sum of a fine-scale
    variance of the process and the measurement's; the log likelihood of every round."""

    mean: np.ndarray
    spread: np.ndarray
    prior: np.ndarray
    left: float
    fine: float
    loglik: list[float]


def expectation_maximisation(sums: np.ndarray, group: np.ndarray, measured: float, rounds: int = 200, tolerance: float = 0.02) -> RankFit:
    """Maximum likelihood from the Gram sums alone. group: each column's resolution, 0 for fixed effects. measured: the variance
    of the measurement; with one value a cell the rounds give its sum with the fine-scale variance, which is the rest."""
    gram, right, yy, n = _parts(sums)
    left, prior = max(1e-9, yy / max(n, 1) / 10), np.full(group.max(initial=0) + 1, max(1e-9, yy / max(n, 1)))
    prior[0] = 1e5 * prior[0]  # fixed effects: hardly any prior
    history: list[float] = []
    random = group > 0
    for _ in range(rounds):
        precision = np.diag(1 / prior[group])
        a = gram / left + precision
        spread = np.linalg.inv(a)
        mean = spread @ right / left
        history.append(float(-0.5 * (n * math.log(2 * math.pi * left) + np.linalg.slogdet(a)[1] + np.log(prior[group]).sum() + (yy - right @ mean) / left)))
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
        second = spread + np.outer(mean, mean)
        left = max(1e-9, (yy - 2 * mean @ right + float((gram * second).sum())) / max(n, 1))
        for k in range(1, len(prior)):
            prior[k] = max(1e-12, np.diag(second)[random & (group == k)].mean())
    return RankFit(mean, spread, prior, left, max(0.0, left - measured), history)


def measurement_variance(df: DataFrame) -> float:
    """The variogram's value at no distance, on the line through its first two steps; 0 without pairs."""
    rows = {(r["lx"], r["ly"]): (r["gamma"] / 2, r["pairs"]) for r in variogram(df, [(1, 0), (0, 1), (2, 0), (0, 2)], "val").collect()}
    at = [[rows[k] for k in ((d, 0), (0, d)) if k in rows] for d in (1, 2)]
    if not all(at):
        return 0.0
    one, two = (sum(g * n for g, n in x) / sum(n for _, n in x) for x in at)
    return max(0.0, 2 * one - two)


def fixed_rank(df: DataFrame, nx: int, ny: int, depth: int = 4) -> DataFrame:
    """Fixed-rank kriging on a basis that follows the data: random effects with a variance for each resolution, a fine-scale
    variance and the measurement's, by expectation maximisation.

    Boxes of a quadtree of the observations carry the functions, none lies where nothing was observed. All rounds work on the
    Gram sums, so the data are read three times in all. sd is that of an observation, process_sd that of the process.
    """
    resolutions = quadtree(df, nx, ny, depth)
    basis = bisquares(nx, ny, resolutions)
    group = np.repeat(np.arange(len(resolutions) + 1), [3, *map(len, resolutions)])
    measured = measurement_variance(df)
    fit = expectation_maximisation(gram_sums(df, basis, len(group))[0], group, measured)
    out = predict_basis(df, basis, fit.mean, fit.spread, fit.left)
    return out.withColumn("process_sd", F.sqrt(F.greatest(F.col("sd") * F.col("sd") - F.lit(float(fit.left - fit.fine)), F.lit(0.0))))


def predictive_process(df: DataFrame, nx: int, ny: int, side: int = 14, ranges: tuple[float, ...] = (6.0, 12.0, 24.0, 48.0), shares: tuple[float, ...] = (0.002, 0.01, 0.05, 0.2)) -> DataFrame:
    """A process seen through side * side knots: w(s) = c(s)' C^-1 w*, exponential covariance, linear trend, noise.

    With L L' = C at the knots the columns c(s)' L^-T have a unit normal prior, so for every range the Gram sums give the
    marginal likelihood of every noise share; the posterior over this grid (flat, variance profiled out) weighs the fits.
    """
    at = np.array([(x, y) for x in knots(side, 0.0, nx - 1.0, 0.01) for y in knots(side, 1.0, float(ny), 0.01)])

    def basis_of(range_: float):
        low = np.linalg.cholesky(K.correlation(K.distances(at, at), range_) + 1e-8 * np.eye(len(at)))
        inverse = np.linalg.inv(low).T
        return lambda xy: np.hstack([K.design(xy, "linear", nx, ny), K.correlation(K.distances(xy, at), range_) @ inverse])

    rank = 3 + len(at)
    fitted = []
    for range_ in ranges:
        basis = basis_of(range_)
        gram, right, yy, n = _parts(gram_sums(df, basis, rank)[0])
        if not n:
            return predict_basis(df, basis, np.zeros(rank), np.eye(rank), 1.0)
        for share in shares:
            ratio = share / (1 - share)
            a = gram + ratio * np.diag([1e-9] * 3 + [1.0] * len(at))
            mean = np.linalg.solve(a, right)
            noise = max(1e-12, (yy - right @ mean) / n)
            ll = -0.5 * (n * math.log(noise) + np.linalg.slogdet(a)[1] - len(at) * math.log(ratio))
            fitted.append((ll, range_, mean, np.linalg.inv(a) * noise, noise))
    top = max(f[0] for f in fitted)
    kept = [(math.exp(f[0] - top), *f[1:]) for f in fitted if f[0] - top > -7]
    total = sum(k[0] for k in kept)

    def run(frames):
        for f in frames:
            xy, first, second = _xy(f), np.zeros(len(f)), np.zeros(len(f))
            for w, range_, mean, spread, noise in kept:
                b = basis_of(range_)(xy)
                m = b @ mean
                first += w / total * m
                second += w / total * (m * m + noise + np.einsum("ij,ij->i", b @ spread, b))
            yield pd.DataFrame({"cell_id": f["cell_id"], "mean": first, "sd": np.sqrt(np.maximum(1e-12, second - first * first))})

    return df.where("val is null").select("cell_id", "ix", "iy").mapInPandas(run, OUT)


def lattice_basis(nx: int, ny: int, coarse: int, levels: int) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """Compact radial functions on nested lattices, each twice as fine as the last, and the precision of their coefficients.

    The precision of a level is B'B with B = a I - (rook neighbours), a of 4.01; levels weigh by a quarter of the one before.
    """
    grids, blocks = [], []
    for level in range(levels):
        step = max(nx, ny) / (coarse * 2**level)
        mx, my = int(math.ceil(nx / step)) + 1, int(math.ceil(ny / step)) + 1
        grids.append((np.array([(i * step, 1 + j * step) for i in range(mx) for j in range(my)]), 2.5 * step))
        b = np.diag(np.full(mx * my, 4.01))
        place = np.arange(mx * my).reshape(mx, my)
        for p, q in ((place[1:].ravel(), place[:-1].ravel()), (place[:, 1:].ravel(), place[:, :-1].ravel())):
            b[p, q] = b[q, p] = -1
        blocks.append(b.T @ b * 4.0**level)
    rank = 3 + sum(len(b) for b in blocks)
    precision, row = np.zeros((rank, rank)), 3
    for b in blocks:
        precision[row : row + len(b), row : row + len(b)] = b
        row += len(b)
    return (lambda xy: np.hstack([K.design(xy, "linear", nx, ny)] + [wendland_np(K.distances(xy, at), reach) for at, reach in grids])), precision


def _smooth(sums: np.ndarray, precision: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients, inverse, noise and log likelihood of ridge regression with precision times lam."""
    gram, right, yy, n = _parts(sums)
    a = gram + lam * precision + 1e-9 * np.eye(len(gram))
    inverse = np.linalg.inv(a)
    mean = inverse @ right
    noise = max(1e-12, (yy - right @ mean) / max(n, 1.0))
    return mean, inverse, noise, -0.5 * (n * math.log(noise) + np.linalg.slogdet(a)[1] - (len(gram) - 3) * math.log(lam))


def lattice_covariance(df: DataFrame, nx: int, ny: int, places: list[tuple[float, float]], coarse: int = 6, levels: int = 3) -> DataFrame:
    """cell_id, place, cov: the covariance of each cell with a few places that the lattice model implies, for unit variance of
    its coefficients; the places' coefficients are solved for once, so the cells need one pass."""
    basis, precision = lattice_basis(nx, ny, coarse, levels)
    field = slice(3, None)
    solved = np.linalg.solve(precision[field, field], basis(np.array(places, float))[:, field].T)

    def run(frames):
        for f in frames:
            cov = basis(_xy(f))[:, field] @ solved
            yield pd.DataFrame({"cell_id": np.repeat(f["cell_id"].to_numpy(), len(places)), "place": np.tile(np.arange(len(places)), len(f)), "cov": cov.ravel()})

    return df.select("cell_id", "ix", "iy").mapInPandas(run, "cell_id long, place int, cov double")


LAMBDAS = tuple(10.0**k for k in np.arange(-4, 1.5, 0.5))


def lattice_krig(df: DataFrame, nx: int, ny: int, coarse: int = 6, levels: int = 3) -> DataFrame:
    """The multiresolution lattice model; the smoothing parameter by likelihood, sd from the coefficients' posterior."""
    basis, precision = lattice_basis(nx, ny, coarse, levels)
    sums = gram_sums(df, basis, len(precision))[0]
    mean, inverse, noise, _ = max((_smooth(sums, precision, lam) for lam in LAMBDAS), key=lambda s: s[3])
    return predict_basis(df, basis, mean, inverse * noise, noise)


def lattice_krig_cv(df: DataFrame, nx: int, ny: int, coarse: tuple[int, ...] = (4, 6), levels: int = 2, folds: int = 10) -> DataFrame:
    """coarse, lambda, cv_mse and loglik: squared error on folds that were left out, for every choice.

    Each fold's Gram sums are kept apart, so what the other folds give is a difference of sums: one pass for all fits.
    """
    rows = []
    for c in coarse:
        basis, precision = lattice_basis(nx, ny, c, levels)
        parts = gram_sums(df, basis, len(precision), folds)
        total = sum(parts)
        for lam in LAMBDAS:
            error, n = 0.0, 0.0
            for own in parts:
                mean = _smooth(total - own, precision, lam)[0]
                gram, right, yy, count = _parts(own)
                error, n = error + yy - 2 * mean @ right + mean @ gram @ mean, n + count
            rows.append((c, float(lam), float(error / max(n, 1.0)), float(_smooth(total, precision, lam)[3])))
    return df.sparkSession.createDataFrame(rows, "coarse int, lambda double, cv_mse double, loglik double")
