"""Models on tiles. A tile holds a bounded number of cells; the number of tiles follows the lattice's size.

A model's tiles share parameters: each sends its sufficient statistics for a grid of parameters, Spark adds them up, and a
few numbers a grid point reach the driver. Predictions of a tile see the observed cells around it, its halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.covariance import spde_constants
from gridloom.models import kernels as K
from gridloom.operators.lattice import SHIFTS, shifted
from gridloom.session import cut

OUT = "cell_id long, mean double, sd double"
Grid = list[tuple[float, float]]
GRID: Grid = [(r, s) for r in (2.0, 4.0, 8.0, 16.0, 32.0) for s in (0.01, 0.05, 0.1, 0.2, 0.4)]


@dataclass(frozen=True)
class Fit:
    """Parameters that all tiles share."""

    beta: np.ndarray
    variance: float
    range: float
    share: float
    loglik: float = 0.0
    family: K.Family | None = None  # None: exponential


def splits(nx: int, ny: int, per_tile: int) -> tuple[int, int]:
    """In how many parts each side is cut, the longer one halved first, for tiles of about per_tile cells."""
    a = b = 1
    while nx * ny / (a * b) > 1.5 * per_tile:
        a, b = (2 * a, b) if nx / a >= ny / b else (a, 2 * b)
    return a, b


def tiled(df: DataFrame, nx: int, ny: int, per_tile: int, halo: float = 0.0, x0: int = 0, y0: int = 1) -> DataFrame:
    """cell_id, ix, iy, val, block and whether the block is the cell's own; observed cells also go to the blocks within halo."""
    a, b = splits(nx, ny, per_tile)

    def part(c: str, low: int, n: int, k: int, d: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor((F.col(c) - low + d) / F.lit(n / k)).cast("int")))

    px, py = part("ix", x0, nx, a, 0.0), part("iy", y0, ny, b, 0.0)
    rows = df.select("cell_id", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("val").cast("double").alias("val"))
    if halo <= 0:
        return rows.withColumns({"block": px * b + py, "own": F.lit(True)})
    rows = rows.withColumn("tx", F.explode(F.sequence(part("ix", x0, nx, a, -halo), part("ix", x0, nx, a, halo))))
    rows = rows.withColumn("ty", F.explode(F.sequence(part("iy", y0, ny, b, -halo), part("iy", y0, ny, b, halo))))
    rows = rows.withColumns({"block": F.col("tx") * b + F.col("ty"), "own": (F.col("tx") == px) & (F.col("ty") == py)})
    return rows.where("own or val is not null").drop("tx", "ty")


def _xy(f: pd.DataFrame) -> np.ndarray:
    return f[["ix", "iy"]].to_numpy(float)


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for f in frames:
        for g, v in zip(f["g"].tolist(), f["v"]):
            sums[g] = sums[g] + v if g in sums else np.array(v, float)
    if sums:
        yield pd.DataFrame({"g": list(sums), "v": list(sums.values())})


def summed(stats: DataFrame, fan_in: int = 64) -> dict[int, np.ndarray]:
    """The sums of the vectors v by g: each task adds up what it made, `fan_in` tasks add up those sums, and a group for each g
    theirs; a vector for each g is collected."""
    kind = "g int, v array<double>"
    parts = stats.select("g", "v").mapInPandas(_added, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    fewer = parts.repartition("part").select("g", "v").mapInPandas(_added, kind)
    rows = fewer.groupBy("g").applyInPandas(lambda f: next(_added(iter([f]))), kind).collect()
    return {r["g"]: np.array(r["v"]) for r in rows}


def fits(df: DataFrame, nx: int, ny: int, grid: Grid = GRID, trend: str = "linear", taper: float | None = None, per_tile: int = 400, family: K.Family | None = None) -> list[Fit]:
    """The profile likelihood at each point of a grid, tiles taken as independent."""
    p = K.design(np.zeros((1, 2)), trend, nx, ny).shape[1]

    def stats(f: pd.DataFrame) -> pd.DataFrame:
        xy = _xy(f)
        found = K.gls_grid(xy, K.design(xy, trend, nx, ny), f["val"].to_numpy(float), grid, taper, family)
        return pd.DataFrame({"g": np.arange(len(grid)), "v": list(found)})

    each = tiled(df.where("val is not null"), nx, ny, per_tile).groupBy("block").applyInPandas(stats, "g int, v array<double>")
    out = []
    for g, v in summed(each).items():
        beta, variance, ll = K.profile(v, p)
        out.append(Fit(beta, variance, *grid[g], ll, family))
    return out


def maximise(objective: Callable[[Grid], list[Fit]], grid: Grid, zooms: int = 1) -> Fit:
    """The fit of greatest likelihood on the grid, then on finer grids about it within the first one's bounds.

    The objective gives the fits at all points of a grid at once, so a zoom is one job: a bounded search that asks for few
    passes, where a sequential optimiser would take one a step.
    """
    best = max(objective(grid), key=lambda f: (f.loglik, -f.range))
    ranges, shares = sorted({r for r, _ in grid}), sorted({s for _, s in grid})
    step = 2.0
    for _ in range(zooms):
        step = math.sqrt(step)
        inside = lambda v, all_: min(max(v, all_[0]), all_[-1])
        finer = sorted({(inside(best.range * a, ranges), inside(best.share * b, shares)) for a in (1 / step, 1.0, step) for b in (1 / step, 1.0, step)})
        best = max([best, *objective(finer)], key=lambda f: (f.loglik, -f.range))
    return best


def best_fit(df: DataFrame, nx: int, ny: int, grid: Grid = GRID, trend: str = "linear", taper: float | None = None, per_tile: int = 400, zooms: int = 1, family: K.Family | None = None) -> Fit:
    """The parameters of greatest likelihood of tiles taken as independent."""
    return maximise(lambda g: fits(df, nx, ny, g, trend, taper, per_tile, family), grid, zooms)


def predict_tiles(df: DataFrame, nx: int, ny: int, per_tile: int, halo: float, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """mean and sd of each tile's missing cells by kernel(places and values of the observed cells, places, tile)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        seen, gone = f[f["val"].notna()], f[f["val"].isna()]
        if not len(gone):
            return pd.DataFrame({"cell_id": [], "mean": [], "sd": []})
        mean, sd = kernel(_xy(seen), seen["val"].to_numpy(float), _xy(gone), int(f["block"].iloc[0]))
        return pd.DataFrame({"cell_id": gone["cell_id"], "mean": mean, "sd": sd})

    return tiled(df, nx, ny, per_tile, halo).groupBy("block").applyInPandas(run, OUT)


def _kriging(fit: Fit, nx: int, ny: int, trend: str, taper: float | None = None):
    def kernel(xy, y, to, block):
        mean, var = K.krige(xy, y - K.design(xy, trend, nx, ny) @ fit.beta, to, fit.variance, fit.range, fit.share, taper, fit.family)
        return K.design(to, trend, nx, ny) @ fit.beta + mean, np.sqrt(var)

    return kernel


def partition_gp(df: DataFrame, nx: int, ny: int, per_tile: int = 400, trend: str = "bisquare", family: K.Family | None = None) -> DataFrame:
    """Independent tiles with shared parameters and a trend with 16 bisquare functions, parameters from a 10 by 20 grid."""
    grid = [(float(r), share) for r in np.geomspace(1.0, 40.0, 10) for share in np.geomspace(0.005, 0.8, 20).tolist()]
    fit = best_fit(df, nx, ny, grid, trend, None, per_tile, zooms=0, family=family)
    return predict_tiles(df, nx, ny, per_tile, 0.0, _kriging(fit, nx, ny, trend))


def grid_likelihood(df: DataFrame, nx: int, ny: int, grid: Grid = GRID) -> DataFrame:
    """range, share, variance and log likelihood of every grid point, tiles as in the partition model."""
    rows = [(f.range, f.share, f.variance, f.loglik) for f in fits(df, nx, ny, grid)]
    return df.sparkSession.createDataFrame(rows, "range double, share double, variance double, loglik double")


def conditional_simulation(df: DataFrame, nx: int, ny: int, draws: int = 60, per_tile: int = 400, halo: float = 10.0, trend: str = "linear", seed: int = 1, family: K.Family | None = None) -> DataFrame:
    """Kriged mean; sd from conditional draws: prediction + (free draw - its own prediction).

    Free draws are made by circulant embedding on the rectangle of a tile and its halo, seeded by the tile's number.
    """
    fit = best_fit(df, nx, ny, GRID, trend, None, per_tile, family=family)

    def kernel(xy, y, to, block):
        every = np.vstack([xy, to]).astype(int)
        low = every.min(axis=0)
        side = every.max(axis=0) - low + 1
        free = K.embed(int(side[0]), int(side[1]), fit.variance * (1 - fit.share), fit.range, [seed, block], draws, family)[:, every[:, 0] - low[0], every[:, 1] - low[1]].T
        noise = np.random.Generator(np.random.PCG64([seed, block, 1])).standard_normal((len(every), draws)) * math.sqrt(fit.variance * fit.share)
        c = fit.variance * (1 - fit.share) * K.correlation(K.distances(xy, xy), fit.range, None, family) + fit.variance * (fit.share + 1e-9) * np.eye(len(xy))
        rest = y - K.design(xy, trend, nx, ny) @ fit.beta
        solved = np.linalg.solve(c, np.column_stack([rest, free[: len(xy)] + noise[: len(xy)]]))
        moved = fit.variance * (1 - fit.share) * K.correlation(K.distances(to, xy), fit.range, None, family) @ solved
        errors = free[len(xy) :] + noise[len(xy) :] - moved[:, 1:]
        return K.design(to, trend, nx, ny) @ fit.beta + moved[:, 0], errors.std(axis=1, ddof=1)

    return predict_tiles(df, nx, ny, per_tile, halo, kernel)


def lattice_markov(df: DataFrame, nx: int, ny: int, per_tile: int = 400, halo: float = 8.0, trend: str = "bisquare") -> DataFrame:
    """A Markov field (kappa^2 - Laplacian) tau x = noise on the lattice, as a Gaussian field's finite differences.

    The range (which gives kappa and tau) and the noise's share are chosen by the likelihood of tiles, the variance is
    profiled out. A tile's precision is block tridiagonal: likelihood, mean and the sds (by partial inversion) come from its
    blocks of two columns, halo included.
    """
    grid = [(r, s) for r in (3.5, 7.0, 14.0, 28.0) for s in (0.01, 0.05, 0.2)]
    start = best_fit(df, nx, ny, GRID, trend, None, per_tile // 2, zooms=0).beta  # the trend's coefficients

    def posterior(xy, rest, to, range_, share):
        every = np.vstack([xy, to]).astype(int)
        low = every.min(axis=0)
        side = every.max(axis=0) - low + 1
        place = (every[:, 0] - low[0]) * side[1] + every[:, 1] - low[1]
        kappa, tau = spde_constants(range_, 1.0)
        seen, right = np.zeros(side[0] * side[1]), np.zeros(side[0] * side[1])
        seen[place[: len(xy)]] = 1
        right[place[: len(xy)]] = rest
        q = K.MarkovBlocks(int(side[0]), int(side[1]), kappa, tau * tau * share / (1 - share), seen)  # precision times the noise variance
        return q, right, place[len(xy) :]

    def stats(f: pd.DataFrame) -> pd.DataFrame:
        xy = _xy(f)
        rest = f["val"].to_numpy(float) - K.design(xy, trend, nx, ny) @ start
        rows = []
        for g, (range_, share) in enumerate(grid):
            q, right, _ = posterior(xy, rest, np.zeros((0, 2)), range_, share)
            rows.append((g, [float(rest @ rest - right @ q.solve(right)), q.prior_logdet() - q.logdet, float(len(rest))]))
        return pd.DataFrame(rows, columns=["g", "v"])

    each = tiled(df.where("val is not null"), nx, ny, per_tile).groupBy("block").applyInPandas(stats, "g int, v array<double>")
    sums = summed(each)
    loglik = {g: -0.5 * (n * math.log(max(1e-12, fit / n)) - logdet) for g, (fit, logdet, n) in sums.items()}
    best = max(loglik, key=loglik.get) if loglik else 0
    noise = max(1e-12, sums[best][0] / sums[best][2]) if sums else 1.0

    def kernel(xy, y, to, block):
        q, right, at = posterior(xy, y - K.design(xy, trend, nx, ny) @ start, to, *grid[best])
        return K.design(to, trend, nx, ny) @ start + q.solve(right)[at], np.sqrt(noise * (1 + q.inverse_diagonal()[at]))

    return predict_tiles(df, nx, ny, per_tile, halo, kernel)


def gap_fill(df: DataFrame, nx: int, ny: int, y0: int = 1) -> DataFrame:
    """Missing cells from their shifted copies: the middle of the neighbourhood's quantiles, held in the observed range.

    What is filled helps the next round; rounds go on until one fills nothing more. low and high are the 5 and 95 %
    quantiles of the neighbourhood, sd the width between them as that of a normal. Cells that no round reaches (a lattice
    without any value) stay out.
    """
    ends = df.agg(F.min("val"), F.max("val")).first()
    none = F.lit(None).cast("double")
    work = cut(df.select("cell_id", "ix", "iy", "val", none.alias("low"), none.alias("high")))
    left, before = work.where("val is null").count(), None
    while left and left != before and ends[0] is not None:
        near = shifted(work, "val", nx, ny, 0, y0, SHIFTS).where("img > 0 and v is not null").groupBy("cell_id").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
        held = F.when(F.col("q").isNotNull(), F.greatest(F.lit(ends[0]), F.least(F.lit(ends[1]), F.col("q")[1])))
        gone = F.col("val").isNull()
        edge = lambda c, k: F.coalesce(c, F.when(gone, F.col("q")[k])).alias(c)
        work = cut(work.join(near, "cell_id", "left").select("cell_id", "ix", "iy", F.coalesce("val", held).alias("val"), edge("low", 0), edge("high", 2)))
        before, left = left, work.where("val is null").count()
    filled = work.where("low is not null and val is not null")
    return filled.select("cell_id", F.col("val").alias("mean"), ((F.col("high") - F.col("low")) / (2 * 1.6448536269514722) + 1e-3).alias("sd"), "low", "high")
