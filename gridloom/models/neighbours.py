"""Models on lists of nearest neighbours: the lists come from bucketed joins, the small systems run in batches inside tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.models import kernels as K
from gridloom.models.designs import d_optimal, local_design
from gridloom.models.fields import GRID, OUT, Fit, Grid, _xy, summed
from gridloom.models.median import geometric_median
from gridloom.operators import joins as J
from gridloom.operators.lattice import random_places
from gridloom.session import cut

LISTS = "cell_id long, ix int, iy int, val double, near array<array<double>>"


def _points(d: DataFrame) -> DataFrame:
    return d.select(F.col("cell_id").alias("id"), F.col("ix").alias("x"), F.col("iy").alias("y"))


def _gathered(at: DataFrame, edges: DataFrame, seen: DataFrame, extra: str = "0.0") -> DataFrame:
    """at with `near`: for each of its neighbours (i, rank, j) the array x, y, value, extra, in order of distance."""
    near = edges.join(seen.select(F.col("cell_id").alias("j"), F.array(F.col("ix").cast("double"), F.col("iy").cast("double"), "val", F.expr(extra)).alias("c")), "j")
    lists = near.groupBy(F.col("i").alias("cell_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "c"))).alias("n"))  # as many as were asked for
    return at.select("cell_id", "ix", "iy", "val", *(["fold"] if "fold" in at.columns else [])).join(lists.select("cell_id", F.transform("n", lambda x: x["c"]).alias("near")), "cell_id", "left")


def with_neighbours(df: DataFrame, m: int, diameter: float) -> DataFrame:
    """Each missing cell with its m nearest observed cells."""
    seen, gone = df.where("val is not null"), df.where("val is null")
    return _gathered(gone, J.nearest(_points(gone), _points(seen), m, 4.0, diameter), seen)


def with_ordered_neighbours(df: DataFrame, m: int, diameter: float) -> DataFrame:
    """Each observed cell with the m nearest of those before it, in an order drawn at random from a seed.

    A random order spreads the neighbours over all directions; the first cell has none.
    """
    seen = cut(random_places(df.where("val is not null"), 11).select(F.col("place").cast("long").alias("cell_id"), "ix", "iy", "val"))
    return _gathered(seen, J.ordered_neighbours(_points(seen), m, 3.0, diameter), seen)


def lists_of(edges: DataFrame, points: DataFrame) -> DataFrame:
    """The neighbour lists of edges (i, rank, j) between points (id, x, y, val)."""
    at = points.select(F.col("id").alias("cell_id"), F.col("x").alias("ix"), F.col("y").alias("iy"), "val")
    return _gathered(at, edges, at)


def _batches(near: list, m: int):
    """Groups of rows with equally many neighbours: their indices and an array (rows, neighbours, 4)."""
    sizes = np.array([0 if n is None else min(m, len(n)) for n in near])
    for k in np.unique(sizes):
        rows = np.flatnonzero(sizes == k)
        yield rows, np.array([[list(v) for v in near[i][:k]] for i in rows], float).reshape(len(rows), k, 4) if k else np.zeros((len(rows), 0, 4))


def _pair_distances(near: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances among each row's neighbours, and from them to the row's own place."""
    p = near[:, :, :2]
    return np.sqrt(((p[:, :, None] - p[:, None]) ** 2).sum(axis=3)), np.sqrt(((p - xy[:, None]) ** 2).sum(axis=2))


def _weights(d: np.ndarray, to: np.ndarray, range_: float, share: float, family: K.Family | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Kriging weights of each row's neighbours and the conditional variance as a share of the whole."""
    if not d.shape[1]:
        return np.zeros((len(d), 0)), np.ones(len(d))
    r = (1 - share) * K.correlation(d, range_, None, family)
    at = np.arange(d.shape[1])
    r[:, at, at] = 1.0 + 1e-10
    c = (1 - share) * K.correlation(to, range_, None, family)
    w = np.linalg.solve(r, c[:, :, None])[:, :, 0]
    return w, np.maximum(1e-12, 1 - (w * c).sum(axis=1))


def factor_sums(lists: DataFrame, grid: Grid, m: int, family: K.Family | None = None) -> list[np.ndarray]:
    """For each (range, share) the rows of kernels.gls_grid under the nearest-neighbour factors B and F of all cells."""

    def part(frames):
        total = np.zeros((len(grid), 9 + 3 + 3))
        for f in frames:
            xy, y = _xy(f), f["val"].to_numpy(float)
            for rows, near in _batches(f["near"].tolist(), m):
                d, to = _pair_distances(near, xy[rows])
                x, own = K.design(xy[rows]), K.design(near[:, :, :2].reshape(-1, 2)).reshape(len(rows), -1, 3)
                for g, (range_, share) in enumerate(grid):
                    w, var = _weights(d, to, range_, share, family)
                    ux, uy = x - (w[:, :, None] * own).sum(axis=1), y[rows] - (w * near[:, :, 2]).sum(axis=1)
                    xx, v = ux / var[:, None], uy / var
                    total[g] += np.concatenate([(ux.T @ xx).ravel(), ux.T @ v, [float(uy @ v), float(np.log(var).sum()), float(len(rows))]])
        yield pd.DataFrame({"g": np.arange(len(grid)), "v": list(total)})

    sums = summed(lists.select("ix", "iy", "val", "near").mapInPandas(part, "g int, v array<double>"))
    return [sums[g] for g in range(len(grid))]


def factor_table(lists: DataFrame, m: int, variance: float, range_: float, share: float, family: K.Family | None = None) -> DataFrame:
    """cell_id, b (the weights of up to m neighbours, nearest first), f (the variance that they leave) and u (the value less what
    they say): the rows of the factors B and F of a nearest-neighbour process, so that u'u / f and the log of f add up to its
    quadratic form and its log determinant. A cell's small system is solved with others of its size, batch by batch."""

    def run(frames):
        for f in frames:
            xy, y = _xy(f), f["val"].to_numpy(float)
            b, left, u = [None] * len(f), np.zeros(len(f)), np.zeros(len(f))
            for rows, near in _batches(f["near"].tolist(), m):
                w, var = _weights(*_pair_distances(near, xy[rows]), range_, share, family)
                left[rows], u[rows] = variance * var, y[rows] - (w * near[:, :, 2]).sum(axis=1)
                for i, x in zip(rows, w):
                    b[i] = x
            yield pd.DataFrame({"cell_id": f["cell_id"], "b": b, "f": left, "u": u})

    return lists.select("cell_id", "ix", "iy", "val", "near").mapInPandas(run, "cell_id long, b array<double>, f double, u double")


def _local(lists: DataFrame, kernel) -> DataFrame:
    """kernel(neighbours (rows, k, 4), places) gives mean and sd, for the missing cells with their neighbours."""

    def run(frames):
        for f in frames:
            xy, mean, sd = _xy(f), np.zeros(len(f)), np.zeros(len(f))
            for rows, near in _batches(f["near"].tolist(), 10**6):
                mean[rows], sd[rows] = kernel(near, xy[rows])
            yield pd.DataFrame({"cell_id": f["cell_id"], "mean": mean, "sd": sd})

    return lists.select("cell_id", "ix", "iy", "near").mapInPandas(run, OUT)


def _predicted(near: np.ndarray, xy: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Kriged mean and variance from each row's neighbours."""
    w, var = _weights(*_pair_distances(near, xy), fit.range, fit.share, fit.family)
    rest = near[:, :, 2] - (K.design(near[:, :, :2].reshape(-1, 2)) @ fit.beta).reshape(near.shape[:2])
    return K.design(xy) @ fit.beta + (w * rest).sum(axis=1), fit.variance * var


PRIOR = (2.0, 1.0)


def conjugate_fits(df: DataFrame, nx: int, ny: int, grid: Grid, m: int, prior: tuple[float, float] = PRIOR, family: K.Family | None = None) -> list[tuple[Fit, float]]:
    """For every grid point the posterior mean of beta (flat prior) and variance (inverse gamma prior), its log marginal
    likelihood, and the degrees of freedom; one pass over the ordered neighbour lists."""
    lists = with_ordered_neighbours(df, m, float(nx + ny))
    out = []
    for (range_, share), s in zip(grid, factor_sums(lists, grid, m, family)):
        xx, xy, (yy, logdet, n) = s[:9].reshape(3, 3), s[9:12], s[12:]
        beta = np.linalg.solve(xx + 1e-9 * np.eye(3), xy)
        a, b = prior[0] + n / 2, prior[1] + 0.5 * max(0.0, yy - beta @ xy)
        ll = -0.5 * logdet - a * math.log(b) - 0.5 * np.linalg.slogdet(xx + 1e-9 * np.eye(3))[1]
        out.append((Fit(beta, float(b / max(1.0, a - 1)), range_, share, float(ll), family), 2 * a))
    return out


def cross_validated(df: DataFrame, nx: int, ny: int, fits: list[Fit], m: int, folds: int = 5, spare: int = 10) -> list[tuple[float, float]]:
    """Mean CRPS and squared error of every fit, each observed cell predicted from its m nearest cells of the other folds.

    A cell keeps its m + spare nearest; those of its own fold are passed over.
    """
    seen = cut(df.where("val is not null").withColumn("fold", F.pmod(F.xxhash64(F.lit("cv"), "cell_id"), F.lit(folds)).cast("double")))
    p = _points(seen)
    edges = J.nearest(p, p, m + spare, 4.0, float(nx + ny), F.col("j") != F.col("i"))
    lists = _gathered(seen, edges, seen, "fold")

    def part(frames):
        total = np.zeros((len(fits), 3))
        for f in frames:
            xy, y, fold = _xy(f), f["val"].to_numpy(float), f["fold"].to_numpy(float)
            others = [[] if n is None else [v for v in n if v[3] != k] for n, k in zip(f["near"].tolist(), fold)]
            for rows, near in _batches(others, m):
                for g, fit in enumerate(fits):
                    mean, var = _predicted(near, xy[rows], fit)
                    total[g] += [K.gaussian_crps(mean, np.sqrt(var), y[rows]).sum(), ((mean - y[rows]) ** 2).sum(), len(rows)]
        yield pd.DataFrame({"g": np.arange(len(fits)), "v": list(total)})

    sums = summed(lists.select("ix", "iy", "val", "fold", "near").mapInPandas(part, "g int, v array<double>"))
    return [(sums[g][0] / sums[g][2], sums[g][1] / sums[g][2]) for g in range(len(fits))]


def nearest_neighbour_gp(df: DataFrame, nx: int, ny: int, m: int = 15, grid: Grid = GRID, family: K.Family | None = None) -> DataFrame:
    """Conjugate nearest-neighbour process: range and nugget share by 5-fold cross-validated CRPS, variance under an inverse
    gamma prior, kriging from m neighbours; low and high are the 95 % interval of Student's t."""
    df = cut(df.select("cell_id", "ix", "iy", "val"))
    found = conjugate_fits(df, nx, ny, grid, m, family=family)
    scores = cross_validated(df, nx, ny, [f for f, _ in found], m)
    fit, freedom = found[min(range(len(grid)), key=lambda g: scores[g][0])]
    half = K.t_quantile(0.975, freedom) * math.sqrt((freedom - 2) / freedom)
    out = _local(with_neighbours(df, m, float(nx + ny)), lambda near, xy: (lambda mean, var: (mean, np.sqrt(var)))(*_predicted(near, xy, fit)))
    return out.withColumns({"low": F.col("mean") - F.col("sd") * half, "high": F.col("mean") + F.col("sd") * half})


def cv_table(df: DataFrame, nx: int, ny: int, m: int = 15, grid: Grid = GRID) -> DataFrame:
    """range, share, crps, mse, loglik and variance of every grid point of the nearest-neighbour process."""
    df = cut(df.select("cell_id", "ix", "iy", "val"))
    found = [f for f, _ in conjugate_fits(df, nx, ny, grid, m)]
    scores = cross_validated(df, nx, ny, found, m)
    rows = [(f.range, f.share, float(c), float(e), f.loglik, f.variance) for f, (c, e) in zip(found, scores)]
    return df.sparkSession.createDataFrame(rows, "range double, share double, crps double, mse double, loglik double, variance double")


def _mixture(parts: list[tuple[Fit, float]]):
    def kernel(near, xy):
        first, second = np.zeros(len(xy)), np.zeros(len(xy))
        for fit, w in parts:
            mean, var = _predicted(near, xy, fit)
            first += w * mean
            second += w * (mean * mean + var)
        return first, np.sqrt(np.maximum(1e-12, second - first * first))

    return kernel


def nearest_neighbour_response(df: DataFrame, nx: int, ny: int, m: int = 15, grid: Grid = GRID, family: K.Family | None = None) -> DataFrame:
    """Nearest-neighbour response process: the posterior of range and nugget share over a grid, from the factors of all cells
    in one pass, weighs the predictions. It takes the place of a chain, whose steps would be a job each."""
    df = cut(df.select("cell_id", "ix", "iy", "val"))
    found = [f for f, _ in conjugate_fits(df, nx, ny, grid, m, family=family)]
    top = max(f.loglik for f in found)
    kept = [(f, math.exp(f.loglik - top)) for f in found if f.loglik > top - 7]
    total = sum(w for _, w in kept)
    return _local(with_neighbours(df, m, float(nx + ny)), _mixture([(f, w / total) for f, w in kept]))


def local_gp(df: DataFrame, nx: int, ny: int, m: int = 40, few: int = 100, around: int = 80) -> DataFrame:
    """A global process from `few` cells of a D-optimal design, then for each cell a process on the residuals of m of its `around`
    nearest: the eight nearest, and those that lower the variance there most. Ranges and shares are weighed there by their likelihood;
    the local stage carries the whole variance, as it is one of the residuals."""
    df = cut(df.select("cell_id", "ix", "iy", "val"))
    chosen = d_optimal(df.where("val is not null"), few, (nx + ny) / 8).select("ix", "iy", "val").toPandas()  # `few` rows
    xy, y = _xy(chosen), chosen["val"].to_numpy(float)
    wide = [(r, s) for r in (8.0, 16.0, 32.0, 64.0) for s in (0.01, 0.05, 0.2)]
    best = max((Fit(*K.profile(s, 3)[:2], r, sh, K.profile(s, 3)[2]) for (r, sh), s in zip(wide, K.gls_grid(xy, K.design(xy), y, wide))), key=lambda f: f.loglik)
    rest = y - K.design(xy) @ best.beta

    def overall(at):
        mean, var = K.krige(xy, rest, at, best.variance, best.range, best.share)
        return K.design(at) @ best.beta + mean, np.maximum(0.0, var - best.variance * best.share)

    reach = min(best.range, 16.0)

    def kernel(near, at):
        parts = [designed(near[i : i + 500], at[i : i + 500]) for i in range(0, len(at), 500)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def designed(near, at):
        if near.shape[1] > m:
            near = np.take_along_axis(near, local_design(near, at, m, 8, reach, 0.05)[:, :, None], axis=1)
        p = near[:, :, :2]
        d, to = _pair_distances(near, at)
        left = near[:, :, 2] - overall(p.reshape(-1, 2))[0].reshape(near.shape[:2])
        k, found = near.shape[1], []
        for range_ in (2.0, 5.0, 10.0, 20.0):
            for share in (0.02, 0.1, 0.3):
                r = (1 - share) * K.correlation(d, range_) + (share + 1e-9) * np.eye(k)
                c = (1 - share) * K.correlation(to, range_)
                solved = np.linalg.solve(r, np.stack([left, c], axis=2))
                variance = np.maximum(1e-9, (left * solved[:, :, 0]).sum(axis=1) / max(1, k - 2))  # of Student's t
                mean = (c * solved[:, :, 0]).sum(axis=1)
                found.append((-0.5 * (k * np.log(variance) + np.linalg.slogdet(r)[1]), mean, variance * np.maximum(1e-9, 1 - (c * solved[:, :, 1]).sum(axis=1))))
        ll, mean, var = (np.array(x) for x in zip(*found))
        w = np.exp(ll - ll.max(axis=0))
        w = w / w.sum(axis=0)
        first = (w * mean).sum(axis=0)
        return overall(at)[0] + first, np.sqrt((w * (var + mean * mean)).sum(axis=0) - first * first)

    return _local(with_neighbours(df, around, float(nx + ny)), kernel)


def meta_kriging(df: DataFrame, nx: int, ny: int, per_subset: int = 600, draws: int = 60, seed: int = 5) -> DataFrame:
    """Posteriors of random subsets combined by their geometric median; quantiles of the pooled, weighted draws give mean and sd.

    The number of subsets grows with the observed cells, and every cell is in one. A subset's posterior is a grid over range
    and share, with beta and variance drawn from their conjugate forms. Draws, embeddings and weights stay in Spark; what
    reaches the driver is a row for each point of the grid.
    """
    df = cut(df.select("cell_id", "ix", "iy", "val"))
    seen = df.where("val is not null")
    subsets = max(2, -(-seen.count() // per_subset))

    def own(f: pd.DataFrame) -> pd.DataFrame:
        xy, y, k = _xy(f), f["val"].to_numpy(float), int(f["part"].iloc[0])
        x = K.design(xy)
        stats = K.gls_grid(xy, x, y, GRID)
        ll = np.array([K.profile(s, 3)[2] - 0.5 * np.linalg.slogdet(s[:9].reshape(3, 3) + 1e-9 * np.eye(3))[1] for s in stats])
        chance = np.exp(ll - ll.max())
        rng = np.random.Generator(np.random.PCG64([seed, k]))
        rows = []
        for g in rng.choice(len(GRID), draws, p=chance / chance.sum()):
            beta, variance, _ = K.profile(stats[g], 3)
            drawn = variance * len(y) / max(1e-9, rng.chisquare(max(1, len(y) - 3)))
            at = rng.multivariate_normal(beta, drawn * np.linalg.inv(stats[g][:9].reshape(3, 3) + 1e-9 * np.eye(3)))
            rows.append((k, [*at.tolist(), float(drawn), *GRID[g]]))
        return pd.DataFrame(rows, columns=["part", "theta"])

    part = F.pmod(F.xxhash64(F.lit(seed), "cell_id"), F.lit(subsets)).cast("int")
    drawn = cut(seen.withColumn("part", part).select("part", "ix", "iy", "val").groupBy("part").applyInPandas(own, "part int, theta array<double>"))
    logged = drawn.select("part", F.transform("theta", lambda x, i: F.when(i < 3, x).otherwise(F.log(x))).alias("theta"))
    weighed = drawn.join(geometric_median(logged, 6), "part")
    # Draws of range and share lie on the grid: those that agree share one kriging, their coefficients and variances are averaged.
    mean = lambda i: (F.sum(F.col("w") * F.col("theta")[i]) / F.sum("w")).alias(f"t{i}")
    rows = weighed.groupBy(F.col("theta")[4].alias("range"), F.col("theta")[5].alias("share")).agg(F.sum("w").alias("w"), *[mean(i) for i in range(4)]).collect()  # at most as many as the grid has
    total = sum(r["w"] for r in rows)
    parts = [(Fit(np.array([r["t0"], r["t1"], r["t2"]]), r["t3"], r["range"], r["share"]), r["w"] / total) for r in rows]
    return _local(with_neighbours(df, 15, float(nx + ny)), _mixture(parts))
