"""Multiresolution approximation of a Gaussian process on a tree of tiles (Katzfuss 2017), one Spark pass a level.

Every tile above the leaves has a few knots; its basis functions are what the covariance leaves of them after the levels
above. A leaf can work out the basis of all its ancestors from their knots alone (the prior). Leaves hand up the sums
B' V^-1 B and B' V^-1 y; each level adds those of its children, conditions on its own coefficients and hands up the rest
(the posterior). Leaves then predict with the posterior of their ancestors. Below the knots nothing is left out within a
leaf; what is dropped is only what the knots do not carry between tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.models import kernels as K
from gridloom.models.fields import OUT, Fit, _xy, best_fit
from gridloom.operators.joins import tile_of
from gridloom.session import cut

#: Levels below the root whose rows, fewer than 2**TOP, are broadcast.
TOP = 8
STATE = "tile int, a array<double>, w array<double>"


def _knots(box: tuple[float, float, float, float], side: int) -> np.ndarray:
    at = (np.arange(side) + 0.5) / side
    return np.array([(box[0] + u * (box[1] - box[0]), box[2] + v * (box[3] - box[2])) for u in at for v in at])


def prior(places: np.ndarray, path: list[np.ndarray], fit: Fit) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The basis of each ancestor at the places, and the inverse of each one's prior precision (its coefficients' covariance
    is the inverse of what its basis has at its own knots). path: the ancestors' knots from the root."""
    cov = lambda p, q: fit.variance * (1 - fit.share) * K.correlation(K.distances(p, q), fit.range, None, fit.family)
    own: list[list[np.ndarray]] = []
    inverse: list[np.ndarray] = []

    def basis(p: np.ndarray, upto: int) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for k in range(upto):
            b = cov(p, path[k])
            for l in range(k):
                b = b - found[l] @ inverse[l] @ own[k][l].T
            found.append(b)
        return found

    for m, q in enumerate(path):
        own.append(basis(q, m))
        w = cov(q, q)
        for l in range(m):
            w = w - own[m][l] @ inverse[l] @ own[m][l].T
        inverse.append(np.linalg.inv(w + 1e-6 * fit.variance * np.eye(len(q))))
    return basis(places, len(path)), inverse


def multiresolution(df: DataFrame, nx: int, ny: int, per_tile: int = 300, side: int = 4, fit: Fit | None = None, levels: int | None = None, family: K.Family | None = None) -> DataFrame:
    """Kriging under the approximation; tiles halve until a leaf has about per_tile cells, each tile above has side^2 knots."""
    fit = fit or best_fit(df, nx, ny, family=family)
    levels = levels if levels is not None else max(0, math.ceil(math.log2(max(1.0, nx * ny / per_tile))))
    size = side * side
    # A tile's box follows from its number, so tasks work out the path of their tile for themselves.
    def path(tile: int, upto: int) -> list[np.ndarray]:
        boxes, box, w, h = [], (0.0, float(nx), 1.0, float(ny + 1)), float(nx), float(ny)
        for level in range(upto):
            boxes.append(_knots(box, side))
            bit = tile >> (upto - level - 1) & 1
            if w >= h:
                mid, w = (box[0] + box[1]) / 2, w / 2
                box = (mid, box[1], box[2], box[3]) if bit else (box[0], mid, box[2], box[3])
            else:
                mid, h = (box[2] + box[3]) / 2, h / 2
                box = (box[0], box[1], mid, box[3]) if bit else (box[0], box[1], box[2], mid)
        return boxes

    cells = cut(df.select(tile_of(nx, ny, levels, 0, 1).alias("tile"), "cell_id", F.col("ix").cast("double").alias("ix"), F.col("iy").cast("double").alias("iy"), F.col("val").cast("double").alias("val")))

    def leaf(f: pd.DataFrame):
        """Observed places, their rest, basis, residual covariance with noise, and the prior inverses."""
        seen = f[f["val"].notna()]
        xy = _xy(seen)
        b, inverse = prior(xy, path(int(f["tile"].iloc[0]), levels), fit)
        v = fit.variance * (1 - fit.share) * K.correlation(K.distances(xy, xy), fit.range, None, fit.family)
        for k in range(levels):
            v = v - b[k] @ inverse[k] @ b[k].T
        v = v + fit.variance * (fit.share + 1e-9) * np.eye(len(xy))
        return xy, seen["val"].to_numpy(float) - K.design(xy) @ fit.beta, (np.hstack(b) if b else np.zeros((len(xy), 0))), v, inverse

    def up(f: pd.DataFrame) -> pd.DataFrame:
        xy, rest, b, v, _ = leaf(f)
        solved = np.linalg.solve(v, np.column_stack([b, rest])) if len(xy) else np.zeros((0, b.shape[1] + 1))
        return pd.DataFrame({"tile": [int(f["tile"].iloc[0]) // 2], "a": [(b.T @ solved[:, :-1]).ravel().tolist()], "w": [(b.T @ solved[:, -1]).tolist()]})

    # Upwards: a row a child; each tile keeps its posterior (for the leaves below) and hands up what is left.
    posteriors = []
    state = cells.groupBy("tile").applyInPandas(up, STATE) if levels else None
    def condition(level: int):
        n = (level + 1) * size
        own, above = slice(n - size, n), slice(0, n - size)

        def run(f: pd.DataFrame) -> pd.DataFrame:
            tile = int(f["tile"].iloc[0])
            a, w = np.sum([np.asarray(x) for x in f["a"]], axis=0).reshape(n, n), np.sum([np.asarray(x) for x in f["w"]], axis=0)
            _, inverse = prior(np.zeros((0, 2)), path(2 * tile, level + 1), fit)  # of a child on either side: its path ends here
            k = np.linalg.inv(np.linalg.inv(inverse[level]) + a[own, own])
            return pd.DataFrame({
                "tile": [tile], "k": [k.ravel().tolist()], "m": [(k @ w[own]).tolist()], "c": [(k @ a[own, above]).ravel().tolist()],
                "a": [(a[above, above] - a[above, own] @ k @ a[own, above]).ravel().tolist()], "w": [(w[above] - a[above, own] @ k @ w[own]).tolist()],
            })

        return run

    for level in reversed(range(levels)):
        done = cut(state.groupBy("tile").applyInPandas(condition(level), "tile int, k array<double>, m array<double>, c array<double>, a array<double>, w array<double>"))
        posteriors.append(done.select(F.col("tile").alias("ancestor"), F.lit(level).alias("level"), "k", "m", "c"))
        state = done.select(F.expr("tile div 2").cast("int").alias("tile"), "a", "w")

    def down(f: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        gone = f[f["val"].isna()]
        if not len(gone):
            return pd.DataFrame({"cell_id": [], "mean": [], "sd": []})
        xy, rest, b, v, inverse = leaf(f)
        to = _xy(gone)
        bt, _ = prior(to, path(int(f["tile"].iloc[0]), levels), fit)
        cov = fit.variance * (1 - fit.share) * K.correlation(K.distances(to, xy), fit.range, None, fit.family)
        var = np.full(len(to), fit.variance)
        for k in range(levels):
            own = bt[k] @ inverse[k]
            cov = cov - own @ b[:, k * size : (k + 1) * size].T
            var = var - (own * bt[k]).sum(axis=1)
        left = np.hstack(bt) if bt else np.zeros((len(to), 0))
        gain = np.linalg.solve(v, cov.T).T if len(xy) else np.zeros((len(to), 0))
        mean, var, left = gain @ rest, var - (gain * cov).sum(axis=1), left - gain @ b
        for row in above.sort_values("level", ascending=False).itertuples():
            own = left[:, row.level * size : (row.level + 1) * size]
            mean = mean + own @ np.asarray(row.m)
            var = var + np.einsum("ij,ij->i", own @ np.asarray(row.k).reshape(size, size), own)
            left = left[:, : row.level * size] - own @ np.asarray(row.c).reshape(size, row.level * size)
        return pd.DataFrame({"cell_id": gone["cell_id"], "mean": K.design(to) @ fit.beta + mean, "sd": np.sqrt(np.maximum(1e-12, var))})

    if not levels:
        return cells.groupBy("tile").applyInPandas(lambda f: down(f, pd.DataFrame({"level": []})), OUT)
    every = posteriors[0]
    for p in posteriors[1:]:
        every = every.unionByName(p)
    up_path = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.floor(F.col("tile") / F.pow(F.lit(2.0), k)).cast("int"))
    leaves = cells.select("tile").distinct().select(F.col("tile").alias("leaf"), F.explode(up_path).alias("ancestor"))
    top = F.col("level") < TOP  # every leaf asks for these few rows, so they go to the leaves
    wanted = leaves.join(F.broadcast(every.where(top)), "ancestor").unionByName(leaves.join(every.where(~top), "ancestor"))
    return cells.groupBy("tile").cogroup(wanted.groupBy("leaf")).applyInPandas(down, OUT)
