"""Designs: the few places that say most about a whole lattice, and the neighbours that say most about one place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.models import kernels as K
from gridloom.session import cut


def greedy_places(xy: np.ndarray, size: int, range_: float, share: float) -> tuple[np.ndarray, float]:
    """Indices of `size` places, each the one that raises the log determinant of their correlations most (the most uncertain one
    given those before), and that log determinant: a Cholesky factorisation with pivots."""
    size = min(size, len(xy))
    left, low, chosen, logdet = np.ones(len(xy)), np.zeros((len(xy), size)), [], 0.0
    for t in range(size):
        p = int(np.argmax(left))
        d = np.sqrt(((xy - xy[p]) ** 2).sum(axis=1))
        column = (1 - share) * K.correlation(d, range_) - low[:, :t] @ low[p, :t]
        column[p] += share
        low[:, t] = column / np.sqrt(left[p])
        logdet += float(np.log(left[p]))
        left = np.maximum(left - low[:, t] ** 2, 1e-12)
        chosen.append(p)
        left[chosen] = -1.0
    return np.array(chosen, np.int64), logdet


def exchanged(xy: np.ndarray, chosen: np.ndarray, range_: float, share: float, passes: int = 2) -> np.ndarray:
    """The design after each of its places in turn gave way to the place that is most uncertain given the others."""
    chosen = chosen.copy()
    for _ in range(passes):
        for t in range(len(chosen)):
            rest = np.delete(chosen, t)
            r = (1 - share) * K.correlation(K.distances(xy[rest], xy[rest]), range_) + share * np.eye(len(rest))
            c = (1 - share) * K.correlation(K.distances(xy[rest], xy), range_)
            left = 1 - (c * np.linalg.solve(r, c)).sum(axis=0)
            left[rest] = -1.0
            best = int(np.argmax(left))
            if left[best] > left[chosen[t]] + 1e-12:
                chosen[t] = best
    return chosen


def d_optimal(df: DataFrame, size: int, range_: float, share: float = 0.05, side: int = 20, group: int = 4, spare: int = 3) -> DataFrame:
    """The rows of `size` cells (ix, iy and other columns) with a nearly greatest determinant of their correlations.

    Every square tile picks `spare * size` of its cells greedily, then every group x group of tiles picks among the picks of its
    members, until one group is left, which picks `size` and exchanges some: a task sees a tile's cells or the picks of a few tiles, whatever
    the lattice's size.
    """
    rows = df.withColumns({"tx": F.floor(F.col("ix") / side).cast("int"), "ty": F.floor(F.col("iy") / side).cast("int")})
    schema = rows.schema

    def picking(n: int, last: bool):
        def pick(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["ix", "iy"])
            xy = f[["ix", "iy"]].to_numpy(float)
            chosen = greedy_places(xy, n, range_, share)[0]
            return f.iloc[exchanged(xy, chosen, range_, share) if last else chosen]

        return pick

    while True:
        rows = cut(rows.groupBy("tx", "ty").applyInPandas(picking(spare * size, False), schema))
        if rows.select("tx", "ty").distinct().count() <= 1:
            return rows.groupBy("tx", "ty").applyInPandas(picking(size, True), schema).drop("tx", "ty")
        rows = rows.withColumns({c: F.floor(F.col(c) / group).cast("int") for c in ("tx", "ty")})


def local_design(near: np.ndarray, at: np.ndarray, size: int, first: int, range_: float, share: float) -> np.ndarray:
    """For each place (rows, 2) the indices (rows, size) of the neighbours (rows, k, 2 or more; nearest first) to use.

    The `first` nearest are taken; then, again and again, the neighbour whose value would lower the variance of the place's
    prediction most, given those taken. All rows go at once.
    """
    k, rows = near.shape[1], np.arange(len(near))
    xy = near[:, :, :2]
    left, low = np.ones((len(near), k)), np.zeros((len(near), k, size))
    shared = (1 - share) * K.correlation(np.sqrt(((xy - at[:, None]) ** 2).sum(axis=2)), range_)  # with the place, given those taken
    taken = np.zeros((len(near), k), bool)
    out = np.zeros((len(near), size), np.int64)
    for t in range(size):
        gain = np.where(taken, -1.0, shared**2 / np.maximum(left, 1e-9))
        p = np.full(len(near), t) if t < first else np.argmax(gain, axis=1)
        d = np.sqrt(((xy - xy[rows, p][:, None]) ** 2).sum(axis=2))
        column = (1 - share) * K.correlation(d, range_) - (low[:, :, :t] * low[rows, p, :t][:, None]).sum(axis=2)
        column[rows, p] += share
        root = np.sqrt(np.maximum(1e-9, left[rows, p]))
        low[:, :, t] = column / root[:, None]
        shared = shared - low[:, :, t] * (shared[rows, p] / root)[:, None]
        left = left - low[:, :, t] ** 2
        taken[rows, p] = True
        out[:, t] = p
    return out
