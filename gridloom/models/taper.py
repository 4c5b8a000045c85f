"""Kriging with a tapered covariance as one sparse system over the whole lattice."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.models import fields, solver, torus
from gridloom.models import kernels as K
from gridloom.models.fields import OUT, Fit
from gridloom.session import cut


def tapered_kriging(df: DataFrame, nx: int, ny: int, fit: Fit, delta: float, trend: str, draws: int, side: int = 20, seed: int = 1, x0: int = 0, y0: int = 1, tolerance: float = 1e-5) -> DataFrame:
    """mean and sd of the missing cells, for an exponential covariance that a Wendland function cuts off at delta.

    One system over all observed cells is solved for the residuals and, as further right-hand sides, for fields drawn on the
    whole lattice with the same covariance and noise; sd is that of the draws less their own predictions. Nothing is cut at
    the borders of tiles: the halo only says which columns a tile's rows have.
    """
    spark = df.sparkSession
    signal = fit.variance * (1 - fit.share)
    covariance = lambda d: signal * K.correlation(d, fit.range, delta, fit.family)
    noise = fit.variance * max(fit.share, 1e-8)

    by_step = covariance(np.sqrt(np.arange(math.ceil(delta) + 1)[:, None] ** 2.0 + np.arange(math.ceil(delta) + 1)[None, :] ** 2.0))
    by_step[0, 0] += noise
    by_step = np.pad(by_step, (0, 1))  # the last row and column: beyond the taper
    beyond = len(by_step) - 1

    def entries(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places are whole numbers, so the covariance is looked up by their steps apart."""
        apart = [np.minimum(np.abs(np.subtract.outer(p[:, k].astype(np.int32), q[:, k].astype(np.int32))), beyond) for k in (0, 1)]
        return by_step[apart[0], apart[1]]

    def residuals(frames):
        for f in frames:
            mu = K.design(f[["ix", "iy"]].to_numpy(float), trend, nx, ny) @ fit.beta
            yield pd.DataFrame({"id": f["cell_id"], "ix": f["ix"], "iy": f["iy"], "mu": mu, "rest": f["val"] - mu})

    tiles = solver.Tiles(side, math.ceil(delta), math.ceil(delta / 2))
    cells = df.select("cell_id", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("val").cast("double").alias("val"))
    rows = cells.mapInPandas(residuals, "id long, ix int, iy int, mu double, rest double")
    free = torus.draw_fields(spark, nx, ny, draws, covariance, seed, delta, noise)
    free = free.select((F.col("ix") + x0).alias("ix"), (F.col("iy") + y0).alias("iy"), F.col("v").alias("free"))
    rows = cut(rows.join(free, ["ix", "iy"]))
    known = rows.where("rest is not null and not isnan(rest)").select("id", "ix", "iy", F.concat(F.array("rest"), "free").alias("b"))
    gone = rows.where("rest is null or isnan(rest)")
    weights = solver.solve(known, draws + 1, entries, tiles, tolerance)
    moved = solver.apply_rows(weights, gone, entries, tiles)

    def finish(frames):
        for f in frames:
            made = np.array([np.zeros(draws + 1) if v is None else np.frombuffer(v) for v in f["v"]]).reshape(len(f), draws + 1)
            errors = np.array(f["free"].tolist()).reshape(len(f), draws) - made[:, 1:]
            yield pd.DataFrame({"cell_id": f["id"], "mean": f["mu"].to_numpy() + made[:, 0], "sd": np.sqrt((errors**2).mean(axis=1))})

    return gone.join(moved.select("id", "v"), "id").select("id", "mu", "free", "v").mapInPandas(finish, OUT)


def tapered(df: DataFrame, nx: int, ny: int, delta: float = 10.0, trend: str = "bisquare", draws: int = 48, family: K.Family | None = None) -> DataFrame:
    """The tapered model with parameters fitted under the taper by the likelihood of tiles."""
    fit = fields.best_fit(df, nx, ny, fields.GRID, trend, delta, per_tile=100, family=family)
    return tapered_kriging(df, nx, ny, fit, delta, trend, draws)


def circulant_kriging(df: DataFrame, nx: int, ny: int, draws: int = 48, side: int = 20, halo: int = 10, trend: str = "linear", seed: int = 1, x0: int = 0, y0: int = 1, fit: Fit | None = None, family: K.Family | None = None) -> DataFrame:
    """mean and sd of the missing cells from fields that circulant embedding draws on the whole lattice.

    A tile kriges the residuals, and each drawn field as if only the observed cells of it were known; sd is that of the draws
    less their predictions. Draws go on across tiles, as the lattice is embedded once.
    """
    fit = fit or fields.best_fit(df, nx, ny, fields.GRID, trend, None, per_tile=200, family=family)
    signal, noise = fit.variance * (1 - fit.share), fit.variance * max(fit.share, 1e-8)
    covariance = lambda d: signal * K.correlation(d, fit.range, None, fit.family)
    free = torus.draw_fields(df.sparkSession, nx, ny, draws, covariance, seed, None, noise)
    free = free.select((F.col("ix") + x0).alias("ix"), (F.col("iy") + y0).alias("iy"), F.col("v").alias("free"))
    cells = df.select(F.col("cell_id").alias("id"), F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.col("val").cast("double").alias("val"))
    rows = solver.Tiles(side, halo, halo).with_halos(cells.join(free, ["ix", "iy"])).where("own or val is not null")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        seen, gone = f[f["val"].notna()], f[f["val"].isna()]
        if not len(gone):
            return pd.DataFrame({"cell_id": [], "mean": [], "sd": []})
        at, to = seen[["ix", "iy"]].to_numpy(float), gone[["ix", "iy"]].to_numpy(float)
        rest = seen["val"].to_numpy(float) - K.design(at, trend, nx, ny) @ fit.beta
        known, wanted = (np.array(g["free"].tolist(), float).reshape(len(g), draws) for g in (seen, gone))
        moved = np.zeros((len(gone), draws + 1))
        if len(seen):
            c = covariance(K.distances(at, at)) + noise * np.eye(len(at))
            moved = covariance(K.distances(to, at)) @ np.linalg.solve(c, np.column_stack([rest, known]))
        return pd.DataFrame({"cell_id": gone["id"], "mean": K.design(to, trend, nx, ny) @ fit.beta + moved[:, 0], "sd": np.sqrt(((wanted - moved[:, 1:]) ** 2).mean(axis=1))})

    return rows.groupBy("tx", "ty").applyInPandas(run, OUT)
