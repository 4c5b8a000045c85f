"""Draws of stationary fields on whole lattices by circulant embedding, the Fourier transform dealt over tasks.

The torus is cut into blocks of rows and blocks of columns. A task transforms its rows, hands each block of columns its piece,
and a task of columns goes on from there: a two-dimensional transform is two shuffles of the torus, and no task holds more
than one block, whatever the size of the lattice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut

Covariance = Callable[[np.ndarray], np.ndarray]
PIECE = "r int, c int, v binary"
#: Complex numbers that a task works on at a time.
BLOCK = 1 << 19
#: Pairs of draws that a task of columns makes.
PAIRS = 8


def _cut_points(n: int, other: int) -> np.ndarray:
    """The bounds of blocks of n rows of length `other`."""
    return np.linspace(0, n, min(n, -(-n * other // BLOCK)) + 1).astype(int)


def _pieces(r: int, block: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"r": r, "c": range(len(bounds) - 1), "v": [block[:, a:b].tobytes() for a, b in zip(bounds, bounds[1:])]})


def _spectrum(spark: SparkSession, mx: int, my: int, covariance: Covariance) -> DataFrame:
    """r, c, v: the covariance to the origin with its rows transformed, in pieces of a block of rows and a block of columns."""
    rows, columns = _cut_points(mx, my), _cut_points(my, mx)
    dy = np.minimum(np.arange(my), my - np.arange(my)).astype(float)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        r = int(f["id"].iloc[0])
        x = np.arange(rows[r], rows[r + 1])
        dx = np.minimum(x, mx - x).astype(float)
        return _pieces(r, np.fft.fft(covariance(np.sqrt(dx[:, None] ** 2 + dy[None, :] ** 2)), axis=1), columns)

    return spark.range(len(rows) - 1).groupBy("id").applyInPandas(run, PIECE)


def _eigenvalues(f: pd.DataFrame, mx: int) -> np.ndarray:
    """The transform of a block of columns, put together from its pieces; the covariance is even, so it is real."""
    pieces = [np.frombuffer(v, complex) for v in f.sort_values("r")["v"]]
    return np.fft.fft(np.concatenate(pieces).reshape(mx, -1), axis=0).real


def _mass(mx: int):
    """The sums of the negative and of all eigenvalues of a block of columns."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        values = _eigenvalues(f, mx)
        return pd.DataFrame({"low": [-values[values < 0].sum()], "all": [values.sum()]})

    return run


def embedded_size(spark: SparkSession, nx: int, ny: int, covariance: Covariance, reach: float | None = None, tolerance: float = 1e-3) -> tuple[int, int, DataFrame]:
    """Sides of a torus on which the covariance has (nearly) no negative eigenvalues, and its row-transformed covariance.

    With a reach beyond which the covariance is zero, a torus wider by the reach is exact. Otherwise its sides are doubled until
    negative eigenvalues hold less than `tolerance` of the sum; they are then taken as zero.
    """
    if reach is not None:
        mx, my = nx + int(np.ceil(reach)), ny + int(np.ceil(reach))
        return mx, my, cut(_spectrum(spark, mx, my, covariance))
    for grow in (2, 4, 8):
        mx, my = grow * nx, grow * ny
        found = cut(_spectrum(spark, mx, my, covariance))
        low, total = found.groupBy("c").applyInPandas(_mass(mx), "low double, all double").agg(F.sum("low"), F.sum("all")).first()
        if low < tolerance * total:
            return mx, my, found
    raise ValueError(f"the covariance reaches too far for a lattice of {nx} by {ny}")


def draw_fields(spark: SparkSession, nx: int, ny: int, draws: int, covariance: Covariance, seed: int = 1, reach: float | None = None, nugget: float = 0.0) -> DataFrame:
    """ix (from 0), iy (from 0) and v, an array of `draws` independent stationary fields, with independent noise of variance nugget.

    Noise is seeded by block, so a task that runs again gives the same; one complex transform gives two fields.
    """
    mx, my, spectrum = embedded_size(spark, nx, ny, covariance, reach)
    columns, rows = _cut_points(my, mx), _cut_points(mx, my * draws)  # a task of rows holds all draws
    last = int(np.searchsorted(rows, nx))
    pairs = -(-draws // 2)

    def noise(f: pd.DataFrame) -> pd.DataFrame:
        c, turn = int(f["c"].iloc[0]), int(f["turn"].iloc[0])
        scale = np.sqrt(np.maximum(0.0, _eigenvalues(f, mx)) / (mx * my))
        out = []
        for k in range(turn * PAIRS, min(pairs, (turn + 1) * PAIRS)):
            rng = np.random.Generator(np.random.PCG64([seed, c, k]))
            field = np.fft.fft(scale * (rng.standard_normal(scale.shape) + 1j * rng.standard_normal(scale.shape)), axis=0)
            out += [(r, c, k, field[a:b].tobytes()) for r, (a, b) in enumerate(zip(rows[:last], rows[1:]))]
        return pd.DataFrame(out, columns=["r", "c", "k", "v"])

    def back(f: pd.DataFrame) -> pd.DataFrame:
        r = int(f["r"].iloc[0])
        high = min(rows[r + 1], nx) - rows[r]
        fields = []
        for _, g in f.sort_values(["k", "c"]).groupby("k"):
            row = np.concatenate([np.frombuffer(v, complex).reshape(rows[r + 1] - rows[r], -1) for v in g["v"]], axis=1)
            field = np.fft.fft(row, axis=1)[:high, :ny]
            fields += [field.real, field.imag]
        v = np.stack(fields[:draws], axis=-1).reshape(high * ny, draws)
        if nugget > 0:
            v = v + np.sqrt(nugget) * np.random.Generator(np.random.PCG64([seed, r, 1 << 20])).standard_normal(v.shape)
        ix, iy = np.divmod(np.arange(high * ny), ny)
        return pd.DataFrame({"ix": (ix + rows[r]).astype(np.int32), "iy": iy.astype(np.int32), "v": list(v)})

    turns = spectrum.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit((pairs - 1) // PAIRS))))
    mixed = turns.groupBy("c", "turn").applyInPandas(noise, "r int, c int, k int, v binary")
    return mixed.groupBy("r").applyInPandas(back, "ix int, iy int, v array<double>")


def simulate(df: DataFrame, draws: int, variance: float, range_: float, nugget: float, mean: float, seed: int = 1) -> DataFrame:
    """cell_id, draw and v: stationary exponential fields at the cells of df, drawn on the rectangle that holds them."""
    x0, x1, y0, y1 = df.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    if x0 is None:
        return df.select("cell_id", F.lit(0).alias("draw"), F.lit(mean).alias("v"))
    free = draw_fields(df.sparkSession, x1 - x0 + 1, y1 - y0 + 1, draws, lambda d: variance * np.exp(-d / range_), seed, None, nugget)
    placed = free.select((F.col("ix") + x0).alias("ix"), (F.col("iy") + y0).alias("iy"), F.posexplode("v").alias("draw", "v"))
    return df.select("cell_id", "ix", "iy").join(placed, ["ix", "iy"]).select("cell_id", "draw", (F.col("v") + mean).alias("v"))
