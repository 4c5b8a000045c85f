"""The geometric median of many subset posteriors, each given by draws.

A posterior is a point in the space of a Gaussian kernel. Random Fourier features give it a fixed number of coordinates, so
means and distances are vector sums in Spark and nothing that reaches the driver grows with the subsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.models.fields import summed
from gridloom.session import cut


def embeddings(draws: DataFrame, dim: int, features: int, seed: int) -> DataFrame:
    """part and mu: the mean over each part's draws (theta, an array of dim) of their features; the kernel's width is the square
    root of dim standard deviations."""
    ends = draws.agg(*[F.stddev_pop(F.col("theta")[i]) for i in range(dim)]).first()
    scale = np.maximum(1e-9, [x or 0.0 for x in ends])
    rng = np.random.Generator(np.random.PCG64(seed))
    ways, turns = rng.standard_normal((dim, features)) / np.sqrt(dim) / scale[:, None], rng.uniform(0, 2 * np.pi, features)

    def mean(f: pd.DataFrame) -> pd.DataFrame:
        theta = np.array(f["theta"].tolist())
        return pd.DataFrame({"part": f["part"].iloc[:1], "mu": [np.sqrt(2 / features) * np.cos(theta @ ways + turns).mean(axis=0)]})

    return draws.groupBy("part").applyInPandas(mean, f"part {draws.schema['part'].dataType.simpleString()}, mu array<double>")


def geometric_median(draws: DataFrame, dim: int, features: int = 1024, steps: int = 50, tolerance: float = 1e-4, seed: int = 3) -> DataFrame:
    """part and w: the weights, of sum one, of the parts' posteriors in their geometric median.

    Weiszfeld's steps: the next centre weighs every point by one over its distance from this one. A step is one sum over the parts.
    """
    points = cut(embeddings(draws, dim, features, seed))

    def toward(centre: np.ndarray | None):
        def run(frames):
            for f in frames:
                if len(f):
                    mu = np.array(f["mu"].tolist())
                    near = np.ones(len(mu)) if centre is None else 1 / np.sqrt(np.maximum(1e-12, ((mu - centre) ** 2).sum(axis=1)))
                    yield pd.DataFrame({"g": [0], "v": [np.concatenate([near @ mu, [near.sum()]])]})

        return run

    def away(f: pd.DataFrame, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(1e-12, ((np.array(f["mu"].tolist()) - centre) ** 2).sum(axis=1)))

    centre, total = None, 0.0
    for _ in range(steps):
        sums = summed(points.select("mu").mapInPandas(toward(centre), "g int, v array<double>"))
        if not sums:
            return points.select("part", F.lit(1.0).alias("w"))
        total = sums[0][-1]
        fresh = sums[0][:-1] / total
        done = centre is not None and np.abs(fresh - centre).max() < tolerance * max(1e-9, np.abs(fresh).max())
        if done:
            break  # total is the sum of the weights at `centre`
        centre = fresh
    else:
        total = summed(points.select("mu").mapInPandas(toward(centre), "g int, v array<double>"))[0][-1]

    def weigh(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"part": f["part"], "w": 1 / away(f, centre) / total})

    return points.mapInPandas(weigh, f"part {draws.schema['part'].dataType.simpleString()}, w double")
