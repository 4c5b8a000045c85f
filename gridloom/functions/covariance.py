"""Covariances, tapers, bases and distances as Columns, with NumPy twins for blocks inside tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exponential:
    """variance * exp(-d / range)"""

    variance: float
    range: float

    def col(self, d: Column) -> Column:
        return F.exp(d * (-1 / self.range)) * self.variance

    def np(self, d: np.ndarray) -> np.ndarray:
        return self.variance * np.exp(-d / self.range)


@dataclass(frozen=True)
class Matern:
    """Closed forms for smoothness 1/2, 3/2 and 5/2."""

    variance: float
    range: float
    smoothness: float = 0.5

    def _poly(self, x, sqrt3, sqrt5):
        if self.smoothness == 0.5:
            return x, x * 0 + 1
        if self.smoothness == 1.5:
            return x * sqrt3, x * sqrt3 + 1
        if self.smoothness == 2.5:
            return x * sqrt5, x * sqrt5 + x * x * (5 / 3) + 1
        raise ValueError("smoothness must be 0.5, 1.5 or 2.5")

    def col(self, d: Column) -> Column:
        x, poly = self._poly(d * (1 / self.range), math.sqrt(3), math.sqrt(5))
        return F.exp(x * -1.0) * poly * self.variance

    def np(self, d: np.ndarray) -> np.ndarray:
        x, poly = self._poly(d / self.range, math.sqrt(3), math.sqrt(5))
        return self.variance * poly * np.exp(-x)


def decay_for(distance: float, correlation: float = 0.05) -> float:
    """The decay at which the exponential correlation falls to `correlation` at `distance`."""
    return -math.log(correlation) / distance


def wendland(d: Column, delta: float) -> Column:
    """Compactly supported taper: (1 - d/delta)^4 (4 d/delta + 1) below delta, else 0."""
    x = d * (1 / delta)
    return F.when(d < delta, F.pow(1.0 - x, F.lit(4.0)) * (x * 4.0 + 1.0)).otherwise(F.lit(0.0))


def wendland_np(d: np.ndarray, delta: float) -> np.ndarray:
    x = d / delta
    return np.where(d < delta, (1 - x) ** 4 * (4 * x + 1), 0.0)


def bisquare(d: Column, radius: float) -> Column:
    x = d * (1 / radius)
    return F.when(d <= radius, F.pow(1.0 - x * x, F.lit(2.0))).otherwise(F.lit(0.0))


def bisquare_np(d: np.ndarray, radius: float) -> np.ndarray:
    x = d / radius
    return np.where(d <= radius, (1 - x * x) ** 2, 0.0)


def exponential_variogram(h: Column, nugget: float, sill: float, range_: float) -> Column:
    return (1.0 - F.exp(h * (-1 / range_))) * sill + nugget


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def spde_constants(range_: float, variance: float, smoothness: float = 1.0) -> tuple[float, float]:
    """kappa and tau of the stochastic partial differential equation in two dimensions."""
    kappa = math.sqrt(8 * smoothness) / range_
    tau = math.sqrt(math.gamma(smoothness) / (math.gamma(smoothness + 1) * 4 * math.pi * kappa ** (2 * smoothness) * variance))
    return kappa, tau


def tree_size(n: int, per_region: int, branching: int) -> tuple[int, int]:
    """Regions and levels of a tree with about per_region points in a region."""
    regions = n / per_region
    return math.ceil(regions), math.ceil(math.log(regions) / math.log(branching))
