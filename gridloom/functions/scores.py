"""Scores of a normal predictive distribution (mean m, standard deviation s) against an outcome y.

All are null when any argument is null. A standard deviation of zero gives null where the score divides by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Q975 = 1.959963984540054

# The coefficients of a published rational approximation of the normal tail, highest power first.
TAIL_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_SPLIT, TAIL_ROOT = 7.07106781186547, 2.506628274631
# Those of a published rational approximation of the normal quantile, highest power first.
QUANTILE_NUMERATOR, QUANTILE_DENOMINATOR = (0.010328, 0.802853, 2.515517), (0.001308, 0.189269, 1.432788, 1.0)
# The end of the fixed values.


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_pdf(z: Column) -> Column:
    return F.exp(z * z * -0.5) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(a * a * -0.5)
    near = e * _horner(a, TAIL_NUMERATOR) / _horner(a, TAIL_DENOMINATOR)
    far = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(k) / far
    tail = F.when(a < TAIL_SPLIT, near).otherwise(e / far / TAIL_ROOT)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The z below which a standard normal lies with chance p; null outside of 0 < p < 1.

    An approximation, then three steps of Halley's method on the distribution function, all on the lower tail.
    """
    low = F.least(p, 1.0 - p)
    t = F.sqrt(F.log(F.when((p > 0) & (p < 1), low)) * -2.0)
    start = _horner(t, QUANTILE_NUMERATOR) / _horner(t, QUANTILE_DENOMINATOR) - t
    state = F.array(F.struct(start.alias("z"), low.alias("q")))

    def step(s: Column) -> Column:
        e = (normal_cdf(s["z"]) - s["q"]) / normal_pdf(s["z"])
        return F.struct((s["z"] - e / (1.0 + s["z"] * e / 2.0)).alias("z"), s["q"].alias("q"))

    for _ in range(3):
        state = F.transform(state, step)
    z = state[0]["z"]
    return F.when(p < 0.5, z).otherwise(z * -1.0)


def normal_cdf_sql(z: str) -> str:
    """The same as SQL text, for oracles."""

    def horner(coefficients: tuple[float, ...]) -> str:
        out = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * abs({z}) + {c!r}::DOUBLE)"
        return out

    e, far = f"exp(abs({z}) * abs({z}) * -0.5)", f"(abs({z}) + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"(abs({z}) + {k} / {far})"
    tail = f"(CASE WHEN abs({z}) < {TAIL_SPLIT} THEN {e} * {horner(TAIL_NUMERATOR)} / {horner(TAIL_DENOMINATOR)} ELSE {e} / {far} / {TAIL_ROOT} END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def z_score(m: Column, s: Column, y: Column) -> Column:
    return (y - m) / F.nullif(s, F.lit(0.0))


def squared_error(m: Column, s: Column, y: Column) -> Column:
    return (m - y) * (m - y)


def absolute_error(m: Column, s: Column, y: Column) -> Column:
    return F.abs(m - y)


def crps(m: Column, s: Column, y: Column) -> Column:
    """Continuous ranked probability score."""
    z = z_score(m, s, y)
    return s * (z * (normal_cdf(z) * 2 - 1) + normal_pdf(z) * 2 - 1 / math.sqrt(math.pi))


def interval_score(m: Column, s: Column, y: Column, alpha: float = 0.05, q: float = Q975) -> Column:
    """Width of the central interval plus the scaled distance by which the outcome lies outside."""
    h = s * q
    outside = F.greatest(F.lit(0.0), m - h - y) + F.greatest(F.lit(0.0), y - m - h)  # greatest() skips nulls
    return F.when(y.isNotNull() & m.isNotNull(), h * 2 + outside * (2 / alpha))


def covered(m: Column, s: Column, y: Column, q: float = Q975, strict: bool = False) -> Column:
    """Whether the outcome lies in the interval, its ends included unless strict; as 1.0 or 0.0."""
    inside = (y > m - s * q) & (y < m + s * q) if strict else (y >= m - s * q) & (y <= m + s * q)
    return inside.cast("double")


def ignorance(m: Column, s: Column, y: Column) -> Column:
    z = z_score(m, s, y)
    return z * z / 2 + F.log(F.nullif(s, F.lit(0.0)))


def pit(m: Column, s: Column, y: Column) -> Column:
    """Probability integral transform."""
    return normal_cdf(z_score(m, s, y))


#: Scores by name and family of the predictive distribution; other families may be added.
FAMILIES: dict[str, dict[str, Callable[..., Column]]] = {
    "normal": {"sqerr": squared_error, "abserr": absolute_error, "crps": crps, "inter": interval_score, "cover": covered, "ign": ignorance, "pit": pit}
}


def score(name: str, m: Column, s: Column, y: Column, family: str = "normal") -> Column:
    return FAMILIES[family][name](m, s, y)


def sd_from_interval(lower: Column, upper: Column, q: float = Q975) -> Column:
    return (upper - lower) / (2 * q)


def interval_from_sd(m: Column, s: Column, q: float = 1.96) -> tuple[Column, Column]:
    return m - s * q, m + s * q


def nugget_sd(s: Column, nugget_variance: float) -> Column:
    return F.sqrt(s * s + nugget_variance)


def combine_stages(mean1: Column, var1: Column, mean2: Column, var2: Column, nugget1: Column | float = 0.0) -> tuple[Column, Column]:
    """Means and variances of two independent stages add; the first one's nugget, which the second has too, is taken off."""
    return mean1 + mean2, F.greatest(var1 - nugget1, F.lit(0.0)) + var2


def t_interval(m: Column, variance: Column, shape: float, t_quantile: float) -> tuple[Column, Column]:
    """Student-t interval of an inverse-gamma shape; the quantile for 2 * shape degrees is the caller's."""
    h = F.sqrt(variance * ((shape - 1) / shape)) * t_quantile
    return m - h, m + h


def logit(p: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.log((p - low) / (F.lit(high) - p))


def inverse_logit(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(high) - (high - low) / (F.exp(x) + 1.0)
