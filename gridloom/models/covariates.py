"""Models with covariates: a formula names the columns that enter the mean."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.session import cut


def parse_formula(formula: str, columns: list[str]) -> tuple[str, list[str]]:
    """The response and the covariates of "y ~ a + b", of which all are columns; "1" is the constant, which is always there."""
    found = re.fullmatch(r"\s*(\w+)\s*~\s*(\w+(?:\s*\+\s*\w+)*)\s*", formula)
    if not found:
        raise ValueError(f"not a formula: {formula}")
    terms = [t for t in dict.fromkeys(re.split(r"\s*\+\s*", found[2])) if t != "1"]
    if missing := [c for c in (found[1], *terms) if c not in columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return found[1], terms


def with_covariates(model: Callable[..., DataFrame], formula: str) -> Callable[..., DataFrame]:
    """The model (cells, nx, ny) -> (cell_id, mean, sd) of what least squares on the formula's covariates leaves.

    Coefficients come from one sum of products over the observed cells. Cells with a missing covariate help no fit and get
    no prediction. The spread of the coefficients is not part of sd. Covariates that depend on each other share their effect.
    """

    def fitted(df: DataFrame, nx: int, ny: int, **options) -> DataFrame:
        response, terms = parse_formula(formula, df.columns)
        names = ["x0", *(f"x{k + 1}" for k in range(len(terms)))]
        values = [F.lit(1.0), *(F.col(c).cast("double") for c in terms)]
        rows = df.select("cell_id", "ix", "iy", F.col(response).cast("double").alias("y"), *[v.alias(n) for v, n in zip(values, names)])
        rows = cut(rows.where(" and ".join(f"{n} is not null" for n in names)))
        known = rows.where("y is not null")
        sums = {(r["i"], r["j"]): r["v"] or 0.0 for r in A.gram(known, [*names, "y"]).collect()}  # a few numbers
        xx = np.array([[sums[tuple(sorted((a, b), key=names.index))] for b in names] for a in names])
        beta = np.linalg.pinv(xx, hermitian=True) @ np.array([sums[n, "y"] for n in names])
        fit: Column = sum((F.col(n) * F.lit(float(b)) for n, b in zip(names[1:], beta[1:])), F.lit(float(beta[0])))
        rest = cut(rows.select("cell_id", "ix", "iy", (F.col("y") - fit).alias("val"), fit.alias("fit")))
        out = model(rest.select("cell_id", "ix", "iy", "val"), nx, ny, **options)
        return out.select("cell_id", "mean", "sd").join(rest.select("cell_id", "fit"), "cell_id").select("cell_id", (F.col("mean") + F.col("fit")).alias("mean"), "sd")

    return fitted
