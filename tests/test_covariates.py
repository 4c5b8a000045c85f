"""Covariates and covariance families as arguments, and kriging by circulant embedding, against dense algebra."""

import numpy as np
import pytest

from gridloom.models import covariates, fields, neighbours, taper
from gridloom.models import kernels as K
from gridloom.models.fields import Fit
from test_models import FIT, SCHEMA, cells, parts


def test_formula():
    assert covariates.parse_formula(" val~ a + b+1 +a", ["val", "a", "b"]) == ("val", ["a", "b"])
    assert covariates.parse_formula("y ~ 1", ["y"]) == ("y", [])
    for wrong in ("val", "val ~", "val ~ a * b", "val ~ c", "u ~ a", "val ~ a; drop"):
        with pytest.raises(ValueError):
            covariates.parse_formula(wrong, ["val", "a", "b"])


def test_covariates_enter_the_mean(spark):
    """A model of nothing gives least squares; cells without a covariate are left out."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 10, i // 10 + 1, float(v), None if i == 7 else float(w)) for i, (v, w) in enumerate(rng.normal(size=(60, 2)))]
    rows = [(*r, None if r[0] % 4 == 0 else 3.0 + 2 * r[3] - (r[4] or 0.0) + 0.1 * float(rng.normal())) for r in rows]
    df = spark.createDataFrame(rows, "cell_id long, ix int, iy int, a double, b double, y double")
    nothing = lambda d, nx, ny: d.where("val is null").selectExpr("cell_id", "0.0D as mean", "1.0D as sd")
    got = {r.cell_id: r.mean for r in covariates.with_covariates(nothing, "y ~ a + b")(df, 10, 6).collect()}
    known = [r for r in rows if r[5] is not None and r[4] is not None]
    x = np.array([[1, r[3], r[4]] for r in known])
    beta = np.linalg.lstsq(x, np.array([r[5] for r in known]), rcond=None)[0]
    exact = {r[0]: beta @ [1, r[3], r[4]] for r in rows if r[5] is None and r[4] is not None}
    assert got.keys() == exact.keys() and all(got[i] == pytest.approx(exact[i]) for i in exact)


def test_covariates_with_a_model(spark):
    rows = [(*r[:3], r[3] + 5 * (r[0] % 7), None if r[4] is None else r[4] + 5 * (r[0] % 7), r[0] % 7) for r in cells(24, 18)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, week int").cache()
    truth = {r[0]: r[3] for r in rows}
    error = lambda out: np.sqrt(np.mean([(r.mean - truth[r.cell_id]) ** 2 for r in out.collect()]))
    plain, better = fields.partition_gp(df, 24, 18), covariates.with_covariates(fields.partition_gp, "val ~ week")(df, 24, 18)
    assert error(better) < 1.5 < error(plain)


@pytest.mark.parametrize("smoothness", [0.5, 1.5, 2.5])
def test_families(spark, smoothness):
    """The likelihood and the predictions of one tile are those of the dense model of that family."""
    df = spark.createDataFrame(cells(12, 10), SCHEMA)
    family = K.matern(smoothness)
    xy, y, to, ids = parts(df)
    found = fields.fits(df, 12, 10, [(3.0, 0.2)], "linear", None, 400, family)[0]
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    r = 0.8 * family(d, 3.0) + 0.2 * np.eye(len(xy))
    x = K.design(xy, "linear", 12, 10)
    beta = np.linalg.solve(x.T @ np.linalg.solve(r, x), x.T @ np.linalg.solve(r, y))
    assert np.allclose(found.beta, beta, atol=1e-5) and found.family is family
    rest = y - x @ beta
    assert found.variance == pytest.approx(rest @ np.linalg.solve(r, rest) / len(y))
    got = {r_.cell_id: r_.mean for r_ in fields.predict_tiles(df, 12, 10, 400, 0.0, fields._kriging(found, 12, 10, "linear")).collect()}
    c = 0.8 * family(np.sqrt(((to[:, None] - xy[None]) ** 2).sum(axis=2)), 3.0)
    assert np.allclose([got[i] for i in ids], K.design(to, "linear", 12, 10) @ beta + c @ np.linalg.solve(r, rest), atol=1e-6)


def test_neighbour_factors_of_a_family(spark):
    """With all earlier cells as neighbours the factors' likelihood is the dense one."""
    df = spark.createDataFrame(cells(6, 5), SCHEMA)
    family = K.matern(1.5)
    lists = neighbours.with_ordered_neighbours(df, 40, 20.0)
    logdet = neighbours.factor_sums(lists, [(2.0, 0.1)], 40, family)[0][13]
    xy = parts(df)[0]
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    assert logdet == pytest.approx(np.linalg.slogdet(0.9 * family(d, 2.0) + 0.1 * np.eye(len(xy)))[1], abs=1e-4)


def test_circulant_kriging(spark):
    """One tile: the mean is dense kriging's, and so is sd but for the draws."""
    rows = cells(14, 11)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.cell_id: r for r in taper.circulant_kriging(df, 14, 11, 500, 100, 0, fit=FIT).collect()}
    xy, y, to, ids = parts(df)
    mean, var = K.krige(xy, y - K.design(xy, "linear", 14, 11) @ FIT.beta, to, FIT.variance, FIT.range, FIT.share)
    assert np.allclose([got[i].mean for i in ids], K.design(to, "linear", 14, 11) @ FIT.beta + mean, atol=1e-6)
    ratio = np.array([got[i].sd for i in ids]) / np.sqrt(var)
    assert abs(ratio.mean() - 1) < 0.03 and np.abs(ratio - 1).max() < 0.2
    none = spark.createDataFrame([(*r[:4], None) for r in rows], SCHEMA)
    assert taper.circulant_kriging(none, 14, 11, 20, 7, 2, fit=Fit(np.array([1.0, 0, 0]), 4.0, 2.0, 0.1)).where("mean = 1").count() == len(rows)
