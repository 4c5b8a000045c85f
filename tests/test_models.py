"""The models against dense kriging in NumPy, and their error and coverage on masked cells."""

import math

import numpy as np
import pytest

from gridloom.models import basis, clusters, fields, multires, neighbours
from gridloom.models import kernels as K
from gridloom.models.fields import Fit
from gridloom.operators import joins as J
from gridloom.plans.model_queries import MODELS

NX, NY = 40, 24


def cells(nx, ny, seed=3, hole=5):
    rng = np.random.default_rng(seed)
    rows = []
    for ix in range(nx):
        for iy in range(1, ny + 1):
            truth = 6 * math.sin(ix / 6) + 4 * math.cos(iy / 5) + 0.1 * ix + 30 + 0.4 * rng.standard_normal()
            masked = rng.random() < 0.2 or (abs(ix - nx // 2) < hole / 2 and abs(iy - ny // 2) < hole / 2)
            rows.append(((iy - 1) * nx + ix, ix, iy, float(truth), None if masked else float(truth)))
    return rows


SCHEMA = "cell_id long, ix int, iy int, truth double, val double"


@pytest.fixture(scope="module")
def field(spark):
    return spark.createDataFrame(cells(NX, NY), SCHEMA).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(cells(12, 10), SCHEMA).cache()


FIT = Fit(np.array([30.0, 0.1, -0.05]), 9.0, 5.0, 0.1)


def parts(df):
    rows = df.collect()
    seen, gone = [r for r in rows if r.val is not None], [r for r in rows if r.val is None]
    at = lambda x: np.array([(r.ix, r.iy) for r in x], float)
    return at(seen), np.array([r.val for r in seen]), at(gone), [r.cell_id for r in gone]


def got(df, ids):
    found = {r.cell_id: (r.mean, r.sd) for r in df.collect()}
    assert sorted(found) == sorted(ids)
    return np.array([found[i] for i in ids]).T


def dense(df, cov, fit=FIT, noise=True):
    """Kriging with every observed cell; cov(p, q) is the signal's covariance."""
    xy, y, to, ids = parts(df)
    c = cov(xy, xy) + fit.variance * fit.share * np.eye(len(xy))
    rest = y - K.design(xy) @ fit.beta
    k = cov(to, xy)
    mean = K.design(to) @ fit.beta + k @ np.linalg.solve(c, rest)
    var = np.array([cov(t[None], t[None])[0, 0] for t in to]) + fit.variance * fit.share - np.einsum("ij,ji->i", k, np.linalg.solve(c, k.T))
    return ids, mean, np.sqrt(var)


def exponential(p, q, fit=FIT):
    return fit.variance * (1 - fit.share) * np.exp(-np.linalg.norm(p[:, None] - q[None], axis=2) / fit.range)


def test_one_tile_is_dense_kriging(spark, small):
    ids, mean, sd = dense(small, exponential)
    for kernel in (fields._kriging(FIT, 1, 1, "linear"), fields._kriging(FIT, 1, 1, "linear", 1e7)):
        m, s = got(fields.predict_tiles(small, 12, 10, 1000, 0.0, kernel), ids)
        assert np.allclose(m, mean, atol=1e-5) and np.allclose(s, sd, atol=1e-5)
    # Tiles with a halo as wide as the lattice see all cells.
    m, s = got(fields.predict_tiles(small, 12, 10, 30, 30.0, fields._kriging(FIT, 1, 1, "linear")), ids)
    assert np.allclose(m, mean, atol=1e-5) and np.allclose(s, sd, atol=1e-5)


def test_sums_of_likelihoods_are_dense_ones(spark, small):
    xy, y, _, _ = parts(small)
    grid = [(3.0, 0.1), (8.0, 0.3)]
    seen = fields.fits(small, 12, 10, grid, per_tile=1000)
    for f in seen:
        r = (1 - f.share) * np.exp(-np.linalg.norm(xy[:, None] - xy[None], axis=2) / f.range) + f.share * np.eye(len(xy))
        x = K.design(xy, "linear", 12, 10)
        beta = np.linalg.solve(x.T @ np.linalg.solve(r, x), x.T @ np.linalg.solve(r, y))
        rest = y - x @ beta
        variance = rest @ np.linalg.solve(r, rest) / len(y)
        assert np.allclose(f.beta, beta, atol=1e-5) and math.isclose(f.variance, variance, rel_tol=1e-6)
        assert math.isclose(f.loglik, -0.5 * (len(y) * math.log(variance) + np.linalg.slogdet(r)[1] + len(y)), rel_tol=1e-6)


def test_all_neighbours_give_dense_factors_and_kriging(spark, small):
    xy, y, to, ids = parts(small)
    n, grid = len(xy), [(5.0, 0.1), (3.0, 0.3)]
    for (range_, share), s in zip(grid, neighbours.factor_sums(neighbours.with_ordered_neighbours(small, n - 1, 32.0), grid, n)):
        r = (1 - share) * np.exp(-np.linalg.norm(xy[:, None] - xy[None], axis=2) / range_) + share * np.eye(n)
        x = K.design(xy)
        want = np.concatenate([(x.T @ np.linalg.solve(r, x)).ravel(), x.T @ np.linalg.solve(r, y), [y @ np.linalg.solve(r, y), np.linalg.slogdet(r)[1], n]])
        assert np.allclose(s, want, rtol=1e-6)
    _, mean, sd = dense(small, exponential)
    lists = neighbours.with_neighbours(small.select("cell_id", "ix", "iy", "val"), n, 32.0)
    m, s = got(neighbours._local(lists, neighbours._mixture([(FIT, 1.0)])), ids)
    assert np.allclose(m, mean, atol=1e-5) and np.allclose(s, sd, atol=1e-4)


def test_multiresolution_against_its_own_covariance(spark, small):
    """The approximation's covariance written out: what the root's knots carry, and the rest within a leaf."""
    ids, mean, sd = dense(small, exponential)
    m, s = got(multires.multiresolution(small, 12, 10, fit=FIT, levels=0), ids)
    assert np.allclose(m, mean, atol=1e-5) and np.allclose(s, sd, atol=1e-5)
    knots = multires._knots((0.0, 12.0, 1.0, 11.0), 3)
    k = np.linalg.inv(exponential(knots, knots) + 1e-6 * FIT.variance * np.eye(9))
    half = lambda p: p[:, 0] >= 6.0

    def cov(p, q):
        carried = exponential(p, knots) @ k @ exponential(knots, q)
        return carried + (half(p)[:, None] == half(q)[None]) * (exponential(p, q) - carried)

    ids, mean, sd = dense(small, cov)
    m, s = got(multires.multiresolution(small, 12, 10, side=3, fit=FIT, levels=1), ids)
    assert np.allclose(m, mean, atol=1e-5) and np.allclose(s, sd, atol=1e-5)
    leaf, path = (lambda p: (p[:, 0] >= 6.0) * 2 + (p[:, 1] >= 6.0)), [knots]
    halves = [multires._knots((a, a + 6.0, 1.0, 11.0), 3) for a in (0.0, 6.0)]

    def cov2(p, q):
        out = exponential(p, knots) @ k @ exponential(knots, q)
        rest = lambda u, v: exponential(u, v) - exponential(u, knots) @ k @ exponential(knots, v)
        for i, h in enumerate(halves):
            inner = np.linalg.inv(rest(h, h) + 1e-6 * FIT.variance * np.eye(9))
            both = (half(p) == i)[:, None] & (half(q) == i)[None]
            out = out + both * (rest(p, h) @ inner @ rest(h, q))
            same = both & (leaf(p)[:, None] == leaf(q)[None])
            out = out + same * (rest(p, q) - rest(p, h) @ inner @ rest(h, q))
        return out

    ids, mean, sd = dense(small, cov2)
    m, s = got(multires.multiresolution(small, 12, 10, side=3, fit=FIT, levels=2), ids)
    assert np.allclose(m, mean, atol=1e-4) and np.allclose(s, sd, atol=1e-4)


def test_gram_sums_and_smoothing_are_dense_ones(spark, small):
    xy, y, to, ids = parts(small)
    make, precision = basis.lattice_basis(12, 10, 3, 2)
    sums = basis.gram_sums(small, make, len(precision), 3)
    b = make(xy)
    assert np.allclose(sum(sums)[: len(precision), : len(precision)], b.T @ b) and np.allclose(sum(sums)[: len(precision), -1], b.T @ y) and sum(s[-1, 0] for s in sums) == len(y)
    mean, inverse, noise, ll = basis._smooth(sum(sums), precision, 0.1)
    a = b.T @ b + 0.1 * precision + 1e-9 * np.eye(len(precision))
    assert np.allclose(mean, np.linalg.solve(a, b.T @ y))
    m, s = got(basis.predict_basis(small, make, mean, inverse * noise, noise), ids)
    bt = make(to)
    assert np.allclose(m, bt @ mean) and np.allclose(s, np.sqrt(noise * (1 + np.einsum("ij,ji->i", bt, np.linalg.solve(a, bt.T)))))


def test_lattice_covariance_is_that_of_the_coefficients(spark, small):
    make, precision = basis.lattice_basis(12, 10, 3, 2)
    places = [(5.0, 5.0), (11.0, 1.0)]
    found = {(r.cell_id, r.place): r.cov for r in basis.lattice_covariance(small, 12, 10, places, 3, 2).collect()}
    inverse = np.linalg.inv(precision[3:, 3:])
    for r in small.limit(20).collect():
        want = make(np.array([(r.ix, r.iy)], float))[:, 3:] @ inverse @ make(np.array(places))[:, 3:].T
        assert np.allclose([found[r.cell_id, k] for k in (0, 1)], want[0])
    assert len(found) == 240


def test_bounded_search_zooms_in_on_the_top():
    bump = lambda grid: [Fit(np.zeros(0), 1.0, r, s, -((math.log(r / 5.3)) ** 2) - (math.log(s / 0.07)) ** 2) for r, s in grid]
    coarse, fine = (fields.maximise(bump, fields.GRID, z) for z in (0, 4))
    assert fine.loglik > coarse.loglik and abs(fine.range - 5.3) < 0.6 and abs(fine.share - 0.07) < 0.01
    assert fields.maximise(lambda g: [Fit(np.zeros(0), 1.0, r, s, r) for r, s in g], fields.GRID, 3).range == 32.0


def test_cross_validation_prefers_what_fits(spark, small):
    rows = basis.lattice_krig_cv(small, 12, 10, coarse=(3,), folds=4).collect()
    xy, y, _, _ = parts(small)
    assert len(rows) == len(basis.LAMBDAS) and 0 < min(r.cv_mse for r in rows) < y.var() / 4
    good, wild = Fit(np.array([30.0, 0.1, 0.0]), 9.0, 8.0, 0.02), Fit(np.array([0.0, 0.0, 0.0]), 9.0, 0.2, 0.9)
    (a, b), (c, d) = neighbours.cross_validated(small.select("cell_id", "ix", "iy", "val"), 12, 10, [good, wild], 8, folds=3)
    assert a < c and b < d


@pytest.mark.parametrize("name", sorted(MODELS))
def test_models_beat_the_nearest_value(spark, field, name):
    truth = {r.cell_id: r.truth for r in field.where("val is null").collect()}
    seen = field.where("val is not null")
    p = lambda d: d.selectExpr("cell_id as id", "ix as x", "iy as y")
    value = {r.cell_id: r.val for r in seen.collect()}
    near = {r.i: value[r.j] for r in J.nearest(p(field.where("val is null")), p(seen), 1, 4.0, 64.0).collect()}
    copied = math.sqrt(np.mean([(near[i] - t) ** 2 for i, t in truth.items()]))
    rows = MODELS[name](field, NX, NY).collect()
    assert sorted(r.cell_id for r in rows) == sorted(truth)
    miss = np.array([r.mean - truth[r.cell_id] for r in rows])
    inside = np.abs(miss) <= 1.96 * np.array([r.sd for r in rows])
    assert math.sqrt(np.mean(miss**2)) < copied and 0.85 <= inside.mean() <= 1.0


def test_simulated_fields_have_their_covariance():
    field = K.embed(40, 30, 4.0, 3.0, [1], 400)
    for d in (0, 1, 3, 8):
        assert abs((field[:, :30] * field[:, d : 30 + d]).mean() - 4 * math.exp(-d / 3)) < 0.25
    with pytest.raises(ValueError):
        K.embed(6, 6, 1.0, 500.0, [1], 1)


def test_t_quantile_and_posterior_median():
    assert abs(K.t_quantile(0.975, 24) - 2.063898561628021) < 1e-6 and abs(K.t_quantile(0.025, 5) + 2.570581835636314) < 1e-6
    rng = np.random.default_rng(1)
    draws = [rng.normal(0, 1, (80, 2)) for _ in range(5)] + [rng.normal(9, 1, (80, 2))]
    w = K.median_of_posteriors(draws)
    assert abs(w.sum() - 1) < 1e-9 and w[-1] < min(w[:-1])


@pytest.mark.parametrize("linkage", clusters.LINKAGES)
def test_clusters_follow_gradients(spark, linkage):
    """Three plateaus with steps between them, one of them L-shaped: clusters are the plateaus, for every linkage."""
    level = lambda ix, iy: 0 if ix < 3 or iy < 3 else 10 if ix < 6 else 25
    rows = [(iy * 9 + ix, ix, iy, level(ix, iy) + 0.001 * ((ix * 7 + iy * 3) % 5)) for ix in range(9) for iy in range(8)]
    df = spark.createDataFrame(rows, "cell_id long, ix int, iy int, truth double")
    found = {r.cell_id: r.cluster for r in clusters.agglomerate(df, 3, linkage=linkage).collect()}
    groups = {}
    for i, ix, iy, _ in rows:
        groups.setdefault(level(ix, iy), set()).add(found[i])
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3
