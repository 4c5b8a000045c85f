"""Fixed-rank kriging: its basis follows the data, its likelihood rises, its parts against dense algebra; factors with 15 neighbours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.models import basis, neighbours
from gridloom.models import kernels as K
from gridloom.operators import joins as J
from test_models import SCHEMA, cells, parts


def test_quadtree_follows_the_observations(spark):
    rows = [r for r in cells(32, 32, hole=0) if r[1] < 16 or r[2] % 11 == 0]
    tree = basis.quadtree(spark.createDataFrame(rows, SCHEMA), 32, 32, depth=4, split=8)
    seen = np.array([r[1:3] for r in rows if r[4] is not None], float)
    assert len(tree) == 4
    for boxes in tree:
        for x, y, w, h in boxes:
            inside = (np.abs(seen[:, 0] + 1e-9 - x) <= w / 2) & (np.abs(seen[:, 1] + 1e-9 - y) <= h / 2)
            assert inside.sum() >= 3
    assert all(x < 16 for x, *_ in tree[-1]) and any(x > 16 for x, *_ in tree[0])
    assert basis.quadtree(spark.createDataFrame([], SCHEMA), 32, 32) == []


def test_likelihood_rises_and_is_the_dense_one(spark):
    df = spark.createDataFrame(cells(24, 16), SCHEMA).cache()
    xy, y, to, ids = parts(df)
    tree = basis.quadtree(df, 24, 16, 3)
    b = basis.bisquares(24, 16, tree)
    group = np.repeat(np.arange(len(tree) + 1), [3, *map(len, tree)])
    fit = basis.expectation_maximisation(basis.gram_sums(df, b, len(group))[0], group, 0.05, tolerance=1e-6)
    assert len(fit.loglik) > 3 and all(d > -1e-6 for d in np.diff(fit.loglik))
    x = b(xy)
    prior = fit.prior
    c = x @ np.diag(prior[group]) @ x.T + fit.left * np.eye(len(y))
    assert fit.loglik[-1] == pytest.approx(-0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + y @ np.linalg.solve(c, y)), rel=1e-3)
    got = {r.cell_id: r for r in basis.fixed_rank(df, 24, 16, 3).collect()}
    assert sorted(got) == sorted(ids) and all(0 <= r.process_sd <= r.sd for r in got.values())


def test_measurement_variance(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 40, i // 40 + 1, 0.0, float(0.01 * (i % 40) + rng.normal(0, 1.5))) for i in range(1600)]
    assert basis.measurement_variance(spark.createDataFrame(rows, SCHEMA)) == pytest.approx(2.25, rel=0.15)
    assert basis.measurement_variance(spark.createDataFrame(rows[:1], SCHEMA)) == 0.0


def test_factors_with_fifteen_neighbours(spark):
    """Each row of B and F against the dense small system; with all earlier cells the sums are the dense form and determinant."""
    rows = [r for r in cells(8, 6) if r[4] is not None]
    at = spark.createDataFrame([(k, *r[1:3], r[4]) for k, r in enumerate(rows)], "id long, x int, y int, val double")
    variance, range_, share = 7.0, 3.0, 0.1
    xy, y = np.array([r[1:3] for r in rows], float), np.array([r[4] for r in rows])
    c = variance * ((1 - share) * np.exp(-K.distances(xy, xy) / range_) + share * np.eye(len(xy)))
    for m in (15, 100):
        edges = J.ordered_neighbours(at, m, 3.0, 32.0)
        near = {r.i: r.js for r in edges.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "j"))), lambda x: x["j"]).alias("js")).collect()}
        got = {r.cell_id: r for r in neighbours.factor_table(neighbours.lists_of(edges, at), m, variance, range_, share).collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            js = near.get(i, [])
            assert len(js) == min(i, m)
            b = np.linalg.solve(c[np.ix_(js, js)], c[js, i]) if js else np.zeros(0)
            assert np.allclose(r.b, b, atol=1e-6) and r.f == pytest.approx(c[i, i] - b @ c[js, i], abs=1e-6) and r.u == pytest.approx(y[i] - b @ y[js], abs=1e-6)
    assert sum(r.u**2 / r.f for r in got.values()) == pytest.approx(y @ np.linalg.solve(c, y), rel=1e-6)
    assert sum(math.log(r.f) for r in got.values()) == pytest.approx(np.linalg.slogdet(c)[1], rel=1e-6)
