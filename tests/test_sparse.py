"""The sparse solver, tapered kriging on it, fields on a torus, and the Markov field's blocks, against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.covariance import wendland_np
from gridloom.models import kernels as K
from gridloom.models import solver, taper, torus
from gridloom.models.fields import Fit, summed
from test_models import FIT, cells

SCHEMA = "cell_id long, ix int, iy int, truth double, val double"


def within(reach):
    def entries(p, q):  # made here, so that it travels to the workers by value
        d = K.distances(p, q)
        return np.exp(-d / 3.0) * wendland_np(d, reach) + 0.1 * (d < 0.5)

    return entries


entries = within(4.0)


@pytest.mark.parametrize("side", [4, 9, 50])
def test_solver_equals_dense(spark, side):
    """In tiles narrower than the halo, in some, and in one; some places are missing."""
    rng = np.random.default_rng(side)
    at = [(i, j) for i in range(-3, 16) for j in range(11) if rng.random() < 0.7]
    b = rng.normal(size=(len(at), 3))
    rows = spark.createDataFrame([(i, *map(int, p), v.tolist()) for i, (p, v) in enumerate(zip(at, b))], "id long, ix int, iy int, b array<double>")
    found = solver.solve(rows, 3, entries, solver.Tiles(side, 4, 2), 1e-8).orderBy("id").collect()
    places = np.array(at, float)
    exact = np.linalg.solve(entries(places, places), b)
    assert np.abs(np.array([np.frombuffer(r.x) for r in found]) - exact).max() < 1e-6
    to = spark.createDataFrame([(0, 2, 40), (1, 3, 3)], "id long, ix int, iy int")
    got = {r.id: r.v and np.frombuffer(r.v) for r in solver.apply_rows(solver.solve(rows, 3, entries, solver.Tiles(side, 4, 2), 1e-8), to, entries, solver.Tiles(side, 4, 2)).collect()}
    assert got.get(0) is None or np.abs(got[0]).max() == 0
    assert np.allclose(got[1], (entries(np.array([[3.0, 3.0]]), places) @ exact)[0], atol=1e-6)
    assert solver.solve(rows.where("id < 0"), 3, entries, solver.Tiles(side, 4, 2)).count() == 0


def test_solver_says_when_it_fails(spark):
    rows = spark.createDataFrame([(i, i, 0, [1.0]) for i in range(40)], "id long, ix int, iy int, b array<double>")
    long = lambda p, q: np.exp(-K.distances(p, q) / 30.0)  # noqa: E731  reaches beyond the halo
    with pytest.raises(ArithmeticError):
        solver.solve(rows, 1, long, solver.Tiles(2, 1, 1), 1e-12, most=3)


@pytest.mark.parametrize("side", [7, 100])
def test_tapered_kriging_is_one_system(spark, side):
    """Equal to dense tapered kriging, with tiles whose borders the taper crosses."""
    delta, draws = 6.0, 400
    rows = cells(22, 15)
    got = {r.cell_id: r for r in taper.tapered_kriging(spark.createDataFrame(rows, SCHEMA), 22, 15, FIT, delta, "linear", draws, side, tolerance=1e-8).collect()}
    seen, gone = [r for r in rows if r[4] is not None], [r for r in rows if r[4] is None]
    assert sorted(got) == sorted(r[0] for r in gone)
    at = lambda x: np.array([r[1:3] for r in x], float)
    rest = np.array([r[4] for r in seen]) - K.design(at(seen), "linear", 22, 15) @ FIT.beta
    mean, var = K.krige(at(seen), rest, at(gone), FIT.variance, FIT.range, FIT.share, delta)
    mean = mean + K.design(at(gone), "linear", 22, 15) @ FIT.beta
    assert np.abs(np.array([got[r[0]].mean for r in gone]) - mean).max() < 1e-5
    ratio = np.array([got[r[0]].sd for r in gone]) / np.sqrt(var)
    assert abs(ratio.mean() - 1) < 0.02 and np.abs(ratio - 1).max() < 0.2


def test_tapered_kriging_without_observations(spark):
    rows = [(*r[:4], None) for r in cells(6, 5)]
    got = taper.tapered_kriging(spark.createDataFrame(rows, SCHEMA), 6, 5, Fit(np.array([1.0, 0.0, 0.0]), 4.0, 2.0, 0.1), 3.0, "linear", 200).collect()
    assert len(got) == 30 and all(r.mean == pytest.approx(1.0) and 1.3 < r.sd < 2.7 for r in got)


@pytest.mark.parametrize("reach", [5.0, None])
def test_fields_on_a_torus(spark, monkeypatch, reach):
    """Variance and covariance of draws, with the torus in one block and in many."""
    monkeypatch.setattr(torus, "BLOCK", 200 if reach else 1 << 19)
    cov = (lambda d: 3.0 * np.exp(-d / 2.0) * wendland_np(d, 5.0)) if reach else (lambda d: 3.0 * np.exp(-d / 2.0))
    n = 600
    rows = torus.draw_fields(spark, 9, 7, n, cov, 4, reach, 0.5).collect()
    v = {(r.ix, r.iy): np.array(r.v) for r in rows}
    assert len(rows) == len(v) == 63 and all(len(x) == n for x in v.values())
    for lag in ((0, 0), (1, 0), (0, 1), (2, 1), (4, 3)):
        got = np.mean([(v[p] * v[p[0] + lag[0], p[1] + lag[1]]).mean() for p in v if (p[0] + lag[0], p[1] + lag[1]) in v])
        assert got == pytest.approx(cov(np.array([np.hypot(*lag)]))[0] + 0.5 * (lag == (0, 0)), abs=0.2)
    again = torus.draw_fields(spark, 9, 7, n, cov, 4, reach, 0.5).where("ix = 3 and iy = 2").first()
    assert again.v == v[3, 2].tolist()


def test_sums_of_vectors(spark):
    """Over more tasks than are added up at a time."""
    rows = spark.range(500).repartition(40).select((F.col("id") % 3).cast("int").alias("g"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    found = summed(rows, 4)
    assert {g: v.tolist() for g, v in found.items()} == {g: [float(len(range(g, 500, 3))), float(sum(range(g, 500, 3)))] for g in range(3)}
    assert summed(rows.where("g > 5")) == {}


@pytest.mark.parametrize("nx, ny", [(1, 4), (2, 3), (5, 4), (6, 7)])
def test_markov_blocks(nx, ny):
    """Determinants, solutions and the inverse's diagonal are those of the dense matrix."""
    n, kappa, scale = nx * ny, 0.7, 1.9
    k = np.diag(np.full(n, kappa**2))
    for i in range(n):
        for j in range(n):
            if abs(i // ny - j // ny) + abs(i % ny - j % ny) == 1:
                k[i, j] -= 1
                k[i, i] += 1
    rng = np.random.default_rng(n)
    diagonal, b = (rng.random(n) < 0.6).astype(float), rng.normal(size=n)
    blocks, dense = K.MarkovBlocks(nx, ny, kappa, scale, diagonal), scale * k @ k + np.diag(diagonal)
    assert blocks.logdet == pytest.approx(np.linalg.slogdet(dense)[1])
    assert blocks.prior_logdet() == pytest.approx(np.linalg.slogdet(scale * k @ k)[1])
    assert np.allclose(blocks.solve(b), np.linalg.solve(dense, b)) and np.allclose(blocks.inverse_diagonal(), np.diag(np.linalg.inv(dense)))
