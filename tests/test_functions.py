import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import covariance as C
from gridloom.functions import scores as S
from gridloom.models import kernels as K
from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.operators import lattice as L
from gridloom.sources.tables import Config


def test_scores_against_known_rows(spark):
    data = [(0.0, 1.0, 0.0), (0.0, 1.0, 3.0), (50.0, 2.0, 47.0), (0.0, 1.0, None), (1.0, 0.0, 1.0)]
    m, s, y = F.col("m"), F.col("s"), F.col("y")
    df = spark.createDataFrame(data, "m double, s double, y double")
    got = df.select(S.crps(m, s, y), S.interval_score(m, s, y), S.covered(m, s, y), S.ignorance(m, s, y), S.pit(m, s, y)).collect()
    assert np.allclose(got[0], (0.2336949773, 3.9199279691, 1, 0, 0.5))
    assert np.allclose(got[1], (2.4365747251, 45.5213685875, 0, 4.5, 0.9986501020))
    assert np.allclose(got[2], (1.9888480080, 7.8398559382, 1, 1.8181471806, 0.0668072013))
    assert all(x is None for x in got[3]) and got[4][0] is None


def test_normal_cdf_against_erf(spark):
    z = [i / 10 for i in range(-90, 91)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(S.normal_cdf(F.col("z"))).collect()]
    assert max(abs(a - 0.5 * math.erfc(-x / math.sqrt(2))) for a, x in zip(got, z)) < 1e-14


def test_columns_and_kernels_agree(spark):
    d = np.linspace(0, 5, 21)
    df = spark.createDataFrame([(float(x),) for x in d], "d double")
    c = F.col("d")
    for model in (C.Exponential(2.0, 1.5), C.Matern(1.0, 2.0, 1.5), C.Matern(1.0, 2.0, 2.5)):
        assert np.allclose([r[0] for r in df.select(model.col(c)).collect()], model.np(d))
    assert np.allclose([r[0] for r in df.select(C.wendland(c, 3.0)).collect()], C.wendland_np(d, 3.0))


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (60, 2)))]
    df = spark.createDataFrame(at, "id long, x double, y double")
    got = {(r.i, r.rank): r.j for r in J.ordered_neighbours(df, 4, 2.0, 64.0).collect()}
    want = {}
    for i, x, y in at:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in at if j < i)[:4]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(near)}
    assert got == want


def test_exact_split_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "cell_id")
    sizes = sorted(r["count"] for r in L.exact_split(df, 10, 1).groupBy("part").count().collect())
    assert sizes == [100] * 9 + [103]


def test_config_first_occurrence_wins():
    c = Config.parse("# comment\na 1 x\na 2\nflag T\nspan 2:4\nv 1,2.5 # note")
    assert c.integer("a") == 1 and c.flag("flag") and c.span("span") == [2, 3, 4] and c.numbers("v") == [1, 2.5]


def test_places_are_exact_and_repeat(spark):
    df = spark.range(5003).select((F.col("id") * 7 - 900).alias("cell_id"))
    assert sorted(r.place for r in L.random_places(df, 1).collect()) == list(range(5003))
    assert {r.cell_id: r.place for r in L.random_places(df, 1).collect()} == {r.cell_id: r.place for r in L.random_places(df.repartition(7), 1).collect()}
    ordered = [(r.cell_id, r.place, r.total) for r in L.ordered_places(df).collect()]
    assert sorted(ordered) == [(7 * i - 900, i, 5003) for i in range(5003)]
    assert L.ordered_places(df.limit(0)).count() == 0


def test_holdout_and_splits_are_disjoint_and_repeat(spark):
    df = spark.range(1000).select(F.col("id").alias("cell_id"), F.col("id").cast("double").alias("truth"))
    held = [{r.cell_id for r in L.holdout(d, 0.29, 3).where("val is null").collect()} for d in (df, df.repartition(5), df)]
    assert len(held[0]) == 290 and held[0] == held[1] == held[2] and held[0] != set(range(290))
    parts = [(r.cell_id, r.part) for r in L.exact_split(df, 30, 1).collect()]
    assert len({i for i, _ in parts}) == 1000 and sorted(parts) == sorted((r.cell_id, r.part) for r in L.exact_split(df.repartition(3), 30, 1).collect())


def test_reverse_lists_and_cross_distances(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 26)] + [(3, 2), (4, 2)], "i long, j long")
    rows = {(r.j, r.part): r.users for r in J.reverse_lists(edges, 10).collect()}
    assert rows[0, 0] == list(range(1, 11)) and rows[0, 2] == list(range(21, 26)) and rows[2, 0] == [3, 4] and len(rows) == 4
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, x double, y double")
    assert {(r.i, r.j): r.d for r in J.cross_distances(at, [(7, 0.0, 0.0), (8, 3.0, 0.0)]).collect()} == {(1, 7): 0.0, (1, 8): 3.0, (2, 7): 5.0, (2, 8): 4.0}


def test_variogram_by_tiles_is_that_of_one_array(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(23, 17))
    v[rng.random(v.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(x, y + 1, None if np.isnan(v[x, y]) else float(v[x, y])) for x in range(23) for y in range(17)], "ix int, iy int, v double")
    lags = [(0, 1), (2, 3), (4, -2), (5, 0)]
    got = {(r.lx, r.ly): (r.pairs, r.gamma) for r in A.variogram(df, lags, "v", side=5).collect()}
    for a, b in lags:
        here = v[: 23 - a, max(0, -b) : 17 - max(0, b)]
        miss = here - v[a:, max(0, b) : 17 + min(0, b)]
        assert got[a, b][0] == np.isfinite(miss).sum() and math.isclose(got[a, b][1], np.nanmean(miss * miss))


def test_covariance_helpers():
    assert math.isclose(math.exp(-C.decay_for(10.0) * 10.0), 0.05)
    kappa, tau = C.spde_constants(8.0, 3.0)
    assert math.isclose(kappa, math.sqrt(8) / 8) and math.isclose(1 / (4 * math.pi * kappa**2 * tau**2), 3.0)
    assert C.tree_size(1000, 50, 2) == (20, 5)


def test_normal_quantile_inverts_the_distribution(spark):
    p = [1e-9, 1e-4, 0.01, 0.024, 0.3, 0.5, 0.7, 0.975, 0.9999, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(S.normal_quantile(F.col("p"))).collect()]
    assert max(abs(0.5 * math.erfc(-z / math.sqrt(2)) - x) / min(x, 1 - x) for z, x in zip(got, p)) < 1e-6
    assert abs(got[7] - S.Q975) < 1e-12 and spark.range(1).select(S.normal_quantile(F.lit(1.5))).first()[0] is None
