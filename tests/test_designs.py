"""Designs against exhaustive greedy choice."""

import numpy as np

from gridloom.models import kernels as K
from gridloom.models.designs import d_optimal, greedy_places, local_design


def matrix(p, q, range_, share):
    d = K.distances(p, q)
    return (1 - share) * np.exp(-d / range_) + share * (d < 1e-6)


def test_design_of_tiles_is_nearly_the_greedy_one(spark):
    rng = np.random.default_rng(3)
    places = [(i, j) for i in range(45) for j in range(1, 31) if rng.random() < 0.7]
    df = spark.createDataFrame([(k, *p, float(k)) for k, p in enumerate(places)], "cell_id long, ix int, iy int, val double")
    xy = np.array(places, float)
    _, best = greedy_places(xy, 40, 9.0, 0.05)
    for side in (10, 100):
        rows = d_optimal(df, 40, 9.0, 0.05, side, 2).collect()
        got = np.array([(r.ix, r.iy) for r in rows], float)
        logdet = np.linalg.slogdet(matrix(got, got, 9.0, 0.05))[1]
        assert len(rows) == len({r.cell_id for r in rows}) == 40 and logdet > best - 0.01 * abs(best)
    chosen, logdet = greedy_places(xy, 12, 9.0, 0.05)
    assert abs(logdet - np.linalg.slogdet(matrix(xy[chosen], xy[chosen], 9.0, 0.05))[1]) < 1e-8
    assert d_optimal(df.limit(3), 40, 9.0).count() == 3


def test_local_design_is_the_greedy_one():
    """Each further neighbour is the one whose value lowers the variance most."""
    rng = np.random.default_rng(4)
    near = np.zeros((6, 14, 4))
    at = rng.uniform(0, 8, (6, 2))
    for r in range(6):
        p = rng.permutation([(i, j) for i in range(8) for j in range(8)])[:14].astype(float)
        near[r, :, :2] = p[np.argsort(((p - at[r]) ** 2).sum(axis=1))]
    got = local_design(near, at, 7, 2, 5.0, 0.1)
    for r in range(6):
        p = near[r, :, :2]
        used = [0, 1]
        c = 0.9 * np.exp(-np.sqrt(((p - at[r]) ** 2).sum(axis=1)) / 5.0)
        gain = lambda s: c[s] @ np.linalg.solve(matrix(p[s], p[s], 5.0, 0.1), c[s])
        while len(used) < 7:
            used.append(max((j for j in range(14) if j not in used), key=lambda j: gain([*used, j])))
        assert got[r].tolist() == used
