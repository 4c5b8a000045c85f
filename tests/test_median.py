"""The median of posteriors by random features against the exact kernel."""

import numpy as np
import pytest

from gridloom.models import kernels as K
from gridloom.models.median import geometric_median


def test_weights_of_eight_subsets(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(0, 0.6, (8, 3))
    middles[7] += 4  # a subset that is far off
    draws = [rng.normal(m, 1.0 + 0.1 * k, (150, 3)) for k, m in enumerate(middles)]
    rows = [(k, d.tolist()) for k, part in enumerate(draws) for d in part]
    got = {r.part: r.w for r in geometric_median(spark.createDataFrame(rows, "part int, theta array<double>").repartition(5), 3, features=4096).collect()}
    exact = K.median_of_posteriors(draws)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-3)
    assert np.abs(np.array([got[k] for k in range(8)]) - exact).max() < 0.015
    assert min(got, key=got.get) == 7 and np.argmin(exact) == 7


def test_one_subset_and_none(spark):
    rows = spark.createDataFrame([(4, [1.0, 2.0]), (4, [1.5, 2.0])], "part int, theta array<double>")
    assert [(r.part, round(r.w, 6)) for r in geometric_median(rows, 2).collect()] == [(4, 1.0)]
    assert geometric_median(rows.where("part = 0"), 2).count() == 0
