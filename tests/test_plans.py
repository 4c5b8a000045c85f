"""Where in a plan the work is done: clusters are found for the cells of a lattice, not for the line items below them."""

import pytest

from gridloom.plans import registry, spatial_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ward_step", "cluster_pair_linkage"])
def test_centres_are_not_measured_for_line_items(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(spatial_queries, "cut", lambda df, to=spatial_queries.cut: written.append(df) or to(df))
    result = registry.queries()[name](spark, SF)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in [*written, result]]
    filters = [line for plan in plans for line in plan.splitlines() if "Filter" in line and "l_shipdate" in line]
    assert not [line for line in filters if "array_min" in line]
    assert sum(plan.count("l_extendedprice") > 0 for plan in plans) == 1  # one plan reads the line items
