"""Queries that fit a model to the signal lattice and predict its masked cells; SQL cannot express them."""

from __future__ import annotations

from gridloom.models import basis, clusters, covariates, fields, forest, multires, neighbours, taper, torus
from gridloom.models import kernels as K
from gridloom.session import cut

from .base import NX, NY, signal

#: By name the models: each takes (cells, nx, ny) and returns cell_id, mean and sd of the missing ones.
MODELS = {
    "partition_gp": fields.partition_gp, "taper_krige": taper.tapered, "circulant_krige": taper.circulant_kriging, "cond_sim": fields.conditional_simulation, "gapfill": fields.gap_fill, "lattice_gmrf": fields.lattice_markov,
    "frk": basis.fixed_rank, "lowrank_gp": basis.predictive_process, "lattice_krig": basis.lattice_krig, "mra": multires.multiresolution, "nngp_conj": neighbours.nearest_neighbour_gp,
    "nngp_response": neighbours.nearest_neighbour_response, "meta_kriging": neighbours.meta_kriging, "local_gp": neighbours.local_gp,
}
#: The parameters of the simulated field (variance, range, nugget, mean).
FIELD = {"variance": 16.40771, "range_": 4 / 3, "nugget": 0.05, "mean": 44.49105}
QUERIES: dict = {}


def _model(model):
    return lambda spark, sf: model(cut(signal(spark, sf)), NX, NY)


for _name, _f in MODELS.items():
    QUERIES[_name] = (_model(_f), None)
QUERIES["grid_mle"] = (_model(fields.grid_likelihood), None)
QUERIES["nngp_cv"] = (_model(neighbours.cv_table), None)
QUERIES["lattice_krig_cv"] = (_model(basis.lattice_krig_cv), None)
QUERIES["lattice_cov"] = (_model(lambda df, nx, ny: basis.lattice_covariance(df, nx, ny, [(45.0, 25.0), (0.0, 1.0)])), None)
QUERIES["circulant_sim"] = (lambda spark, sf: torus.simulate(signal(spark, sf), 4, **FIELD), None)
#: The mean on the number of rows behind a cell and its place, what is left by the partition model with a Matern covariance.
QUERIES["covariate_gp"] = (lambda spark, sf: covariates.with_covariates(fields.partition_gp, "val ~ n + ix + iy")(cut(signal(spark, sf)), NX, NY, trend="none", family=K.matern(1.5)), None)
QUERIES["divisive_clusters"] = (lambda spark, sf: forest.divisive(signal(spark, sf), 8), None)
QUERIES["gradient_clusters"] = (lambda spark, sf: clusters.agglomerate(signal(spark, sf), 8), None)
