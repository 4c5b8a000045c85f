"""Queries that score, rank and stratify predictions, and summarise draws."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import scores as S_
from gridloom.operators import aggregates as A
from gridloom.operators import joins
from gridloom.session import cut
from gridloom.sources.tables import read_table

from .base import DIAMETER, G, METHODS, NX, QUANTILE, RUN, SCORE_COLUMNS, Y0, P, baselines, means, points, predictions, signal, stacked

QUERIES: dict = {}
_Z = "((truth - mean) / nullif(sd, 0))"
_CRPS = f"(sd * ({_Z} * ({S_.normal_cdf_sql(_Z)} * 2 - 1) + exp({_Z} * {_Z} * -0.5) / {math.sqrt(2 * math.pi)!r}::DOUBLE * 2 - {1 / math.sqrt(math.pi)!r}::DOUBLE))"
_H = f"(sd * {QUANTILE!r}::DOUBLE)"
_INT = f"({_H} * 2 + (greatest(0, mean - {_H} - truth) + greatest(0, truth - mean - {_H})) * 40)"
_COV = f"((truth >= mean - {_H} AND truth <= mean + {_H})::INT)"
_IGN = f"({_Z} * {_Z} / 2 + ln(nullif(sd, 0)))"
_TABLE = f"""t AS (SELECT method, count(*) AS n, avg(abs(mean - truth)) AS mae, sqrt(avg((mean - truth) * (mean - truth))) AS rmse, avg({_CRPS}) AS crps,
 avg({_INT}) AS intscore, avg({_COV}) AS coverage, avg(mean - truth) AS bias, avg({_IGN}) AS ign FROM p WHERE truth IS NOT NULL GROUP BY method)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _parts():
    return F.col("mean"), F.col("sd"), F.col("truth")


def r(c, digits=6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _single(name: str, column, expression: str, digits: int = 6):
    """A query with one score by method."""

    @query(name, f"WITH {P} SELECT method, round({expression}, {digits}) AS {name} FROM p GROUP BY method")
    def run(spark, sf):
        return predictions(spark, sf).groupBy("method").agg(F.round(column(*_parts()), digits).alias(name))

    return run


_single("mae", lambda m, s, y: F.avg(S_.absolute_error(m, s, y)), "avg(abs(mean - truth))")
_single("rmse", lambda m, s, y: F.sqrt(F.avg(S_.squared_error(m, s, y))), "sqrt(avg((mean - truth) * (mean - truth)))")
_single("crps", lambda m, s, y: F.avg(S_.crps(m, s, y)), f"avg({_CRPS})")
_single("interval_score", lambda m, s, y: F.avg(S_.interval_score(m, s, y)), f"avg({_INT})")
_single("coverage_inclusive", lambda m, s, y: F.avg(S_.covered(m, s, y)), f"avg({_COV})")
_single("coverage_strict", lambda m, s, y: F.avg(S_.covered(m, s, y, strict=True)), f"avg((truth > mean - {_H} AND truth < mean + {_H})::INT)")
_single("bias", lambda m, s, y: F.avg(m - y), "avg(mean - truth)")
_single("ignorance", lambda m, s, y: F.avg(S_.ignorance(m, s, y)), f"avg({_IGN})")


@query("pit", f"WITH {P} SELECT method, cell_id, round({S_.normal_cdf_sql(_Z)}, 8) AS pit FROM p")
def pit(spark, sf):
    m, s, y = _parts()
    return predictions(spark, sf).select("method", "cell_id", r(S_.pit(m, s, y), 8).alias("pit"))


@query("sd_from_interval", f"WITH {P} SELECT method, cell_id, round(((mean + 2 * sd) - (mean - 2 * sd)) / {2 * QUANTILE!r}::DOUBLE, 6) AS sd FROM p")
def sd_from_interval(spark, sf):
    m, s, y = _parts()
    return predictions(spark, sf).select("method", "cell_id", r(S_.sd_from_interval(m - s * 2, m + s * 2)).alias("sd"))


@query("interval_from_sd", f"WITH {P} SELECT method, cell_id, round(mean - sd * 1.96::DOUBLE, 6) AS low, round(mean + sd * 1.96::DOUBLE, 6) AS high FROM p")
def interval_from_sd(spark, sf):
    m, s, y = _parts()
    low, high = S_.interval_from_sd(m, s)
    return predictions(spark, sf).select("method", "cell_id", r(low).alias("low"), r(high).alias("high"))


@query("nugget_sd", f"WITH {P} SELECT method, cell_id, round(sqrt(sd * sd + 0.25::DOUBLE), 6) AS sd FROM p")
def nugget_sd(spark, sf):
    m, s, y = _parts()
    return predictions(spark, sf).select("method", "cell_id", r(S_.nugget_sd(s, 0.25)).alias("sd"))


@query("t_interval", f"WITH {P} SELECT method, cell_id, round(mean - sqrt(sd * sd * ((12.0::DOUBLE - 1) / 12.0::DOUBLE)) * 2.063898561628021::DOUBLE, 6) AS low, round(mean + sqrt(sd * sd * ((12.0::DOUBLE - 1) / 12.0::DOUBLE)) * 2.063898561628021::DOUBLE, 6) AS high FROM p")
def t_interval(spark, sf):
    m, s, y = _parts()
    low, high = S_.t_interval(m, s * s, 12.0, 2.063898561628021)
    return predictions(spark, sf).select("method", "cell_id", r(low).alias("low"), r(high).alias("high"))


@query("combine_stages_nugget", f"WITH {P} SELECT a.cell_id, round(greatest(a.sd * a.sd - a.mean, 0) + b.sd * b.sd, 6) AS var FROM p a JOIN p b USING (cell_id) WHERE a.method = 'colmean' AND b.method = 'idw'")
def combine_stages_nugget(spark, sf):
    """With a nugget that differs from cell to cell (here as large as the first mean)."""
    both = predictions(spark, sf).where("method in ('colmean', 'idw')").groupBy("cell_id").pivot("method", ["colmean", "idw"]).agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    both = both.where("colmean_mean is not null and idw_mean is not null")
    square = lambda c: F.col(c) * F.col(c)
    _, var = S_.combine_stages(F.col("colmean_mean"), square("colmean_sd"), F.col("idw_mean"), square("idw_sd"), F.col("colmean_mean"))
    return both.select("cell_id", r(var).alias("var"))


@query("combine_stages", f"WITH {P} SELECT a.cell_id, round(a.mean + (b.mean - a.mean) * 0.5::DOUBLE, 9) AS mean, round(a.sd * a.sd + b.sd * b.sd, 6) AS var FROM p a JOIN p b USING (cell_id) WHERE a.method = 'trend' AND b.method = 'idw'")
def combine_stages(spark, sf):
    m, s, y = _parts()
    p = predictions(spark, sf)
    one = p.where("method = 'trend'").select("cell_id", m.alias("m1"), s.alias("s1"))
    two = p.where("method = 'idw'").select("cell_id", m.alias("m2"), s.alias("s2"))
    mean, var = S_.combine_stages(F.col("m1"), F.col("s1") * F.col("s1"), (F.col("m2") - F.col("m1")) * 0.5, F.col("s2") * F.col("s2"))
    return one.join(two, "cell_id").select("cell_id", r(mean, 9).alias("mean"), r(var).alias("var"))


_WIDE = ", ".join(f"max(CASE WHEN method = '{m}' THEN mean END) AS {m}" for m in METHODS)


@query("wide_methods", f"WITH {P} SELECT cell_id, {_WIDE} FROM p GROUP BY cell_id")
def wide_methods(spark, sf):
    wide = predictions(spark, sf).groupBy("cell_id").pivot("method", METHODS).agg(F.first("mean"))
    return wide.select("cell_id", *METHODS)


@query("six_scores", f"WITH {P}, {_TABLE} SELECT method, n, round(rmse * rmse, 6) AS mse, round(mae, 6) AS mae, round(ign, 6) AS ign, round(crps, 6) AS crps, round(intscore, 6) AS intscore, round(coverage, 6) AS coverage FROM t")
def six_scores(spark, sf):
    t = A.score_table(predictions(spark, sf), ["method"])
    return t.select("method", "n", r(F.col("rmse") * F.col("rmse")).alias("mse"), *[r(c).alias(c) for c in ("mae", "ign", "crps", "intscore", "coverage")])


_OBSERVED = """po AS (SELECT 'global' AS method, cell_id, gm AS mean, gs AS sd, truth FROM seen, tot
  UNION ALL SELECT 'colmean', cell_id, mean, sd, truth FROM seen JOIN (SELECT ix, sum(round(val * 1000000)::BIGINT)::DOUBLE / (count(val) * 1000000) AS mean, stddev_samp(val) AS sd FROM seen GROUP BY ix) USING (ix)
  UNION ALL SELECT 'rowmean', cell_id, mean, sd, truth FROM seen JOIN (SELECT iy, sum(round(val * 1000000)::BIGINT)::DOUBLE / (count(val) * 1000000) AS mean, stddev_samp(val) AS sd FROM seen GROUP BY iy) USING (iy)
  UNION ALL SELECT 'trend', cell_id, round(b0 + b1*ix + b2*iy, 6), gs, truth FROM seen, ols, tot)"""


@query("six_scores_observed", f"WITH {P}, {_OBSERVED}, {_TABLE.replace('FROM p WHERE', 'FROM (SELECT method, cell_id, mean, round(sd, 6) AS sd, truth FROM po) WHERE')} SELECT method, n, round(rmse * rmse, 6) AS mse, round(mae, 6) AS mae, round(ign, 6) AS ign, round(crps, 6) AS crps, round(intscore, 6) AS intscore, round(coverage, 6) AS coverage FROM t")
def six_scores_observed(spark, sf):
    """The table over the observed cells, for the methods that say something there."""
    t = A.score_table(stacked(means(spark, sf), methods=("colmean", "global", "rowmean", "trend")), ["method"])
    return t.select("method", "n", r(F.col("rmse") * F.col("rmse")).alias("mse"), *[r(c).alias(c) for c in ("mae", "ign", "crps", "intscore", "coverage")])


_RANKS = f"""l AS (SELECT method, metric, value FROM (SELECT method, round(mae, 9) AS mae, round(rmse, 9) AS rmse, round(crps, 9) AS crps, round(intscore, 9) AS intscore, round(coverage, 9) AS coverage FROM t) UNPIVOT (value FOR metric IN (mae, rmse, crps, intscore, coverage))),
k AS (SELECT method, metric, value, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'coverage' THEN abs(value - 0.95::DOUBLE) ELSE value END, method)::INT AS rank FROM l)"""


def _ranks(spark, sf):
    t = A.score_table(predictions(spark, sf), ["method"])
    return A.rank_methods(t.select("method", *[r(c, 9).alias(c) for c in SCORE_COLUMNS]), SCORE_COLUMNS)


@query("rank_methods", f"WITH {P}, {_TABLE}, {_RANKS} SELECT method, metric, round(value, 6) AS value, rank FROM k")
def rank_methods(spark, sf):
    return _ranks(spark, sf).select("method", "metric", r("value").alias("value"), "rank")


@query("rank_table_order", f"WITH {P}, {_TABLE}, {_RANKS}, a AS (SELECT method, avg(rank) AS mean_rank FROM k GROUP BY method) SELECT method, round(mean_rank, 6) AS mean_rank, row_number() OVER (ORDER BY lower(substr(method, 1, 2)), mean_rank, method)::INT AS place FROM a")
def rank_table_order(spark, sf):
    means = _ranks(spark, sf).groupBy("method").agg(F.avg("rank").alias("mean_rank"))
    order = Window.orderBy(F.lower(F.substring("method", 1, 2)), "mean_rank", "method")  # a row for each method
    return means.select("method", r("mean_rank").alias("mean_rank"), F.row_number().over(order).alias("place"))


@query("melt_scores", f"WITH {P}, {_TABLE}, {_RANKS} SELECT method, metric, round(value, 6) AS value FROM k")
def melt_scores(spark, sf):
    t = A.score_table(predictions(spark, sf), ["method"])
    return t.unpivot(["method"], SCORE_COLUMNS, "metric", "value").select("method", "metric", r("value").alias("value"))


_BINS = """e AS (SELECT i AS cell_id, sqrt(min(d2)) AS d FROM pairs GROUP BY i), lim AS (SELECT min(d) AS lo, max(d) AS hi FROM e),
c AS (SELECT cell_id, d, greatest(1, least(5, ceil((d - lo) / ((hi - lo) / 5))))::INT AS bin FROM e, lim)"""


def _in_bins(df):
    """df with the bin of its column d: five of equal width over its range."""
    ends = df.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return df.join(F.broadcast(ends)).withColumn("bin", A.equal_width_bin(F.col("d"), F.col("lo"), F.col("hi"), 5)).drop("lo", "hi")


def _bins(spark, sf):
    s = cut(signal(spark, sf))
    near = joins.nearest(points(s.where("val is null")), points(s.where("val is not null")), 1, 2.0, DIAMETER)
    return _in_bins(cut(near.select(F.col("i").alias("cell_id"), F.sqrt("d2").alias("d")))).select("cell_id", "d", "bin")


@query("nearest_observation", f"WITH {P}, {_BINS} SELECT cell_id, round(d, 6) AS d FROM e")
def nearest_observation(spark, sf):
    return _bins(spark, sf).select("cell_id", r("d").alias("d"))


@query("cut_bins", f"WITH {P}, {_BINS} SELECT bin, count(*) AS cells FROM c GROUP BY bin")
def cut_bins(spark, sf):
    return _bins(spark, sf).groupBy("bin").agg(F.count("*").alias("cells"))


@query("scores_by_bin", f"WITH {P}, {_BINS} SELECT bin, method, round(sqrt(avg((mean - truth) * (mean - truth))), 6) AS rmse, round(avg({_CRPS}), 6) AS crps FROM p JOIN c USING (cell_id) GROUP BY bin, method")
def scores_by_bin(spark, sf):
    t = A.score_table(stacked(_in_bins(cut(baselines(spark, sf))), "bin"), ["bin", "method"])
    return t.select("bin", "method", r("rmse").alias("rmse"), r("crps").alias("crps"))


# The values that a cell's mean is made of serve as its draws: a draw for each line item, in order of its keys, in three subsets.
_DRAWS = f"""{G}, d AS (SELECT (iy - {Y0}) * {NX} + ix AS cell, subset, value, id, row_number() OVER (PARTITION BY ix, iy, subset ORDER BY id, value) - 1 AS draw
  FROM (SELECT CAST(FLOOR(datediff('day', DATE '1995-01-01', l_shipdate::DATE) / 28) AS INT) AS ix, CAST(l_quantity AS INT) AS iy, l_linenumber % 3 AS subset,
        sqrt(l_extendedprice) AS value, l_orderkey * 8 + l_linenumber AS id FROM lineitem))"""


def _draws(spark, sf):
    li = read_table(spark, sf, "lineitem")
    ix = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 28).cast("int")
    cell = (F.col("l_quantity").cast("int") - Y0) * NX + ix
    d = li.select(cell.alias("cell"), (F.col("l_linenumber") % 3).alias("subset"), F.sqrt("l_extendedprice").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return d.withColumn("draw", F.row_number().over(Window.partitionBy("cell", "subset").orderBy("id", "value")) - 1)


_QS = ", ".join(f"min(CASE WHEN cum >= {p!r}::DOUBLE - 1e-9 THEN value END) AS q{round(p * 1000)}" for p in (0.025, 0.5, 0.975))


@query(
    "weighted_quantile",
    f"""WITH {_DRAWS}, n AS (SELECT cell, subset, [0.5, 0.3, 0.2][subset + 1]::DOUBLE AS w, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT cell, sum(w) AS total FROM n GROUP BY cell),
    w AS (SELECT cell, value, sum(w / total / n) OVER (PARTITION BY cell ORDER BY value, id ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN n USING (cell, subset) JOIN t USING (cell)) SELECT cell, {_QS} FROM w GROUP BY cell""",
)
def weighted_quantile(spark, sf):
    """A subset's weight is shared by its draws; the weights of the subsets that a cell has sum to one."""
    d = _draws(spark, sf).withColumn("w", F.element_at(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), (F.col("subset") + 1).cast("int")))
    each = d.withColumn("n", F.count("*").over(Window.partitionBy("cell", "subset")))
    total = F.sum(F.col("w") / F.col("n")).over(Window.partitionBy("cell"))
    pooled = each.select("cell", "value", (F.col("w") / total / F.col("n")).alias("weight"), F.col("id").alias("draw"))
    return A.weighted_quantiles(pooled, "cell", [0.025, 0.5, 0.975])


@query("row_quantiles", f"WITH {_DRAWS} SELECT cell, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM d GROUP BY cell")
def row_quantiles(spark, sf):
    both = _draws(spark, sf).groupBy("cell").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return both.select("cell", r(F.col("q")[0]).alias("low"), r(F.col("q")[1]).alias("high"))


@query("row_sd", f"WITH {_DRAWS} SELECT cell, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS var FROM d GROUP BY cell")
def row_sd(spark, sf):
    return _draws(spark, sf).groupBy("cell").agg(r(F.stddev_samp("value")).alias("sd"), r(F.var_samp("value")).alias("var"))


@query("thin_draws", f"WITH {_DRAWS} SELECT subset, draw, count(*) AS cells, round(avg(value), 6) AS mean FROM d WHERE draw > 0 AND (draw - 1) % 2 = 0 GROUP BY subset, draw")
def thin_draws(spark, sf):
    """The first draw of each cell is dropped, then every second one stays."""
    kept = _draws(spark, sf).where("draw > 0 and (draw - 1) % 2 = 0")
    return kept.groupBy("subset", "draw").agg(F.count("*").alias("cells"), r(F.avg("value")).alias("mean"))


@query("logit_transform", f"WITH {P} SELECT method, cell_id, round(ln((mean - 0) / (100 - mean)), 6) AS x, round(100.0::DOUBLE - 100.0::DOUBLE / (exp(ln(mean / (100 - mean))) + 1), 6) AS back FROM p")
def logit_transform(spark, sf):
    m, s, y = _parts()
    x = S_.logit(m, 0.0, 100.0)
    return predictions(spark, sf).select("method", "cell_id", r(x).alias("x"), r(S_.inverse_logit(x, 0.0, 100.0), 6).alias("back"))


@query("cumulative_coverage", f"WITH {P}, o AS (SELECT method, cell_id, {_COV} AS c FROM p) SELECT method, cell_id, sum(c) OVER (PARTITION BY method ORDER BY cell_id)::BIGINT AS total FROM o")
def cumulative_coverage(spark, sf):
    m, s, y = _parts()
    run = Window.partitionBy("method").orderBy("cell_id").rowsBetween(RUN, 0)
    return predictions(spark, sf).select("method", "cell_id", F.sum(S_.covered(m, s, y).cast("long")).over(run).alias("total"))
