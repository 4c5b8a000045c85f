"""The lattices and predictions that the queries work on, as DataFrames and as SQL for the oracles.

lineitem gives a nearly complete 90 x 50 lattice: ix counts periods of 28 days, iy is the quantity, the value a mean price.
The signal lattice adds a smooth surface, so that models have something to find. Part of the cells is masked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scores import Q975
from gridloom.operators import aggregates, joins
from gridloom.session import cut
from gridloom.sources.tables import read_table

NX, NY, Y0 = 90, 50, 1
DIAMETER = 128.0


def masked(ix, iy):
    return ((ix * 31 + iy * 17) % 100 < 20) | (ix.between(30, 44) & iy.between(20, 34))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ix, iy, cell_id, truth, n, val (truth, null where masked)."""
    li = read_table(spark, sf_dir, "lineitem")
    ix = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 28).cast("int")
    cells = li.groupBy(ix.alias("ix"), F.col("l_quantity").cast("int").alias("iy")).agg(
        # Whole cents sum exactly, so the mean is the same whatever the order.
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / (F.count("*") * 100)).alias("truth"),
        F.count("*").alias("n"),
    )
    return _with_mask(cells)


def _with_mask(cells: DataFrame) -> DataFrame:
    val = F.when(~masked(F.col("ix"), F.col("iy")), F.col("truth"))
    return cells.select("ix", "iy", ((F.col("iy") - Y0) * NX + F.col("ix")).alias("cell_id"), "truth", "n", val.alias("val"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lattice(spark, sf_dir)
    smooth = F.sin(F.col("ix") / F.lit(9.0)) * 8 + F.cos(F.col("iy") / F.lit(7.0)) * 6 + F.lit(40.0)
    return _with_mask(g.withColumn("truth", F.round(smooth + (F.col("truth") - 53000.0) / 20000.0, 6)).drop("val", "cell_id"))


G = f"""g AS (SELECT ix, iy, (iy - {Y0}) * {NX} + ix AS cell_id, truth, n,
  CASE WHEN (ix * 31 + iy * 17) % 100 < 20 OR (ix BETWEEN 30 AND 44 AND iy BETWEEN 20 AND 34) THEN NULL ELSE truth END AS val
  FROM (SELECT CAST(FLOOR(datediff('day', DATE '1995-01-01', l_shipdate::DATE) / 28) AS INT) AS ix, CAST(l_quantity AS INT) AS iy,
        SUM(ROUND(l_extendedprice * 100)::BIGINT)::DOUBLE / (COUNT(*) * 100) AS truth, COUNT(*) AS n FROM lineitem GROUP BY 1, 2))"""
S = (
    G
    + """,
s AS (SELECT ix, iy, cell_id, n, truth, CASE WHEN val IS NULL THEN NULL ELSE truth END AS val
  FROM (SELECT ix, iy, cell_id, n, val, ROUND(sin(ix / 9.0) * 8 + cos(iy / 7.0) * 6 + 40.0 + (truth - 53000.0) / 20000.0, 6) AS truth FROM g))"""
)

METHODS = ["colmean", "global", "idw", "nn", "rowmean", "trend"]


def points(df: DataFrame) -> DataFrame:
    return df.select(F.col("cell_id").alias("id"), F.col("ix").alias("x"), F.col("iy").alias("y"))


def _with_means(base: DataFrame, seen: DataFrame) -> DataFrame:
    """base with the means and sds of all, of the column and of the row, and the plane's value."""
    # Values have six decimals: means are taken of whole millionths, which sum exactly.
    mean = F.sum(F.round(F.col("val") * 1000000).cast("long")) / (F.count("val") * 1000000)
    total = seen.agg(mean.alias("gm"), F.stddev_samp("val").alias("gs"))
    by = lambda k: seen.groupBy(k).agg(mean.alias(f"{k}_mean"), F.stddev_samp("val").alias(f"{k}_sd"))
    plane = aggregates.ols_plane(seen, "ix", "iy", "val")
    wide = base.join(F.broadcast(total)).join(by("ix"), "ix", "left").join(by("iy"), "iy", "left").join(F.broadcast(plane))  # a row each
    return wide.withColumn("trend", F.round(F.col("b0") + F.col("b1") * F.col("ix") + F.col("b2") * F.col("iy"), 6)).drop("b0", "b1", "b2", "r2")


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed cells of the signal lattice with the simple means at their places."""
    seen = cut(signal(spark, sf_dir)).where("val is not null")
    return _with_means(seen.select("cell_id", "ix", "iy", "truth"), seen)


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each masked cell of the signal lattice: truth, the means and sds of six simple predictors, and the distance d
    to the nearest observation; one nearest search serves all. Inverse distances look 4 cells far; with nothing there, the
    nearest value stands in."""
    s = cut(signal(spark, sf_dir))
    seen, gone = s.where("val is not null"), s.where("val is null")
    near = joins.nearest(points(gone), points(seen), 1, 2.0, DIAMETER).select(F.col("i").alias("cell_id"), "j", F.sqrt("d2").alias("d"))
    near = near.join(seen.select(F.col("cell_id").alias("j"), F.col("val").alias("nn")), "j").drop("j")
    around = joins.radius_join(points(gone), points(seen), 4.0).join(seen.select(F.col("cell_id").alias("j"), "val"), "j")
    idw = around.groupBy(F.col("i").alias("cell_id")).agg((F.sum(F.col("val") / F.col("d2")) / F.sum(1.0 / F.col("d2"))).alias("idw"))
    wide = _with_means(gone.select("cell_id", "ix", "iy", "truth"), seen).join(near, "cell_id", "left").join(idw, "cell_id", "left")
    return wide.withColumn("idw", F.coalesce(F.round("idw", 6), "nn"))


def stacked(wide: DataFrame, *keep: str, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """method, cell_id, mean, sd and truth of a table of baselines() or means(), and the columns to keep."""
    of = {"colmean": ("ix_mean", "ix_sd"), "global": ("gm", "gs"), "idw": ("idw", "gs"), "nn": ("nn", "gs"), "rowmean": ("iy_mean", "iy_sd"), "trend": ("trend", "gs")}
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.col(mean).alias("mean"), F.round(sd, 6).alias("sd")) for m, (mean, sd) in of.items() if m in methods])
    rows = wide.select("cell_id", "truth", *keep, F.explode(each).alias("p")).where("p.mean is not null")
    return rows.select("p.method", "cell_id", "p.mean", "p.sd", "truth", *keep)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, cell_id, mean, sd and truth of six simple predictors at the masked cells of the signal lattice."""
    return stacked(baselines(spark, sf_dir))


OLS = """m AS (SELECT avg(ix) AS mx, avg(iy) AS my, avg(val) AS mv FROM s WHERE val IS NOT NULL),
q AS (SELECT sum((ix-mx)*(ix-mx)) AS xx, sum((iy-my)*(iy-my)) AS yy, sum((ix-mx)*(iy-my)) AS xy, sum((ix-mx)*(val-mv)) AS xv, sum((iy-my)*(val-mv)) AS yv,
  sum((val-mv)*(val-mv)) AS vv, first(mx) AS mx, first(my) AS my, first(mv) AS mv FROM s, m WHERE val IS NOT NULL),
b AS (SELECT *, (xv*yy - yv*xy) / (xx*yy - xy*xy) AS b1, (yv*xx - xv*xy) / (xx*yy - xy*xy) AS b2 FROM q),
ols AS (SELECT mv - b1*mx - b2*my AS b0, b1, b2, (b1*xv + b2*yv) / vv AS r2 FROM b)"""
P = (
    S
    + ",\n"
    + OLS
    + """,
seen AS MATERIALIZED (SELECT * FROM s WHERE val IS NOT NULL), gone AS MATERIALIZED (SELECT * FROM s WHERE val IS NULL),
tot AS (SELECT sum(round(val * 1000000)::BIGINT)::DOUBLE / (count(val) * 1000000) AS gm, stddev_samp(val) AS gs FROM seen),
pairs AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, b.val, ((a.ix-b.ix)*(a.ix-b.ix) + (a.iy-b.iy)*(a.iy-b.iy))::DOUBLE AS d2 FROM gone a, seen b),
p0 AS (SELECT 'global' AS method, cell_id, gm AS mean, gs AS sd, truth FROM gone, tot
  UNION ALL SELECT 'colmean', cell_id, mean, sd, truth FROM gone JOIN (SELECT ix, sum(round(val * 1000000)::BIGINT)::DOUBLE / (count(val) * 1000000) AS mean, stddev_samp(val) AS sd FROM seen GROUP BY ix) USING (ix)
  UNION ALL SELECT 'rowmean', cell_id, mean, sd, truth FROM gone JOIN (SELECT iy, sum(round(val * 1000000)::BIGINT)::DOUBLE / (count(val) * 1000000) AS mean, stddev_samp(val) AS sd FROM seen GROUP BY iy) USING (iy)
  UNION ALL SELECT 'trend', cell_id, round(b0 + b1*ix + b2*iy, 6), gs, truth FROM gone, ols, tot
  UNION ALL SELECT 'idw', cell_id, mean, gs, truth FROM gone JOIN (SELECT i AS cell_id, coalesce(round(sum(CASE WHEN d2 <= 16 THEN val/d2 END) / sum(CASE WHEN d2 <= 16 THEN 1.0/d2 END), 6), arg_min(val, d2 * 100000 + j)) AS mean FROM pairs GROUP BY i) USING (cell_id), tot
  UNION ALL SELECT 'nn', cell_id, mean, gs, truth FROM gone JOIN (SELECT i AS cell_id, arg_min(val, d2 * 100000 + j) AS mean FROM pairs GROUP BY i) USING (cell_id), tot),
p AS MATERIALIZED (SELECT method, cell_id, mean, round(sd, 6) AS sd, truth FROM p0)"""
)


SCORE_COLUMNS = ["mae", "rmse", "crps", "intscore", "coverage"]
RUN = Window.unboundedPreceding
QUANTILE = Q975
