"""Queries on lattice tables: sources, transforms, filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import aggregates, lattice as L
from gridloom.session import cut
from gridloom.sources import sinks
from gridloom.sources.tables import read_table

from .base import G, NX, NY, RUN, S, Y0, lattice, signal

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def r(c, digits=6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@query("lattice_build", f"WITH {G} SELECT cell_id, ix, iy, truth, n FROM g")
def lattice_build(spark, sf):
    return lattice(spark, sf).select("cell_id", "ix", "iy", "truth", "n")


@query("lattice_mask", f"WITH {G} SELECT cell_id, val FROM g")
def lattice_mask(spark, sf):
    g = lattice(spark, sf)
    mask = g.select("cell_id", F.col("val").isNull().alias("masked"))
    return L.apply_mask(g.drop("val"), mask).select("cell_id", "val")


@query("missing_fraction", f"WITH {G} SELECT count(*) AS cells, count(*) FILTER (val IS NULL) AS missing, round(avg((val IS NULL)::INT), 6) AS share FROM g")
def missing_fraction(spark, sf):
    return L.missing_share(lattice(spark, sf)).select("cells", "missing", r("share").alias("share"))


@query("sentinel_recode", f"WITH {G} SELECT cell_id, nullif(iy % 10, 0) AS v FROM g")
def sentinel_recode(spark, sf):
    return lattice(spark, sf).select("cell_id", L.recode_sentinel(F.col("iy") % 10, 0).alias("v"))


@query("unit_rescale", f"WITH {G} SELECT cell_id, round(truth * 0.02::DOUBLE - 273.15::DOUBLE, 9) AS v FROM g")
def unit_rescale(spark, sf):
    return lattice(spark, sf).select("cell_id", r(L.rescale(F.col("truth")), 9).alias("v"))


@query(
    "axis_generate",
    f"WITH {G}, e AS (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM g) "
    "SELECT 'lon' AS axis, i, round(-95.0::DOUBLE + (i - x0) * (4.0::DOUBLE / (x1 - x0)), 6) AS v FROM (SELECT DISTINCT ix AS i FROM g), e UNION ALL "
    "SELECT 'lat', i, round(37.0::DOUBLE - (i - y0) * (3.0::DOUBLE / (y1 - y0)), 6) FROM (SELECT DISTINCT iy AS i FROM g), e",
)
def axis_generate(spark, sf):
    """Both axes of the lattice in degrees, the second from high to low."""
    g = cut(lattice(spark, sf))

    def one(name, c, low, high, descending):
        ends = g.agg(F.min(c).alias("first"), F.max(c).alias("last"))  # a row
        at = g.select(F.col(c).alias("i")).distinct().join(F.broadcast(ends))
        return at.select(F.lit(name).alias("axis"), "i", r(L.axis(F.col("i") - F.col("first"), F.col("last") - F.col("first") + 1, low, high, descending)).alias("v"))

    return one("lon", "ix", -95.0, -91.0, False).unionByName(one("lat", "iy", 34.0, 37.0, True))


@query("grid_cross", f"WITH {G} SELECT (y - {Y0}) * {NX} + x AS cell_id, x AS ix, y AS iy FROM (SELECT DISTINCT ix AS x FROM g), (SELECT DISTINCT iy AS y FROM g)")
def grid_cross(spark, sf):
    return L.cross_axes(lattice(spark, sf)).select(((F.col("iy") - Y0) * NX + F.col("ix")).alias("cell_id"), "ix", "iy")


@query("window_subset", f"WITH {G} SELECT ix - 10 AS ix, iy - 5 AS iy, truth FROM g WHERE ix BETWEEN 10 AND 39 AND iy BETWEEN 5 AND 24")
def window_subset(spark, sf):
    return L.window_subset(lattice(spark, sf), (10, 39), (5, 24)).select("ix", "iy", "truth")


_SHIFT = f"""sh AS (SELECT * FROM (VALUES {", ".join(f"({i},{a},{b})" for i, (a, b) in enumerate(L.SHIFTS))}) t(img, dx, dy)),
st AS (SELECT g.cell_id, img, o.val AS v FROM g CROSS JOIN sh LEFT JOIN g o
  ON o.ix = greatest(0, least({NX - 1}, g.ix + dx)) AND o.iy = greatest({Y0}, least({Y0 + NY - 1}, g.iy + dy)))"""


@query("lattice_shift12", f"WITH {G}, {_SHIFT} SELECT cell_id, img, v FROM st WHERE img > 0")
def lattice_shift12(spark, sf):
    return L.shifted(lattice(spark, sf), "val", NX, NY, 0, Y0).where("img > 0").select("cell_id", "img", "v")


@query("lattice_stack", f"WITH {G}, {_SHIFT} SELECT img, count(v) AS known, round(avg(v), 2) AS mean FROM st GROUP BY img")
def lattice_stack(spark, sf):
    return L.shifted(lattice(spark, sf), "val", NX, NY, 0, Y0).groupBy("img").agg(F.count("v").alias("known"), F.round(F.avg("v"), 2).alias("mean"))


@query("clip_to_range", f"WITH {G} SELECT cell_id, greatest((SELECT min(val) FROM g), least((SELECT max(val) FROM g), truth * 1.2::DOUBLE - 8000)) AS v FROM g")
def clip_to_range(spark, sf):
    df = lattice(spark, sf).withColumn("v", F.col("truth") * 1.2 - 8000)
    return L.clip_to_observed(df, "v", "val").select("cell_id", "v")


@query("fill_in", f"WITH {G} SELECT cell_id, coalesce(val, m) AS filled FROM g LEFT JOIN (SELECT ix, round(avg(val), 2) AS m FROM g GROUP BY ix) USING (ix)")
def fill_in(spark, sf):
    g = lattice(spark, sf)
    means = g.groupBy("ix").agg(F.round(F.avg("val"), 2).alias("mean"))
    return L.fill_in(g, g.join(means, "ix").select("cell_id", "mean")).select("cell_id", "filled")


@query("reorder_lat_desc", f"WITH {G} SELECT cell_id, ix, row_number() OVER (PARTITION BY ix ORDER BY iy DESC)::INT AS place FROM g")
def reorder_lat_desc(spark, sf):
    return L.column_order(lattice(spark, sf)).select("cell_id", "ix", "place")


@query("matrix_view", f"WITH {G} SELECT iy, {', '.join(f'max(CASE WHEN ix = {i} THEN n END) AS c{i}' for i in range(NX))} FROM g GROUP BY iy")
def matrix_view(spark, sf):
    m = L.to_matrix(lattice(spark, sf), "n", NX)
    return m.select("iy", *[F.col(str(i)).alias(f"c{i}") for i in range(NX)])


@query("unit_cube", f"WITH {G} SELECT cell_id, round((ix - lx) / (hx - lx)::DOUBLE, 6) AS ix, round((iy - ly) / (hy - ly)::DOUBLE, 6) AS iy FROM g, (SELECT min(ix) AS lx, max(ix) AS hx, min(iy) AS ly, max(iy) AS hy FROM g)")
def unit_cube(spark, sf):
    return L.unit_cube(lattice(spark, sf), ["ix", "iy"]).select("cell_id", r("ix").alias("ix"), r("iy").alias("iy"))


@query("scale_coordinates", f"WITH {G} SELECT cell_id, round(ix / sqrt(2.5::DOUBLE), 6) AS sx, round(iy / sqrt(0.4::DOUBLE), 6) AS sy FROM g")
def scale_coordinates(spark, sf):
    return lattice(spark, sf).select("cell_id", r(F.col("ix") / F.sqrt(F.lit(2.5))).alias("sx"), r(F.col("iy") / F.sqrt(F.lit(0.4))).alias("sy"))


@query("midrange_center", f"WITH {G} SELECT cell_id, ix - (lx + hx) / 2 AS ix, iy - (ly + hy) / 2 AS iy FROM g, (SELECT min(ix) AS lx, max(ix) AS hx, min(iy) AS ly, max(iy) AS hy FROM g)")
def midrange_center(spark, sf):
    return L.midrange_centre(lattice(spark, sf), ["ix", "iy"]).select("cell_id", "ix", "iy")


@query("zscore_poly2", f"""WITH {G}, z AS (SELECT cell_id, (ix - avg(ix) OVER ()) / stddev_samp(ix) OVER () AS zx, (iy - avg(iy) OVER ()) / stddev_samp(iy) OVER () AS zy FROM g)
SELECT cell_id, round(zx, 6) AS zx, round(zy, 6) AS zy, round(zx * zx, 6) AS zx2, round(zx * zy, 6) AS zxy, round(zy * zy, 6) AS zy2 FROM z""")
def zscore_poly2(spark, sf):
    z = L.zscore_poly2(lattice(spark, sf), "ix", "iy")
    return z.select("cell_id", *[r(c).alias(c) for c in ("zx", "zy", "zx2", "zxy", "zy2")])


@query("domain_extent", f"""WITH {G} SELECT min(ix) AS xmin, max(ix) AS xmax, min(iy) AS ymin, max(iy) AS ymax,
(SELECT min(d) FROM (SELECT ix - lag(ix) OVER (ORDER BY ix) AS d FROM (SELECT DISTINCT ix FROM g))) AS spacing,
round(sqrt(pow(max(ix) - min(ix), 2) + pow(max(iy) - min(iy), 2)), 6) AS diagonal FROM g""")
def domain_extent(spark, sf):
    return L.extent(lattice(spark, sf)).select("xmin", "xmax", "ymin", "ymax", "spacing", r("diagonal").alias("diagonal"))


@query("occupancy_codes", f"""WITH {G} SELECT CASE WHEN val IS NULL THEN 4 WHEN cell_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS code, count(*) AS cells FROM g GROUP BY 1""")
def occupancy_codes(spark, sf):
    seen, gone = L.split_observed(lattice(spark, sf))
    return L.occupancy(seen.where("cell_id % 10 <> 0"), seen.where("cell_id % 10 = 0"), gone)


@query("axis_index", f"WITH {G} SELECT cell_id, dense_rank() OVER (ORDER BY ix)::INT AS i FROM g")
def axis_index(spark, sf):
    g = lattice(spark, sf)
    values = L.ordered_places(g.select("ix").distinct(), "ix").select("ix", (F.col("place") + 1).cast("int").alias("i"))
    return g.join(values, "ix").select("cell_id", "i")  # Spark broadcasts the axis only where its size allows


@query("available_unobserved", f"WITH {G} SELECT cell_id, CASE WHEN val IS NULL THEN truth END AS v FROM g")
def available_unobserved(spark, sf):
    return lattice(spark, sf).select("cell_id", F.when(F.col("val").isNull(), F.col("truth")).alias("v"))


@query("split_train_test", f"WITH {G} SELECT CASE WHEN val IS NULL THEN 'test' ELSE 'train' END AS part, count(*) AS cells, round(sum(truth), 2) AS total FROM g GROUP BY 1")
def split_train_test(spark, sf):
    seen, gone = L.split_observed(lattice(spark, sf))
    both = seen.withColumn("part", F.lit("train")).unionByName(gone.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("cells"), F.round(F.sum("truth"), 2).alias("total"))


@query("region_exclude", f"WITH {G} SELECT cell_id FROM g WHERE NOT (iy > 36 AND ix > 20 AND ix < 60)")
def region_exclude(spark, sf):
    return lattice(spark, sf).where(~((F.col("iy") > 36) & (F.col("ix") > 20) & (F.col("ix") < 60))).select("cell_id")


@query("basis_removal", f"WITH {G} SELECT cell_id, iy % 3 + 1 AS res FROM g WHERE NOT (iy > 36 AND ix > 45 AND iy % 3 + 1 = 3)")
def basis_removal(spark, sf):
    df = lattice(spark, sf).withColumn("res", F.col("iy") % 3 + 1)
    return df.where(~((F.col("iy") > 36) & (F.col("ix") > 45) & (F.col("res") == 3))).select("cell_id", "res")


@query("membership", f"WITH {G} SELECT cell_id FROM g WHERE val IS NULL AND cell_id NOT IN (SELECT cell_id FROM g WHERE ix % 3 = 0)")
def membership(spark, sf):
    g = lattice(spark, sf)
    return g.where("val is null").join(g.where("ix % 3 = 0"), "cell_id", "left_anti").select("cell_id")


@query("name_strings", "SELECT r_name, substr(lower(r_name), 1, 2) AS two, regexp_replace(r_name || '.temp.v2', '[.].*', '') AS stem, ends_with(r_name, 'A') AS is_a FROM region")
def name_strings(spark, sf):
    name = F.col("r_name")
    stem = F.regexp_replace(F.concat(name, F.lit(".temp.v2")), "[.].*", "")
    return read_table(spark, sf, "region").select(name, F.substring(F.lower(name), 1, 2).alias("two"), stem.alias("stem"), name.endswith("A").alias("is_a"))


@query("natural_join_truth", f"WITH {G} SELECT ix, iy, truth, val FROM g")
def natural_join_truth(spark, sf):
    g = lattice(spark, sf)
    return g.select("ix", "iy", "truth").join(g.select("ix", "iy", "val"), ["ix", "iy"])


@query("hash_split_30", f"WITH {G}, c AS (SELECT count(*) AS n FROM g) SELECT i::INT AS part, CASE WHEN i < 29 THEN n // 30 ELSE n - 29 * (n // 30) END AS cells FROM c, range(30) t(i)")
def hash_split_30(spark, sf):
    return L.exact_split(lattice(spark, sf), 30, 1).groupBy("part").agg(F.count("*").alias("cells"))


@query("cv_split", f"WITH {G}, c AS (SELECT count(*) AS n FROM g WHERE val IS NOT NULL) SELECT i::INT AS part, CASE WHEN i < 9 THEN n // 10 ELSE n - 9 * (n // 10) END AS cells FROM c, range(10) t(i)")
def cv_split(spark, sf):
    seen, _ = L.split_observed(lattice(spark, sf))
    return L.exact_split(seen, 10, 2).groupBy("part").agg(F.count("*").alias("cells"))


@query("holdout_count", f"WITH {G} SELECT count(*) AS cells, round(0.29 * count(*))::BIGINT AS held FROM g")
def holdout_count(spark, sf):
    df = L.holdout(lattice(spark, sf), 0.29, 3)
    return df.agg(F.count("*").alias("cells"), F.count_if(F.col("val").isNull()).alias("held"))


@query("running_sum", f"WITH {G} SELECT cell_id, sum(n) OVER (PARTITION BY ix ORDER BY iy)::BIGINT AS total FROM g")
def running_sum(spark, sf):
    run = Window.partitionBy("ix").orderBy("iy").rowsBetween(RUN, 0)
    return lattice(spark, sf).select("cell_id", F.sum("n").over(run).alias("total"))


@query("first_passing", f"WITH {G}, t AS (SELECT ix, iy, sum(n) OVER (PARTITION BY ix ORDER BY iy) AS total, sum(n) OVER (PARTITION BY ix) AS whole FROM g) SELECT ix, min(iy) AS first_iy FROM t WHERE 2 * total >= whole GROUP BY ix")
def first_passing(spark, sf):
    run = Window.partitionBy("ix").orderBy("iy").rowsBetween(RUN, 0)
    t = lattice(spark, sf).withColumns({"total": F.sum("n").over(run), "whole": F.sum("n").over(Window.partitionBy("ix"))})
    return t.where("2 * total >= whole").groupBy("ix").agg(F.min("iy").alias("first_iy"))


@query(
    "param_grid",
    f"WITH {G}, e AS (SELECT greatest(max(ix) - min(ix), max(iy) - min(iy)) AS side FROM g) "
    "SELECT round(side * (0.025::DOUBLE * a), 6) AS range, round(0.05::DOUBLE * b, 6) AS share FROM e, range(1, 21) x(a), range(0, 10) y(b)",
)
def param_grid(spark, sf):
    """Ranges up to half the longer side of the lattice, and shares of noise."""
    one = lattice(spark, sf).agg(F.greatest(F.max("ix") - F.min("ix"), F.max("iy") - F.min("iy")).alias("side"))
    grid = one.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return grid.select(r(F.col("side") * (F.lit(0.025) * F.col("a"))).alias("range"), r(F.lit(0.05) * F.col("b")).alias("share"))


@query("sort_ranks", f"WITH {G} SELECT cell_id, row_number() OVER (PARTITION BY ix ORDER BY val ASC NULLS LAST, cell_id)::INT AS place FROM g")
def sort_ranks(spark, sf):
    return lattice(spark, sf).select("cell_id", F.row_number().over(Window.partitionBy("ix").orderBy(F.asc_nulls_last("val"), "cell_id")).alias("place"))


@query("set_difference", f"WITH {G} SELECT ix FROM g WHERE iy = 1 EXCEPT SELECT ix FROM g WHERE iy = 2 AND val IS NULL")
def set_difference(spark, sf):
    g = lattice(spark, sf)
    return g.where("iy = 1").select("ix").distinct().join(g.where("iy = 2 and val is null").select("ix"), "ix", "left_anti")


@query("range_summary", f"WITH {S} SELECT min(val) AS low, max(val) AS high, max(val) - min(val) AS width, count(DISTINCT iy) AS rows FROM s")
def range_summary(spark, sf):
    return signal(spark, sf).agg(F.min("val").alias("low"), F.max("val").alias("high"), (F.max("val") - F.min("val")).alias("width"), F.count_distinct("iy").alias("rows"))


@query("fixed_text", f"WITH {S} SELECT cell_id || chr(9) || format('{{:.10f}}', truth) AS line FROM s")
def fixed_text(spark, sf):
    df = signal(spark, sf)
    return df.select(sinks.fixed_text(df, ["cell_id", "truth"]).alias("line"))


@query("plot_data", f"""WITH {S}, z AS (SELECT min(least(truth, val)) AS zmin, max(greatest(truth, val)) AS zmax FROM s)
SELECT ix, iy, name, fill, zmin, zmax FROM (SELECT ix, iy, 'truth' AS name, truth AS fill FROM s UNION ALL SELECT ix, iy, 'val', val FROM s), z""")
def plot_data(spark, sf):
    return sinks.plot_data(signal(spark, sf).select("ix", "iy", "truth", "val"), ["truth", "val"])


@query("rounded_table", f"WITH {S} SELECT ix, round(avg(truth), 2) AS mean FROM s GROUP BY ix")
def rounded_table(spark, sf):
    return sinks.rounded(signal(spark, sf).groupBy("ix").agg(F.avg("truth").alias("mean")))


@query("gram_matrix", f"""WITH {S} SELECT i, j, round(v, 4) AS v FROM (SELECT sum(ix * ix)::DOUBLE AS xx, sum(ix * iy)::DOUBLE AS xy, sum(ix * truth) AS xt, sum(iy * iy)::DOUBLE AS yy, sum(iy * truth) AS yt, sum(truth * truth) AS tt FROM s)
CROSS JOIN LATERAL (VALUES ('ix', 'ix', xx), ('ix', 'iy', xy), ('ix', 'truth', xt), ('iy', 'iy', yy), ('iy', 'truth', yt), ('truth', 'truth', tt)) AS t(i, j, v)""")
def gram_matrix(spark, sf):
    df = signal(spark, sf).withColumns({"ix": F.col("ix").cast("double"), "iy": F.col("iy").cast("double")})
    return aggregates.gram(df, ["ix", "iy", "truth"]).select("i", "j", F.round("v", 4).alias("v"))
