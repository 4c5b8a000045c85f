"""Spatial joins and spatial sums: neighbours, radius, tiles, variograms, clusters, covariance triplets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import covariance as C
from gridloom.models import neighbours
from gridloom.operators import aggregates as A
from gridloom.operators import joins as J
from gridloom.operators.lattice import ordered_places
from gridloom.session import cut
from gridloom.sources import sinks

from .base import DIAMETER, NX, NY, OLS, S, Y0, points, signal

QUERIES: dict = {}
LEVELS = 6
CENTRES = [(k, 9.0 + 18 * (k % 5), 5.5 + 10 * (k // 5)) for k in range(25)]
LAGS = [(a, b) for a in range(0, 11) for b in range(0, 11) if (a, b) != (0, 0)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def r(c, digits=6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_CENTRES = "cen AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, x, y in CENTRES) + ") t(centre, cx, cy))"
_NEAREST = f"{_CENTRES}, nc AS (SELECT cell_id, ix, iy, val, truth, arg_min(centre, d2 * 1000 + centre)::INT AS centre, min(d2) AS d2 FROM (SELECT s.*, cen.centre, (ix-cx)*(ix-cx) + (iy-cy)*(iy-cy) AS d2 FROM s, cen) GROUP BY ALL)"


def _clusters(spark, sf):
    return J.nearest_centre(signal(spark, sf), CENTRES)


@query("nearest_centroid", f"WITH {S}, {_NEAREST} SELECT cell_id, centre, d2 FROM nc")
def nearest_centroid(spark, sf):
    return _clusters(spark, sf).select("cell_id", "centre", "d2")


FINE = [(k, 2.0 + 5 * (k % 18), 3.0 + 5 * (k // 18)) for k in range(180)]
_FINE = "fin AS (SELECT k::INT AS centre, (2.0 + 5 * (k % 18))::DOUBLE AS cx, (3.0 + 5 * (k // 18))::DOUBLE AS cy FROM range(180) t(k))"
_PICK = "arg_min(centre, ((ix-cx)*(ix-cx) + (iy-cy)*(iy-cy)) * 1000 + centre)"


@query("nearest_grid_reassign", f"""WITH {S}, {_FINE}, one AS (SELECT cell_id, val, {_PICK} AS centre FROM s, fin GROUP BY ALL),
kept AS (SELECT * FROM fin WHERE centre IN (SELECT centre FROM one WHERE val IS NOT NULL)), two AS (SELECT cell_id, ix, iy, val, {_PICK} AS centre FROM s, kept GROUP BY ALL)
SELECT centre, count(*) AS cells, count(val) AS observed, round(avg(ix), 6) AS cx, round(avg(iy), 6) AS cy FROM two GROUP BY centre""")
def nearest_grid_reassign(spark, sf):
    """Grid points in the large hole have no observation: they are dropped and their cells re-assigned."""
    s = J.nearest_kept_centre(signal(spark, sf), FINE, "val")
    return s.groupBy("centre").agg(F.count("*").alias("cells"), F.count("val").alias("observed"), r(F.avg("ix")).alias("cx"), r(F.avg("iy")).alias("cy"))


def _seen(spark, sf):
    return signal(spark, sf).where("val is not null")


_RADIUS = "rp AS (SELECT a.cell_id AS i, b.cell_id AS j, ((a.ix-b.ix)*(a.ix-b.ix) + (a.iy-b.iy)*(a.iy-b.iy))::DOUBLE AS d2, a.val AS vi, b.val AS vj FROM s a JOIN s b ON abs(a.ix-b.ix) <= 3 AND abs(a.iy-b.iy) <= 3 WHERE a.val IS NOT NULL AND b.val IS NOT NULL AND (a.ix-b.ix)*(a.ix-b.ix) + (a.iy-b.iy)*(a.iy-b.iy) <= 9)"


@query("radius_pairs", f"WITH {S}, {_RADIUS} SELECT i, j, round(sqrt(d2), 6) AS d FROM rp WHERE i < j")
def radius_pairs(spark, sf):
    p = points(_seen(spark, sf))
    return J.radius_join(p, p, 3.0, F.col("i") < F.col("j")).select("i", "j", r(F.sqrt("d2")).alias("d"))


@query("pair_distances", f"WITH {S}, {_CENTRES} SELECT cell_id AS i, centre AS j, round(sqrt((ix-cx)*(ix-cx) + (iy-cy)*(iy-cy)), 6) AS d FROM s, cen")
def pair_distances(spark, sf):
    """All distances between the cells and the centres."""
    return J.cross_distances(points(signal(spark, sf)), CENTRES).select("i", "j", r("d").alias("d"))


@query("tapered_cov_triplets", f"WITH {S}, {_RADIUS} SELECT i, j, round(2.0::DOUBLE * exp(sqrt(d2) * (-1 / 4.0::DOUBLE)) * CASE WHEN sqrt(d2) < 3 THEN pow(1 - sqrt(d2) / 3, 4) * (sqrt(d2) / 3 * 4 + 1) ELSE 0 END, 8) AS v FROM rp WHERE i <= j AND d2 < 9")
def tapered_cov_triplets(spark, sf):
    p = points(_seen(spark, sf))
    d = F.sqrt("d2")
    pairs = J.radius_join(p, p, 3.0, F.col("i") <= F.col("j")).where("d2 < 9")
    return pairs.select("i", "j", r(C.Exponential(2.0, 4.0).col(d) * C.wendland(d, 3.0), 8).alias("v"))


_ORDERED = """o AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY cell_id) - 1)::BIGINT AS id, ix AS x, iy AS y, val FROM s WHERE val IS NOT NULL),
op AS (SELECT a.id AS i, b.id AS j, ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))::DOUBLE AS d2 FROM o a JOIN o b ON b.id < a.id),
ok AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY d2, j)::INT AS rank, j, d2 FROM op QUALIFY rank <= 5)"""


def _ordered(spark, sf):
    """The observed cells, numbered in cell order."""
    seen = ordered_places(_seen(spark, sf))
    return cut(seen.select(F.col("place").cast("long").alias("id"), F.col("ix").alias("x"), F.col("iy").alias("y"), "val"))


def _neighbours(spark, sf, m=5, at=None):
    return J.ordered_neighbours(at if at is not None else _ordered(spark, sf), m, 3.0, DIAMETER)


@query("ordered_knn", f"WITH {S}, {_ORDERED} SELECT i, rank, j, round(sqrt(d2), 6) AS d FROM ok")
def ordered_knn(spark, sf):
    return _neighbours(spark, sf).select("i", "rank", "j", r(F.sqrt("d2")).alias("d"))


@query("reverse_neighbours", f"WITH {S}, {_ORDERED} SELECT j, count(*) AS users, min(i) AS first_user, max(i) AS last_user FROM ok GROUP BY j")
def reverse_neighbours(spark, sf):
    return J.reverse_neighbours(_neighbours(spark, sf))


@query("reverse_neighbour_lists", f"WITH {S}, {_ORDERED}, n AS (SELECT j, i, ((row_number() OVER (PARTITION BY j ORDER BY i) - 1) // 1000)::INT AS part FROM ok) SELECT j, part, string_agg(i::VARCHAR, ',' ORDER BY i) AS users FROM n GROUP BY j, part")
def reverse_neighbour_lists(spark, sf):
    lists = J.reverse_lists(_neighbours(spark, sf))
    return lists.select("j", "part", F.concat_ws(",", F.transform("users", lambda i: i.cast("string"))).alias("users"))


@query("neighbour_list_text", f"WITH {S}, {_ORDERED} SELECT i, (i + 1) || ' ' || string_agg((j + 1)::VARCHAR, ',' ORDER BY rank) AS line FROM ok GROUP BY i")
def neighbour_list_text(spark, sf):
    return sinks.neighbour_lines(_neighbours(spark, sf))


@query("neighbour_set_distances", f"WITH {S}, {_ORDERED} SELECT a.i, a.rank AS r1, b.rank AS r2, round(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)), 6) AS d FROM ok a JOIN ok b ON a.i = b.i AND a.rank < b.rank JOIN o p ON p.id = a.j JOIN o q ON q.id = b.j")
def neighbour_set_distances(spark, sf):
    at = _ordered(spark, sf)
    n = _neighbours(spark, sf, 5, at)
    placed = n.join(at.select(F.col("id").alias("j"), "x", "y"), "j").select("i", "rank", "x", "y")
    other = placed.select("i", F.col("rank").alias("r2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = placed.withColumnRenamed("rank", "r1").join(other, "i").where("r1 < r2")
    return pairs.select("i", "r1", "r2", r(C.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))).alias("d"))


_ROOK = "rk AS (SELECT a.cell_id AS src, b.cell_id AS dst, abs(a.truth - b.truth) AS change FROM s a JOIN s b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1))"


@query("rook_adjacency", f"WITH {S}, {_ROOK} SELECT src, dst FROM rk")
def rook_adjacency(spark, sf):
    return J.rook_edges(signal(spark, sf), "truth").select("src", "dst")


@query("edge_gradient", f"WITH {S}, {_ROOK} SELECT src, dst, round(change / 1, 6) AS gradient, round(change * change / 1, 6) AS squared FROM rk")
def edge_gradient(spark, sf):
    e = J.rook_edges(signal(spark, sf), "truth")
    return e.select("src", "dst", r(F.col("change") / F.col("d")).alias("gradient"), r(F.col("change") * F.col("change") / F.col("d")).alias("squared"))


_LINK = f"lk AS (SELECT least(a.centre, b.centre) AS c1, greatest(a.centre, b.centre) AS c2, change FROM rk JOIN nc a ON a.cell_id = src JOIN nc b ON b.cell_id = dst WHERE a.centre <> b.centre)"


def _edges_and_labels(spark, sf):
    """The rook edges of the signal lattice and its cells' clusters, from one written lattice.

    A join on the clusters, or a condition on them, would otherwise be pushed below the sums that make the cells, as clusters
    follow from ix and iy: all centres would be measured for every line item, not for every cell.
    """
    s = cut(_clusters(spark, sf).select("cell_id", "ix", "iy", "truth", "centre"))
    return J.rook_edges(s, "truth"), s.select("cell_id", F.col("centre").alias("cluster"), "truth")


@query("cluster_pair_linkage", f"WITH {S}, {_NEAREST}, {_ROOK}, {_LINK} SELECT c1, c2, round(max(change), 6) AS complete, round(min(change), 6) AS single, round(avg(change), 6) AS average, count(*) AS edges FROM lk GROUP BY c1, c2")
def cluster_pair_linkage(spark, sf):
    l = A.linkage(*_edges_and_labels(spark, sf))
    return l.select("c1", "c2", r("complete").alias("complete"), r("single").alias("single"), r("average").alias("average"), "edges")


_WARD = "wd AS (SELECT c1, c2, round(a.n * b.n / (a.n + b.n)::DOUBLE * (a.m - b.m) * (a.m - b.m), 6) AS ward FROM (SELECT DISTINCT c1, c2 FROM lk) JOIN (SELECT centre AS c1, count(*) AS n, avg(truth) AS m FROM nc GROUP BY 1) a USING (c1) JOIN (SELECT centre AS c2, count(*) AS n, avg(truth) AS m FROM nc GROUP BY 1) b USING (c2))"


@query("ward_step", f"WITH {S}, {_NEAREST}, {_ROOK}, {_LINK}, {_WARD} SELECT c1, c2, ward FROM wd ORDER BY ward, c1, c2 LIMIT 1")
def ward_step(spark, sf):
    edges, labels = _edges_and_labels(spark, sf)
    costs = A.ward_costs(edges, labels, "truth").withColumn("ward", r("ward"))
    best = costs.agg(F.min(F.struct("ward", "c1", "c2")).alias("b"))
    return best.select("b.c1", "b.c2", "b.ward")


_TABLE = f"ct AS (SELECT centre AS a, (ix // 18)::INT AS b, count(*) AS n FROM nc GROUP BY ALL)"


def _table(spark, sf):
    return A.contingency(_clusters(spark, sf).select(F.col("centre").alias("a"), F.expr("ix div 18").cast("int").alias("b")), "a", "b")


@query("contingency", f"WITH {S}, {_NEAREST}, {_TABLE} SELECT a, b, n FROM ct")
def contingency(spark, sf):
    return _table(spark, sf)


@query("adjusted_rand", f"""WITH {S}, {_NEAREST}, {_TABLE}, x AS (SELECT sum(n * (n - 1) / 2.0) AS nij, sum(n) AS t FROM ct), pa AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM ct GROUP BY a)), pb AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM ct GROUP BY b))
SELECT round((nij - pa.v * pb.v / (t * (t - 1) / 2.0)) / ((pa.v + pb.v) / 2 - pa.v * pb.v / (t * (t - 1) / 2.0)), 8) AS ari FROM x, pa, pb""")
def adjusted_rand(spark, sf):
    return A.adjusted_rand(_table(spark, sf), "a", "b").select(r("ari", 8).alias("ari"))


_VARIO = "vg AS (SELECT lx, ly, count(*) AS pairs, avg((a.val - b.val) * (a.val - b.val)) AS gamma FROM range(11) x(lx), range(11) y(ly), s a JOIN s b ON b.ix = a.ix + lx AND b.iy = a.iy + ly WHERE (lx > 0 OR ly > 0) AND a.val IS NOT NULL AND b.val IS NOT NULL GROUP BY lx, ly)"


@query("variogram_matrix", f"WITH {S}, {_VARIO} SELECT lx::INT AS lx, ly::INT AS ly, pairs, round(gamma, 6) AS gamma FROM vg")
def variogram_matrix(spark, sf):
    return A.variogram(signal(spark, sf), LAGS, "val").select("lx", "ly", "pairs", r("gamma").alias("gamma"))


_DIRECTION = "CASE WHEN ly = 0 THEN 1 WHEN lx = 2 * ly THEN 2 WHEN lx = ly THEN 3 WHEN ly = 2 * lx THEN 4 WHEN lx = 0 THEN 5 END"


def _directions(spark, sf):
    v = A.variogram(signal(spark, sf), LAGS, "val")
    v = v.withColumn("direction", F.expr(_DIRECTION)).where("direction is not null")
    return v.withColumn("h", F.sqrt((F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly")).cast("double")))


@query("variogram_directional", f"WITH {S}, {_VARIO} SELECT {_DIRECTION} AS direction, round(sqrt(lx * lx + ly * ly), 6) AS h, round(gamma, 6) AS gamma FROM vg WHERE {_DIRECTION} IS NOT NULL")
def variogram_directional(spark, sf):
    return _directions(spark, sf).select("direction", r("h").alias("h"), r("gamma").alias("gamma"))


@query("variogram_model_ss", f"WITH {S}, {_VARIO} SELECT {_DIRECTION} AS direction, round(sum(pow(gamma - ((1 - exp(sqrt(lx * lx + ly * ly) * (-1 / 8.0::DOUBLE))) * 60.0::DOUBLE + 0.5::DOUBLE), 2)), 4) AS ss FROM vg WHERE {_DIRECTION} IS NOT NULL GROUP BY 1")
def variogram_model_ss(spark, sf):
    miss = F.col("gamma") - C.exponential_variogram(F.col("h"), 0.5, 60.0, 8.0)
    return _directions(spark, sf).groupBy("direction").agg(F.round(F.sum(miss * miss), 4).alias("ss"))


@query("exp_cov", f"WITH {S}, {_RADIUS} SELECT d2, round(1.5::DOUBLE * exp(sqrt(d2) * (-1 / 2.0::DOUBLE)), 8) AS e, round(1.5::DOUBLE * exp(-(sqrt(d2) / 2)) * (sqrt(d2) / 2 * sqrt(3.0::DOUBLE) + 1) / exp(sqrt(d2) / 2 * (sqrt(3.0::DOUBLE) - 1)), 8) AS m FROM (SELECT DISTINCT d2 FROM rp)")
def exp_cov(spark, sf):
    p = points(_seen(spark, sf))
    d = F.sqrt("d2")
    return J.radius_join(p, p, 3.0).select("d2").distinct().select("d2", r(C.Exponential(1.5, 2.0).col(d), 8).alias("e"), r(C.Matern(1.5, 2.0, 1.5).col(d), 8).alias("m"))


@query("bisquare_basis", f"WITH {S}, {_CENTRES} SELECT cell_id, centre, round(pow(1 - pow(sqrt((ix-cx)*(ix-cx) + (iy-cy)*(iy-cy)) / 12.0::DOUBLE, 2), 2), 6) AS b FROM s, cen WHERE (ix-cx)*(ix-cx) + (iy-cy)*(iy-cy) < 144")
def bisquare_basis(spark, sf):
    s = signal(spark, sf)
    centres = spark.createDataFrame(CENTRES, "id int, x double, y double")
    near = J.radius_join(points(s), centres, 12.0).where("d2 < 144")
    return near.select(F.col("i").alias("cell_id"), F.col("j").alias("centre"), r(C.bisquare(F.sqrt("d2"), 12.0)).alias("b"))


@query("ols_trend", f"WITH {S}, {OLS} SELECT round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(r2, 6) AS r2 FROM ols")
def ols_trend(spark, sf):
    o = A.ols_plane(signal(spark, sf).where("val is not null"), "ix", "iy", "val")
    return o.select(*[r(c).alias(c) for c in ("b0", "b1", "b2", "r2")])


def _tile_rows() -> str:
    rows = [f"({t['id']}, {t['level']}, {t['tile']}, {t['parent'] if t['parent'] else 'NULL'}, {t['xmin']}::DOUBLE, {t['xmax']}::DOUBLE, {t['ymin']}::DOUBLE, {t['ymax']}::DOUBLE)" for t in J.tiles(NX, NY, LEVELS, 0, Y0)]
    return "tl AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(id, level, tile, parent, xmin, xmax, ymin, ymax))"


def _occupied(spark, sf):
    """id, level, n, known: the tiles of all levels that hold a cell of the lattice, how many, and how many are observed."""
    leaf = signal(spark, sf).groupBy(J.tile_of(NX, NY, LEVELS, 0, Y0).alias("leaf")).agg(F.count("*").alias("n"), F.count("val").alias("known"))
    up = F.concat(J.ancestors(F.col("leaf"), F.lit(LEVELS)), F.array("leaf"))
    return leaf.select("n", "known", F.posexplode(up).alias("level", "id")).groupBy("id", "level").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))


_OCCUPIED = f"{S}, {_tile_rows()}, oc AS (SELECT id, level, tile, parent, xmin, xmax, ymin, ymax, count(*) AS n, count(val) AS known FROM s JOIN tl ON ix >= xmin AND ix < xmax AND iy >= ymin AND iy < ymax GROUP BY ALL)"


@query("tile_tree", f"WITH {_OCCUPIED} SELECT id, level, tile, parent, xmin, xmax, ymin, ymax, n, known FROM oc")
def tile_tree(spark, sf):
    """The tiles that hold cells of the lattice; a tile's box follows from its id, by halving the longer side on the way down."""
    xmin, xmax, ymin, ymax = F.lit(0.0), F.lit(float(NX)), F.lit(float(Y0)), F.lit(float(Y0 + NY))
    w, h = float(NX), float(NY)
    rows = _occupied(spark, sf)
    for k in range(LEVELS):
        turn = F.when(F.col("level") > k, F.call_function("shiftright", "id", F.col("level") - (k + 1)).bitwiseAND(1))  # null: this level is not reached
        low, high = (xmin, xmax) if w >= h else (ymin, ymax)
        mid = (low + high) / 2
        low, high = F.when(turn == 1, mid).otherwise(low), F.when(turn == 0, mid).otherwise(high)
        rows = rows.withColumns({f"a{k}": low, f"b{k}": high})
        low, high = F.col(f"a{k}"), F.col(f"b{k}")
        if w >= h:
            xmin, xmax, w = low, high, w / 2
        else:
            ymin, ymax, h = low, high, h / 2
    tile = (F.col("id") - F.call_function("shiftleft", F.lit(1), F.col("level"))).alias("tile")
    parent = F.when(F.col("level") > 0, F.shiftright("id", 1)).alias("parent")
    return rows.select("id", "level", tile, parent, xmin.alias("xmin"), xmax.alias("xmax"), ymin.alias("ymin"), ymax.alias("ymax"), "n", "known")


@query("tile_containment", f"WITH {S}, {_tile_rows()} SELECT cell_id, id AS tile FROM s JOIN tl ON level = {LEVELS} AND ix >= xmin AND ix < xmax AND iy >= ymin AND iy < ymax")
def tile_containment(spark, sf):
    return signal(spark, sf).select("cell_id", J.tile_of(NX, NY, LEVELS, 0, Y0).alias("tile"))


@query("ancestry", f"WITH {_OCCUPIED} SELECT id, level, floor(id / pow(2, level - k))::INT AS ancestor, k::INT AS at, n FROM oc, range({LEVELS}) r(k) WHERE k < level")
def ancestry(spark, sf):
    rows = _occupied(spark, sf).where("level > 0").select("id", "level", "n", F.posexplode(J.ancestors(F.col("id"), F.col("level"))).alias("at", "ancestor"))
    return rows.select("id", "level", "ancestor", "at", "n")


@query("tile_children", f"WITH {_OCCUPIED}, ch AS (SELECT id, level, unnest([2 * id, 2 * id + 1])::INT AS child FROM oc WHERE level < {LEVELS}) SELECT ch.id, ch.level, child, coalesce(oc.n, 0) AS n FROM ch LEFT JOIN oc ON oc.id = child")
def tile_children(spark, sf):
    """Both halves of each tile and the cells that they hold."""
    held = cut(_occupied(spark, sf))
    halves = held.where(F.col("level") < LEVELS).select("id", "level", F.explode(J.children(F.col("id"))).alias("child"))
    return halves.join(held.select(F.col("id").alias("child"), "n"), "child", "left").select("id", "level", "child", F.coalesce("n", F.lit(0)).alias("n"))


@query("tile_containment_closed", f"WITH {S}, {_tile_rows()} SELECT cell_id, id AS tile FROM s JOIN tl ON level = {LEVELS} AND ix >= xmin AND ix <= xmax AND iy >= ymin AND iy <= ymax")
def tile_containment_closed(spark, sf):
    """Borders belong to the tiles on both sides: a cell looks a little to either side of itself."""
    near = lambda a, b: J.tile_of(NX, NY, LEVELS, 0, Y0, f"__x{a}", f"__y{b}")
    s = signal(spark, sf).select("cell_id", *[(F.col(c) + d / 1e6).alias(f"__{n}{k}") for n, c in (("x", "ix"), ("y", "iy")) for k, d in enumerate((-1, 1))])
    return s.select("cell_id", F.explode(F.array_distinct(F.array(*[near(a, b) for a in (0, 1) for b in (0, 1)]))).alias("tile"))


@query("tile_sums", f"WITH {S}, {_tile_rows()}, lf AS (SELECT id, count(val) AS n, sum(val) AS total FROM s JOIN tl ON level = {LEVELS} AND ix >= xmin AND ix < xmax AND iy >= ymin AND iy < ymax GROUP BY id) SELECT (id // 2)::INT AS parent, sum(n)::BIGINT AS n, round(sum(total), 4) AS total FROM lf GROUP BY 1")
def tile_sums(spark, sf):
    leaf = signal(spark, sf).groupBy(J.tile_of(NX, NY, LEVELS, 0, Y0).alias("id")).agg(F.count("val").alias("n"), F.sum("val").alias("total"))
    return leaf.groupBy(F.floor(F.col("id") / 2).cast("int").alias("parent")).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


_BLOCK = ["1", "ix", "iy", "ix * ix", "ix * iy", "iy * iy", "val", "ix * val", "iy * val"]


@query(
    "tile_block_sums",
    f"WITH {S}, {_tile_rows()}, lf AS (SELECT id, {', '.join(f'sum({e}) AS v{k}' for k, e in enumerate(_BLOCK))} FROM s JOIN tl ON level = {LEVELS} AND ix >= xmin AND ix < xmax AND iy >= ymin AND iy < ymax WHERE val IS NOT NULL GROUP BY id), "
    f"up AS (SELECT (id // 2)::INT AS parent, {', '.join(f'sum(v{k})::DOUBLE AS v{k}' for k in range(len(_BLOCK)))} FROM lf GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT parent, {k} AS k, round(v{k}, 3) AS v FROM up" for k in range(len(_BLOCK))),
)
def tile_block_sums(spark, sf):
    """Each tile's normal equations of a plane, as one array, and their sums over a parent's children."""
    seen = signal(spark, sf).where("val is not null")
    leaf = seen.groupBy(J.tile_of(NX, NY, LEVELS, 0, Y0).alias("id")).agg(F.array(*[F.sum(F.expr(e).cast("double")) for e in _BLOCK]).alias("block"))
    up = A.sum_blocks(leaf.select(F.floor(F.col("id") / 2).cast("int").alias("parent"), "block"), "parent", "block")
    return up.select("parent", F.posexplode("block").alias("k", "v")).select("parent", "k", r("v", 3).alias("v"))


@query(
    "tile_ways",
    f"WITH {S}, t AS (SELECT val, floor((ix - 0) * 2 / {NX}.0::DOUBLE)::INT AS a, floor((iy - {Y0}) * 2 / {NY}.0::DOUBLE)::INT AS b, floor((ix - 0) * 4 / {NX}.0::DOUBLE)::INT AS c, floor((iy - {Y0}) * 4 / {NY}.0::DOUBLE)::INT AS d FROM s) "
    "SELECT 4 AS ways, (1 * 4 + a * 2 + b) * 4 + (c % 2) * 2 + d % 2 AS tile, count(*) AS n, count(val) AS known FROM t GROUP BY ALL UNION ALL "
    f"SELECT 16, 64 + floor(ix * 8 / {NX}.0::DOUBLE)::INT * 8 + floor((iy - {Y0}) * 8 / {NY}.0::DOUBLE)::INT, count(*), count(val) FROM s GROUP BY ALL",
)
def tile_ways(spark, sf):
    """Cells of the tiles of two levels of four parts, and of one level cut in eight both ways."""
    s = cut(signal(spark, sf))
    one = lambda ways, levels: s.groupBy(F.lit(ways).alias("ways"), J.tile_of_ways(NX, NY, levels, ways, 0, Y0).alias("tile")).agg(F.count("*").alias("n"), F.count("val").alias("known"))
    return one(4, 2).unionByName(one(16, 1))


@query(
    "knots",
    f"""WITH {S}, e AS (SELECT min(ix)::DOUBLE AS x0, max(ix)::DOUBLE AS x1, min(iy)::DOUBLE AS y0, max(iy)::DOUBLE AS y1 FROM s WHERE val IS NOT NULL)
    SELECT i * 14 + j AS id, round(x0 + (x1 - x0) * 0.01::DOUBLE + i * ((x1 - x0) * 0.98::DOUBLE / 13), 6) AS x, round(y0 + (y1 - y0) * 0.01::DOUBLE + j * ((y1 - y0) * 0.98::DOUBLE / 13), 6) AS y FROM e, range(14) a(i), range(14) b(j)""",
)
def knots(spark, sf):
    """14 by 14 places inside the observed cells' extent."""
    ends = signal(spark, sf).where("val is not null").agg(*[f(c).cast("double").alias(f"{c}{k}") for c in ("ix", "iy") for k, f in enumerate((F.min, F.max))])
    rows = ends.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(195).cast("long"))))
    at = lambda c, k: F.element_at(F.array(*J.knots(14, F.col(f"{c}0"), F.col(f"{c}1"), 0.01)), (k + 1).cast("int"))
    return rows.select("id", r(at("ix", F.expr("id div 14"))).alias("x"), r(at("iy", F.col("id") % 14)).alias("y"))


VARIANCE, DECAY, NUGGET = 40.0, 0.1, 0.5
_M1 = f"""n1 AS (SELECT i, j, sqrt(d2) AS d FROM ok WHERE rank = 1),
fc AS (SELECT i, j, {VARIANCE}::DOUBLE * exp(-{DECAY}::DOUBLE * d) / {VARIANCE + NUGGET}::DOUBLE AS b, {VARIANCE + NUGGET}::DOUBLE - pow({VARIANCE}::DOUBLE * exp(-{DECAY}::DOUBLE * d), 2) / {VARIANCE + NUGGET}::DOUBLE AS f FROM n1)"""


def _factors(spark, sf, at=None):
    edges = _neighbours(spark, sf, 1, at).select("i", "j", F.sqrt("d2").alias("d"))
    return A.chain_factors(edges, VARIANCE, DECAY, NUGGET)


@query("nngp_m1_factors", f"WITH {S}, {_ORDERED}, {_M1} SELECT i, j, round(b, 8) AS b, round(f, 8) AS f FROM fc")
def nngp_m1_factors(spark, sf):
    return _factors(spark, sf).select("i", "j", r("b", 8).alias("b"), r("f", 8).alias("f"))


@query("nngp_m1_quadform", f"WITH {S}, {_ORDERED}, {_M1} SELECT round(sum((u.val - b * v.val) * (u.val - b * v.val) / f), 4) AS q FROM fc JOIN o u ON u.id = i JOIN o v ON v.id = j")
def nngp_m1_quadform(spark, sf):
    at = _ordered(spark, sf)
    f = _factors(spark, sf, at).join(at.select(F.col("id").alias("i"), F.col("val").alias("u")), "i").join(at.select(F.col("id").alias("j"), F.col("val").alias("v")), "j")
    miss = F.col("u") - F.col("b") * F.col("v")
    return f.agg(F.round(F.sum(miss * miss / F.col("f")), 4).alias("q"))


@query("logdet_m1", f"WITH {S}, {_ORDERED}, {_M1} SELECT round(sum(ln(f)), 6) AS logdet FROM fc")
def logdet_m1(spark, sf):
    return _factors(spark, sf).agg(r(F.sum(F.log("f"))).alias("logdet"))


_T = VARIANCE + NUGGET
_M2 = f"""e2 AS (SELECT u.id, u.val, v.val AS val1, w.val AS val2, {VARIANCE}::DOUBLE * exp(-{DECAY}::DOUBLE * sqrt(a.d2)) AS k1, {VARIANCE}::DOUBLE * exp(-{DECAY}::DOUBLE * sqrt(b.d2)) AS k2,
    {VARIANCE}::DOUBLE * exp(-{DECAY}::DOUBLE * sqrt((v.x - w.x) * (v.x - w.x) + (v.y - w.y) * (v.y - w.y))) AS k12
  FROM o u LEFT JOIN ok a ON a.i = u.id AND a.rank = 1 LEFT JOIN o v ON v.id = a.j LEFT JOIN ok b ON b.i = u.id AND b.rank = 2 LEFT JOIN o w ON w.id = b.j),
b2 AS (SELECT *, CASE WHEN k2 IS NOT NULL THEN ({_T}::DOUBLE * k1 - k12 * k2) / ({_T * _T}::DOUBLE - k12 * k12) WHEN k1 IS NOT NULL THEN k1 / {_T}::DOUBLE ELSE 0 END AS b1,
    CASE WHEN k2 IS NOT NULL THEN ({_T}::DOUBLE * k2 - k12 * k1) / ({_T * _T}::DOUBLE - k12 * k12) ELSE 0 END AS bb FROM e2),
f2 AS (SELECT id, val - b1 * coalesce(val1, 0) - bb * coalesce(val2, 0) AS u, {_T}::DOUBLE - b1 * coalesce(k1, 0) - bb * coalesce(k2, 0) AS f FROM b2)"""


def _rows_of_factors(spark, sf, m):
    at = cut(_ordered(spark, sf))
    return neighbours.factor_table(neighbours.lists_of(_neighbours(spark, sf, m, at), at), m, _T, 1 / DECAY, NUGGET / _T)


@query("nngp_m2_factors", f"WITH {S}, {_ORDERED}, {_M2} SELECT id AS i, round(f, 5) AS f, round(u, 4) AS u FROM f2")
def nngp_m2_factors(spark, sf):
    return _rows_of_factors(spark, sf, 2).select(F.col("cell_id").alias("i"), r("f", 5).alias("f"), r("u", 4).alias("u"))


@query("nngp_m2_quadform", f"WITH {S}, {_ORDERED}, {_M2} SELECT round(sum(u * u / f), 3) AS q FROM f2")
def nngp_m2_quadform(spark, sf):
    return _rows_of_factors(spark, sf, 2).agg(F.round(F.sum(F.col("u") * F.col("u") / F.col("f")), 3).alias("q"))


@query("logdet_m2", f"WITH {S}, {_ORDERED}, {_M2} SELECT round(sum(ln(f)), 5) AS logdet FROM f2")
def logdet_m2(spark, sf):
    return _rows_of_factors(spark, sf, 2).agg(r(F.sum(F.log("f")), 5).alias("logdet"))


@query("nngp_likelihood", None)
def nngp_likelihood(spark, sf):
    """Quadratic form, log determinant and log likelihood with 15 neighbours, a row."""
    q, d, n = F.sum(F.col("u") * F.col("u") / F.col("f")), F.sum(F.log("f")), F.count("*")
    return _rows_of_factors(spark, sf, 15).agg(q.alias("q"), d.alias("logdet"), (-0.5 * (q + d + n * math.log(2 * math.pi))).alias("loglik"))


@query(
    "argmax_grid",
    f"""WITH {S}, {_VARIO}, fit AS (SELECT a, b, -sum(pow(gamma - ((1 - exp(sqrt(lx * lx + ly * ly) * (-1 / (2.0::DOUBLE * (a + 1))))) * (20.0::DOUBLE + 5 * b) + 0.5::DOUBLE), 2)) AS ll
      FROM vg, range(20) x(a), range(10) y(b) WHERE {_DIRECTION} IS NOT NULL GROUP BY a, b)
    SELECT arg_max(a, ll) AS a, arg_max(b, ll) AS b, round(max(ll), 4) AS ll FROM fit""",
)
def argmax_grid(spark, sf):
    """The range 2 (a + 1) and the sill 20 + 5 b whose exponential variogram is nearest to the lattice's, of a grid of 200."""
    grid = _directions(spark, sf).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    miss = F.col("gamma") - ((1 - F.exp(F.col("h") * (-1 / (F.lit(2.0) * (F.col("a") + 1))))) * (F.lit(20.0) + 5 * F.col("b")) + 0.5)
    ll = grid.groupBy("a", "b").agg((-F.sum(miss * miss)).alias("ll"))
    return ll.agg(F.max_by(F.struct("a", "b"), "ll").alias("p"), F.max("ll").alias("ll")).select("p.a", "p.b", F.round("ll", 4).alias("ll"))
