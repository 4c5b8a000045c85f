"""Spatial joins written so that Spark plans them as equi-joins on integer keys or buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut


def rook_edges(df: DataFrame, value: str) -> DataFrame:
    """src, dst, d and change of each pair of rook neighbours (right and up), once each."""
    steps = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    here = df.select(F.col("cell_id").alias("src"), "ix", "iy", F.col(value).alias("v1"), F.explode(steps).alias("s"))
    here = here.select("src", "v1", (F.col("ix") + F.col("s.dx")).alias("kx"), (F.col("iy") + F.col("s.dy")).alias("ky"))
    there = df.select(F.col("cell_id").alias("dst"), F.col("ix").alias("kx"), F.col("iy").alias("ky"), F.col(value).alias("v2"))
    return here.join(there, ["kx", "ky"]).select("src", "dst", F.lit(1.0).alias("d"), F.abs(F.col("v1") - F.col("v2")).alias("change"))


def _bucketed(df: DataFrame, side: float, x: str, y: str) -> DataFrame:
    return df.withColumns({"bx": F.floor(F.col(x) / side), "by": F.floor(F.col(y) / side)})


def radius_join(left: DataFrame, right: DataFrame, radius: float, keep: Column | None = None) -> DataFrame:
    """i, j and squared distance d2 of points (id, x, y) of the two sides within the radius.

    Both sides get square buckets as wide as the radius; the left side looks into the nine around it. `keep` is a further
    condition on i and j. A dense bucket is met by the rows of nine buckets only; AQE splits the join where one is heavy.
    """
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    a = _bucketed(left.select(F.col("id").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1")), radius, "x1", "y1")
    a = a.withColumn("o", F.explode(around)).withColumns({"bx": F.col("bx") + F.col("o.dx"), "by": F.col("by") + F.col("o.dy")}).drop("o")
    b = _bucketed(right.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2")), radius, "x2", "y2")
    d2 = ((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2"))).cast("double")
    pairs = a.join(b, ["bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    pairs = pairs if keep is None else pairs.where(keep)
    return pairs.select("i", "j", "d2")


def nearest(left: DataFrame, right: DataFrame, k: int, start: float, most: float, keep: Column | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """i, rank, j, d2: the k nearest right points of each left point, ties by smaller j.

    Points are looked for within a radius that doubles for those that found too few; whoever has k within the radius has
    its k nearest. wanted (i, need): how many a point can have at all, where that is less than k. `most` is the diameter:
    at that radius all pairs have been seen. Each round handles only the points that are left.
    """
    found, radius = [], start
    ids = left
    top = Window.partitionBy("i").orderBy("d2", "j")
    while True:
        pairs = radius_join(ids, right, radius, keep)
        ranked = pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        ranked = cut(ranked)
        if radius >= most:
            found.append(ranked)
            break
        counts = ranked.groupBy("i").agg(F.max("rank").alias("has"))
        if wanted is None:
            full = counts.where(F.col("has") >= k).select("i")
        else:
            full = wanted.join(counts, "i", "left").where(F.coalesce("has", F.lit(0)) >= F.least(F.lit(k), F.col("need"))).select("i")
        found.append(ranked.join(full, "i", "left_semi"))
        ids = cut(ids.join(full, F.col("id") == F.col("i"), "left_anti"))
        if ids.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionByName, found).select("i", "rank", "j", "d2")


def ordered_neighbours(points: DataFrame, m: int, start: float, most: float) -> DataFrame:
    """i, rank, j, d2: of each point (id from 0 in order) the min(id, m) nearest among those before it."""
    wanted = points.select(F.col("id").alias("i"), F.col("id").cast("long").alias("need"))
    return nearest(points, points, m, start, most, F.col("j") < F.col("i"), wanted)


def reverse_neighbours(edges: DataFrame) -> DataFrame:
    """j, users (how many have j as a neighbour), and the smallest and largest of these."""
    return edges.groupBy("j").agg(F.count("*").alias("users"), F.min("i").alias("first_user"), F.max("i").alias("last_user"))


def reverse_lists(edges: DataFrame, part: int = 1000) -> DataFrame:
    """j, part and the sorted array of the points that have j as a neighbour, in parts of at most `part` of them.

    A point that many name (the first in an order is a neighbour of all near it) thus never makes one long row.
    """
    place = F.row_number().over(Window.partitionBy("j").orderBy("i")) - 1
    rows = edges.select("j", "i").withColumn("part", F.floor(place / part).cast("int"))
    return rows.groupBy("j", "part").agg(F.sort_array(F.collect_list("i")).alias("users"))


def cross_distances(points: DataFrame, places: list[tuple[int, float, float]]) -> DataFrame:
    """i, j, d: the distance of every point (id, x, y) to each of a short list of places (knots, centres), without a join."""
    at = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(x)).alias("x2"), F.lit(float(y)).alias("y2")) for j, x, y in places])
    each = points.select(F.col("id").alias("i"), "x", "y", F.explode(at).alias("p"))
    dx, dy = F.col("x") - F.col("p.x2"), F.col("y") - F.col("p.y2")
    return each.select("i", F.col("p.j").alias("j"), F.sqrt(dx * dx + dy * dy).alias("d"))


def nearest_centre(points: DataFrame, centres: list[tuple[int, float, float]], x: str = "ix", y: str = "iy") -> DataFrame:
    """The points with centre and d2 of the nearest of a short list of centres (the first wins a tie).

    The centres are literals of the plan, so each row finds its nearest by itself: no join, no shuffle.
    """
    away = lambda cx, cy: (F.col(x) - cx) * (F.col(x) - cx) + (F.col(y) - cy) * (F.col(y) - cy)
    each = [F.struct(away(cx, cy).cast("double").alias("d2"), F.lit(i).alias("centre")) for i, cx, cy in centres]
    best = F.array_min(F.array(*each))
    return points.withColumn("__best", best).withColumns({"centre": F.col("__best.centre"), "d2": F.col("__best.d2")}).drop("__best")


def nearest_kept_centre(points: DataFrame, centres: list[tuple[int, float, float]], value: str, x: str = "ix", y: str = "iy") -> DataFrame:
    """nearest_centre() among the centres that some point with a value is nearest to; the points of the others are re-assigned.

    Counting is one aggregation; the few ids of the centres that stay reach the driver.
    """
    used = nearest_centre(points, centres, x, y).where(F.col(value).isNotNull()).select("centre").distinct()
    kept = {r["centre"] for r in used.collect()}
    return nearest_centre(points, [c for c in centres if c[0] in kept] or centres, x, y)


def tiles(nx: int, ny: int, levels: int, x0: int = 0, y0: int = 0) -> list[dict]:
    """A binary tree of tiles: each level halves the longer side (x on ties). Half-open boxes, closed at the far edge."""
    out, row = [], [(1, float(x0), float(x0 + nx), float(y0), float(y0 + ny))]
    for level in range(levels + 1):
        for t, (i, xa, xb, ya, yb) in enumerate(row):
            out.append({"id": i, "level": level, "tile": t, "parent": i // 2 if level else None, "xmin": xa, "xmax": xb, "ymin": ya, "ymax": yb})
        halves = []
        for i, xa, xb, ya, yb in row:
            if xb - xa >= yb - ya:
                halves += [(2 * i, xa, (xa + xb) / 2, ya, yb), (2 * i + 1, (xa + xb) / 2, xb, ya, yb)]
            else:
                halves += [(2 * i, xa, xb, ya, (ya + yb) / 2), (2 * i + 1, xa, xb, (ya + yb) / 2, yb)]
        row = halves
    return out


def tile_of(nx: int, ny: int, levels: int, x0: int = 0, y0: int = 0, x: str = "ix", y: str = "iy") -> Column:
    """The id of the leaf tile that holds a point, by halving inside one expression: a range join without a join."""
    tile, xa, xb, ya, yb = F.lit(1), F.lit(float(x0)), F.lit(float(x0 + nx)), F.lit(float(y0)), F.lit(float(y0 + ny))
    w, h = float(nx), float(ny)
    for _ in range(levels):
        if w >= h:
            mid = (xa + xb) / 2
            right = F.col(x) >= mid
            xa, xb, w = F.when(right, mid).otherwise(xa), F.when(right, xb).otherwise(mid), w / 2
        else:
            mid = (ya + yb) / 2
            right = F.col(y) >= mid
            ya, yb, h = F.when(right, mid).otherwise(ya), F.when(right, yb).otherwise(mid), h / 2
        tile = tile * 2 + right.cast("int")
    return tile


def tile_of_ways(nx: int, ny: int, levels: int, ways: int, x0: int = 0, y0: int = 0, x: str = "ix", y: str = "iy") -> Column:
    """The id of the leaf tile that holds a point, where a tile has `ways` parts: 2 halve the longer side; an even number from 4
    on cuts both sides into ways / 2, numbered with y fastest. The root is 1, the parts of a tile follow each other."""
    if ways == 2:
        return tile_of(nx, ny, levels, x0, y0, x, y)
    if ways < 4 or ways % 2:
        raise ValueError("ways: 2, or an even number from 4 on")
    side = ways // 2
    tile = F.lit(1).cast("long")
    for k in range(1, levels + 1):
        at = lambda c, low, n: F.least(F.lit(side**k - 1), F.floor((F.col(c) - low) * F.lit(side**k / n))) % side
        tile = tile * side * side + at(x, x0, nx) * side + at(y, y0, ny)
    return tile


def ancestors(tile: Column, levels: Column) -> Column:
    """The ids from the root to the parent of a tile that lies `levels` below the root."""
    return F.transform(F.sequence(levels, F.lit(1), F.lit(-1)), lambda k: F.floor(tile / F.pow(F.lit(2.0), k)).cast("int"))


def children(tile: Column) -> Column:
    """The ids of a tile's two halves."""
    return F.array(tile * 2, tile * 2 + 1)


def knots(n: int, low: float | Column, high: float | Column, offset: float) -> list:
    """n places between the borders (numbers or columns), the outer ones a fraction `offset` of the width inside."""
    width = high - low
    a, b = low + offset * width, high - offset * width
    return [a + i * (b - a) / (n - 1) for i in range(n)]
