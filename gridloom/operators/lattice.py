"""Lattice tables (cell_id, ix, iy, value; null: missing) and what is done to them cell by cell.

Every table carries its integer keys, so nothing depends on row order, and shifts are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The cell itself and twelve shifted copies: four rook and four diagonal neighbours, and the rooks at distance two.
SHIFTS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1), (2, 0), (-2, 0), (0, 2), (0, -2)]


def recode_sentinel(v: Column, sentinel) -> Column:
    return F.nullif(v, F.lit(sentinel))


def rescale(v: Column, factor: float = 0.02, shift: float = -273.15) -> Column:
    return v * factor + shift


def axis(i: Column, n: int | Column, low: float, high: float, descending: bool = False) -> Column:
    """The i-th of n equally spaced values from low to high."""
    step = (high - low) / (n - 1)
    return high - i * step if descending else low + i * step


def cross_axes(df: DataFrame, x: str = "ix", y: str = "iy") -> DataFrame:
    """Every pair of the values that the two axes have; an axis is one array, so no join is needed."""
    axes = df.agg(F.collect_set(x).alias("xs"), F.collect_set(y).alias("ys"))
    return axes.select(F.explode("xs").alias(x), "ys").repartition(x).select(x, F.explode("ys").alias(y))


def window_subset(df: DataFrame, x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """The cells of a rectangle (ends included), re-indexed from zero."""
    inside = df.where(F.col("ix").between(*x) & F.col("iy").between(*y))
    return inside.withColumns({"ix": F.col("ix") - x[0], "iy": F.col("iy") - y[0]})


def apply_mask(df: DataFrame, mask: DataFrame, value: str = "truth") -> DataFrame:
    """value becomes null where the mask (cell_id, masked) says so."""
    joined = df.join(mask.select("cell_id", "masked"), "cell_id", "left")
    return joined.withColumn("val", F.when(~F.coalesce("masked", F.lit(False)), F.col(value))).drop("masked")


def missing_share(df: DataFrame, value: str = "val") -> DataFrame:
    gone = F.col(value).isNull()
    return df.agg(F.count("*").alias("cells"), F.count_if(gone).alias("missing"), F.avg(gone.cast("double")).alias("share"))


def holdout(df: DataFrame, share: float, seed: int, value: str = "truth") -> DataFrame:
    """round(share * n) cells chosen by a hash of the id become null; exact in number, the same in every run."""
    placed = random_places(df.select("cell_id", F.col(value).alias("__v")), seed)
    held = placed.withColumn("masked", F.col("place") < F.round(F.col("total") * share))
    return df.join(held.select("cell_id", "masked"), "cell_id").withColumn("val", F.when(~F.col("masked"), F.col(value))).drop("masked")


def to_matrix(df: DataFrame, value: str, nx: int) -> DataFrame:
    """A row for each iy with nx columns; for small lattices only."""
    return df.groupBy("iy").pivot("ix", list(range(nx))).agg(F.first(value)).orderBy("iy")


def shifted(df: DataFrame, value: str, nx: int, ny: int, x0: int = 0, y0: int = 0, shifts: list[tuple[int, int]] = SHIFTS) -> DataFrame:
    """Rows (cell_id, ix, iy, img, v): for each shift the value at the shifted cell, edges repeated.

    Targets are clamped indices, so the copies are one equi-join on (ix, iy) against the lattice.
    """
    moves = F.array(*[F.struct(F.lit(i).alias("img"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(shifts)])
    at = df.select("cell_id", "ix", "iy", F.explode(moves).alias("m"))
    clamp = lambda c, d, low, n: F.greatest(F.lit(low), F.least(F.lit(low + n - 1), F.col(c) + F.col(d)))
    at = at.select("cell_id", "ix", "iy", "m.img", clamp("ix", "m.dx", x0, nx).alias("sx"), clamp("iy", "m.dy", y0, ny).alias("sy"))
    source = df.select(F.col("ix").alias("sx"), F.col("iy").alias("sy"), F.col(value).alias("v"))
    return at.join(source, ["sx", "sy"], "left").select("cell_id", "ix", "iy", "img", "v")


def clip_to_observed(df: DataFrame, column: str, observed: str) -> DataFrame:
    """column held within the range of the observed values (one row, broadcast)."""
    ends = df.agg(F.min(observed).alias("__low"), F.max(observed).alias("__high"))
    held = F.when(F.col(column).isNotNull(), F.greatest("__low", F.least("__high", F.col(column))))
    return df.join(F.broadcast(ends)).withColumn(column, held).drop("__low", "__high")


def fill_in(df: DataFrame, predictions: DataFrame, value: str = "val") -> DataFrame:
    """The observed value, and where it is missing the prediction (cell_id, mean)."""
    return df.join(predictions.select("cell_id", "mean"), "cell_id", "left").withColumn("filled", F.coalesce(value, "mean")).drop("mean")


def column_order(df: DataFrame) -> DataFrame:
    """The place of each cell within its ix, iy descending."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("ix").orderBy(F.desc("iy"))))


def unit_cube(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1 by its range over all rows."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda c: F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0)).cast("double")
    scaled = df.join(F.broadcast(ends)).withColumns({c: (F.col(c) - F.col(f"__lo_{c}")) / span(c) for c in columns})
    return scaled.select(*df.columns)


def midrange_centre(df: DataFrame, columns: list[str]) -> DataFrame:
    ends = df.agg(*[((F.min(c) + F.max(c)) / 2).alias(f"__mid_{c}") for c in columns])
    return df.join(F.broadcast(ends)).withColumns({c: F.col(c) - F.col(f"__mid_{c}") for c in columns}).select(*df.columns)


def zscore_poly2(df: DataFrame, x: str, y: str) -> DataFrame:
    """Standardised x and y with their raw second-degree polynomial."""
    m = df.agg(F.avg(x).alias("__mx"), F.stddev_samp(x).alias("__sx"), F.avg(y).alias("__my"), F.stddev_samp(y).alias("__sy"))
    out = df.join(F.broadcast(m)).withColumns({"zx": (F.col(x) - F.col("__mx")) / F.col("__sx"), "zy": (F.col(y) - F.col("__my")) / F.col("__sy")})
    out = out.withColumns({"zx2": F.col("zx") * F.col("zx"), "zxy": F.col("zx") * F.col("zy"), "zy2": F.col("zy") * F.col("zy")})
    return out.drop("__mx", "__sx", "__my", "__sy")


def extent(df: DataFrame, x: str = "ix", y: str = "iy") -> DataFrame:
    """The bounding box, the least spacing along x and the length of the diagonal."""
    xs = df.select(F.col(x).alias("x")).distinct()
    gap = xs.withColumn("gap", F.col("x") - F.lag("x").over(Window.orderBy("x"))).agg(F.min("gap").alias("spacing"))  # axis values only
    box = df.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))
    across = F.sqrt(F.pow((F.col("xmax") - F.col("xmin")).cast("double"), F.lit(2.0)) + F.pow((F.col("ymax") - F.col("ymin")).cast("double"), F.lit(2.0)))
    return box.join(F.broadcast(gap)).withColumn("diagonal", across)


def occupancy(train: DataFrame, validation: DataFrame, missing: DataFrame) -> DataFrame:
    """How many cells have each code: 1 in training, 2 in validation, 4 missing, sums where sets overlap."""
    parts = [d.select("cell_id", F.lit(code).alias("code")) for d, code in ((train, 1), (validation, 2), (missing, 4))]
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("cell_id").agg(F.sum("code").alias("code"))
    return cells.groupBy("code").agg(F.count("*").alias("cells"))


def split_observed(df: DataFrame, value: str = "val") -> tuple[DataFrame, DataFrame]:
    """Observed and missing cells."""
    return df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())


BUCKETS = 1024


def _places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a bucket __b that follows the order) with `place` from 0 in order, and `total`.

    A bucket's start comes from the few bucket sizes, so no task orders all rows.
    """
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__b")
    sizes = sizes.withColumn("__before", F.sum("__n").over(ahead) - F.col("__n")).withColumn("total", F.sum("__n").over(Window.partitionBy()))  # a row a bucket
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return rows.join(F.broadcast(sizes), "__b").withColumn("place", place).drop("__b", "__n", "__before")  # BUCKETS rows at most


def random_places(df: DataFrame, seed: int, key: str = "cell_id") -> DataFrame:
    """df with each row's place in a random order that the key and the seed fix, and the number of rows (`total`)."""
    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__b", F.pmod(F.shiftright("__h", 20), F.lit(BUCKETS)))
    return _places(rows, ["__h", key]).drop("__h")


def ordered_places(df: DataFrame, key: str = "cell_id") -> DataFrame:
    """df with each row's place in the order of an integer key, and the number of rows (`total`)."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(1, ((high or 0) - (low or 0)) // BUCKETS + 1)
    return _places(df.withColumn("__b", F.expr(f"({key} - {low or 0}) div {width}")), [key])


def exact_split(df: DataFrame, parts: int, seed: int, key: str = "cell_id") -> DataFrame:
    """Disjoint random parts of floor(n / parts) rows, the rest in the last; column `part` from 0."""
    each = F.greatest(F.lit(1), F.expr(f"total div {parts}"))
    placed = random_places(df, seed, key)
    return placed.withColumn("part", F.least(F.lit(parts - 1), F.floor(F.col("place") / each)).cast("int")).drop("place", "total")
