"""Scores, variograms, agreement, least squares and other sums over lattices. All combine partially before a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scores as S


def score_table(predictions: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, CRPS, interval score, coverage, bias and ignorance by group, in one pass; rows without truth do not count.

    predictions: mean, sd, truth and the columns of by.
    """
    m, s, y = F.col("mean"), F.col("sd"), F.col("truth")
    return (
        predictions.where(y.isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"), F.avg(S.absolute_error(m, s, y)).alias("mae"), F.sqrt(F.avg(S.squared_error(m, s, y))).alias("rmse"), F.avg(S.crps(m, s, y)).alias("crps"),
            F.avg(S.interval_score(m, s, y)).alias("intscore"), F.avg(S.covered(m, s, y)).alias("coverage"), F.avg(m - y).alias("bias"), F.avg(S.ignorance(m, s, y)).alias("ign"),
        )
    )


def equal_width_bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed bins of equal width, 1 to bins; the lowest value is in the first."""
    return F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((v - low) / ((high - low) / bins)))).cast("int")


def rank_methods(scores: DataFrame, metrics: list[str], order: str = "method") -> DataFrame:
    """Long rows (method, metric, value, rank): ascending, coverage by its distance from 0.95, ties in the given order."""
    near = F.when(F.col("metric") == "coverage", F.abs(F.col("value") - 0.95)).otherwise(F.col("value"))
    long = scores.unpivot([order], metrics, "metric", "value").withColumn("by", near)
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy("by", order))).drop("by")


def variogram(df: DataFrame, lags: list[tuple[int, int]], value: str, half: bool = False, side: int = 128) -> DataFrame:
    """Mean squared difference (or its half) and number of pairs at each lag (not negative in x); missing values drop out.

    Cells are dealt once to square tiles as wide as the longest lag or wider, and to the tiles whose cells they are ahead
    of by a lag. A tile takes its differences as those of shifted arrays and hands on sums: a row for each lag.
    """
    reach = max(max(abs(a), abs(b)) for a, b in lags)
    side = max(side, reach)

    def own(f: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(f["tx"].iloc[0]), int(f["ty"].iloc[0])
        v = np.full((side + reach, side + 2 * reach), np.nan)  # the tile, what is ahead in x and what is around in y
        v[f["ix"] - tx * side, f["iy"] - ty * side + reach] = f["v"]
        here = v[:side, reach : reach + side]
        rows = []
        for a, b in lags:
            miss = here - v[a : a + side, reach + b : reach + b + side]
            rows.append((a, b, int(np.isfinite(miss).sum()), float(np.nansum(miss * miss))))
        return pd.DataFrame(rows, columns=["lx", "ly", "pairs", "ss"])

    tile = lambda c, d: F.floor((F.col(c) + d) / side)
    rows = df.where(F.col(value).isNotNull()).select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("tx", F.explode(F.sequence(tile("ix", -reach), tile("ix", 0)))).withColumn("ty", F.explode(F.sequence(tile("iy", -reach), tile("iy", reach))))
    sums = rows.groupBy("tx", "ty").applyInPandas(own, "lx int, ly int, pairs long, ss double").groupBy("lx", "ly").agg(F.sum("pairs").alias("pairs"), F.sum("ss").alias("ss"))
    return sums.where("pairs > 0").select("lx", "ly", "pairs", (F.col("ss") / F.col("pairs") * (0.5 if half else 1.0)).alias("gamma"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two labellings from their contingency table (a, b, n)."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2.0
    both = table.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("total"))
    rows = table.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("pa"))
    columns = table.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("pb"))
    one = both.join(F.broadcast(rows)).join(F.broadcast(columns))  # a row each
    expected = F.col("pa") * F.col("pb") / F.nullif(pairs("total"), F.lit(0.0))
    return one.select(((F.col("both") - expected) / F.nullif((F.col("pa") + F.col("pb")) / 2 - expected, F.lit(0.0))).alias("ari"))


def weighted_quantiles(draws: DataFrame, by: str, probabilities: list[float]) -> DataFrame:
    """For each group of weighted draws (value, weight; weights sum to one) the first value whose running weight reaches p."""
    run = Window.partitionBy(by).orderBy("value", "draw").rowsBetween(Window.unboundedPreceding, 0)
    cum = draws.withColumn("cum", F.sum("weight").over(run))
    return cum.groupBy(by).agg(*[F.min(F.when(F.col("cum") >= p - 1e-9, F.col("value"))).alias(f"q{round(p * 1000)}") for p in probabilities])


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j and sum of products of the columns i <= j, in one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"`{a}|{b}`").alias("v")) for a, b in pairs])
    return sums.select(F.explode(each).alias("x")).select("x.*")


def ols_plane(df: DataFrame, x: str, y: str, v: str) -> DataFrame:
    """b0, b1, b2 and r2 of v on x and y by least squares from centred sums."""
    known = df.where(F.col(v).isNotNull())
    m = known.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv"))
    dx, dy, dv = F.col(x) - F.col("mx"), F.col(y) - F.col("my"), F.col(v) - F.col("mv")
    s = known.join(F.broadcast(m)).agg(
        F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"), F.sum(dx * dy).alias("xy"), F.sum(dx * dv).alias("xv"), F.sum(dy * dv).alias("yv"), F.sum(dv * dv).alias("vv"),
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("mv").alias("mv"),
    )
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    s = s.withColumn("b1", (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det).withColumn("b2", (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det)
    return s.select((F.col("mv") - F.col("b1") * F.col("mx") - F.col("b2") * F.col("my")).alias("b0"), "b1", "b2", ((F.col("b1") * F.col("xv") + F.col("b2") * F.col("yv")) / F.nullif("vv", F.lit(0.0))).alias("r2"))


def chain_factors(edges: DataFrame, variance: float, decay: float, nugget: float) -> DataFrame:
    """Factors of a nearest-neighbour process with one neighbour: i, j, b and f from edges (i, j, d)."""
    c = F.exp(F.col("d") * -decay) * variance
    return edges.select("i", "j", (c / (variance + nugget)).alias("b"), (F.lit(variance + nugget) - c * c / (variance + nugget)).alias("f"))


def linkage(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """By pair of different clusters (c1 < c2): complete, single and average linkage of the edges between them."""
    a, b = clusters.select(F.col("cell_id").alias("src"), F.col("cluster").alias("ca")), clusters.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("cb"))
    pairs = edges.join(a, "src").join(b, "dst").where("ca <> cb").select(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2"), "change")
    return pairs.groupBy("c1", "c2").agg(F.max("change").alias("complete"), F.min("change").alias("single"), F.avg("change").alias("average"), F.count("*").alias("edges"))


def ward_costs(edges: DataFrame, clusters: DataFrame, value: str) -> DataFrame:
    """By pair of touching clusters the rise of the within-cluster sum of squares if they merge."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    touching = linkage(edges, clusters).select("c1", "c2")
    one, two = (size.select(F.col("cluster").alias(c), F.col("n").alias(f"n{i}"), F.col("m").alias(f"m{i}")) for i, c in ((1, "c1"), (2, "c2")))
    joined = touching.join(one, "c1").join(two, "c2")
    diff = F.col("m1") - F.col("m2")
    return joined.select("c1", "c2", (F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")) * diff * diff).alias("ward"))


def sum_blocks(df: DataFrame, by: str, blocks: str) -> DataFrame:
    """by and the elementwise sum of its arrays, vectors or matrices laid out flat; numbers are summed in Spark by place."""
    each = df.select(by, F.posexplode(blocks).alias("k", "x")).groupBy(by, "k").agg(F.sum("x").alias("x"))
    return each.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias(blocks))
