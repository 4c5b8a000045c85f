"""Agglomerative clustering of lattice cells along edges, in rounds of grouped edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.session import cut

LINKAGES = ("ward", "single", "complete", "average")


def agglomerate(df: DataFrame, clusters: int, value: str = "truth", linkage: str = "ward") -> DataFrame:
    """cell_id and cluster (its smallest cell) after merging touching clusters until `clusters` are left, or none touch.

    Every cell starts by itself. An edge between clusters carries the gradients of the cell edges that it stands for: their
    least, greatest and sum, and their number; its cost is that linkage, or by Ward the rise of the sum of squares. In a round
    pairs of clusters that are each other's best neighbour merge; for these linkages such pairs would merge in a sequential
    run too, whatever their order. The last round takes only the cheapest pairs. A round is a few joins and sums over the
    edges left, written to cut lineage. Rounds are about the logarithm of the cells where clusters grow evenly, as Ward's do;
    a linkage that grows one giant merges little in a round and takes many.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage: one of {', '.join(LINKAGES)}")
    cells = cut(df.where(F.col(value).isNotNull()).select("cell_id", "ix", "iy", F.col(value).cast("double").alias("v")))
    edges = J.rook_edges(cells, "v").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *[F.col("change").alias(c) for c in ("low", "high", "total")], F.lit(1).cast("long").alias("n"))
    edges = cut(edges)
    sizes = cut(cells.select(F.col("cell_id").alias("cluster"), F.lit(1.0).alias("count"), "v"))  # v: the mean
    members = cells.select("cell_id", F.col("cell_id").alias("cluster"))
    left, turn = sizes.count(), 0
    while left > clusters:
        rows = edges
        if linkage == "ward":
            side = lambda k: sizes.select(F.col("cluster").alias(k), F.col("count").alias(f"n{k}"), F.col("v").alias(f"v{k}"))
            rows = rows.join(side("a"), "a").join(side("b"), "b")
            cost = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * (F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb"))
        else:
            cost = {"single": F.col("low"), "complete": F.col("high"), "average": F.col("total") / F.col("n")}[linkage]
        rows = rows.withColumn("cost", cost)
        best = rows.select(F.explode(F.array("a", "b")).alias("x"), F.struct("cost", "a", "b").alias("e")).groupBy("x").agg(F.min("e").alias("e"))
        pairs = cut(best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.a", "e.b", "e.cost"))
        n = pairs.count()
        if not n:
            break
        if left - n < clusters:
            n = left - clusters
            pairs = cut(pairs.orderBy("cost", "a", "b").limit(n))
        left, turn = left - n, turn + 1
        to = pairs.select(F.col("b").alias("old"), F.col("a").alias("new"))
        renamed = lambda d, c: d.join(to.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        members = renamed(members, "cluster").select("cell_id", "cluster")
        members = cut(members) if turn % 4 == 0 else members
        grown = renamed(sizes, "cluster").groupBy("cluster").agg(F.sum("count").alias("count"), (F.sum(F.col("count") * F.col("v")) / F.sum("count")).alias("v"))
        sizes = cut(grown.select("cluster", "count", "v")) if linkage == "ward" else sizes
        moved = renamed(renamed(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "low", "high", "total", "n")
        edges = cut(moved.groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("n").alias("n")))
    return members
