"""Connected components of a graph of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


#: Nodes that are met by broadcast are those with more than this many rows, or than a HUBS-th of all rows: HUBS at most.
LIGHT, HUBS = 64, 100_000


def with_node(rows: DataFrame, key: str, nodes: DataFrame, total: int) -> DataFrame:
    """rows (`total` or fewer) joined with the line (k, m, n) of their node `key`, which n of the rows have.

    The lines of hubs are broadcast, so a hub's rows stay in the tasks that hold them; the others are joined by shuffle.
    """
    most = max(LIGHT, total // HUBS)
    hubs = F.broadcast(nodes.where(F.col("n") > most))
    others = rows.join(hubs.select("k"), F.col(key) == F.col("k"), "left_anti").join(nodes.where(F.col("n") <= most), F.col(key) == F.col("k"))
    return rows.join(hubs, F.col(key) == F.col("k")).unionByName(others)


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root for every node that is not itself the smallest of its component; edges: a, b (loops are ignored).

    Large stars tie a node's larger neighbours to the smallest, small stars its smaller ones; the number of rounds is about
    the logarithm of the longest path. Every round is two aggregations and two joins, written; no node's edges are ever
    gathered, nor do those of a hub meet in one task. The rounds end when a round changes nothing.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.save(pairs, f"{name}-0")
    seen, turn = None, 0
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, turn = state, turn + 1
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy(F.col("x").alias("k")).agg(F.min("y").alias("m"), F.count("*").alias("n")).select("k", F.least("k", "m").alias("m"), "n")
        least = scratch.save(least, f"{name}-least-{turn}")
        large = with_node(both.where("y > x"), "x", least, 2 * state[0]).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{name}-large-{turn}")
        low = scratch.save(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-low-{turn}")
        small = with_node(large, "u", low, 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(low.select("k", "m")).distinct()
        pairs = scratch.save(small, f"{name}-{turn}")
        for kind in ("least", "large", "low"):
            scratch.drop(f"{name}-{kind}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
