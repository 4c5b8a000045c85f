"""Clusters by cutting a spanning forest of the lattice's gradient edges.

The least spanning forest, its Euler tour and the sums under every tree edge are each found by contraction: a task works on a
square tile and decides what its own edges suffice to decide, what is left meets in tiles four times as wide, and so on.
Rounds are thus the logarithm of the lattice's side, and what a tile passes on is about as large as its border.

A node is a long made of a cell's ix and iy, so that a tile is an expression of the node and needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

TILE_SIDE = 128
GROWTH = 4
_BITS = 32
_EDGE = "a long, b long, w double, u long, v long"
_ARC = "src long, dst long, nsrc long, ndst long, len long, n long, s double, w double"
_HEAD = "src long, dst long, root long, pos long, n0 long, s0 double, all_n long, all_s double"
#: Node counts under an edge are sums of parts of a node, of which a degree of 1 to 4 gives whole numbers.
PARTS = 12


def nodes_of(df: DataFrame, value: str) -> DataFrame:
    """cell_id, node and v of the cells that have a value."""
    known = df.where(F.col(value).isNotNull())
    x0, y0 = known.agg(F.min("ix"), F.min("iy")).first()
    place = F.shiftleft((F.col("ix") - F.lit(x0 or 0)).cast("long"), _BITS) + (F.col("iy") - F.lit(y0 or 0))
    return known.select("cell_id", place.alias("node"), F.col(value).cast("double").alias("v"))


def _home(node: str | Column, side: int) -> Column:
    node = F.col(node) if isinstance(node, str) else node
    row = F.floor(F.shiftright(node, _BITS) / side)
    return F.shiftleft(row, _BITS) + F.floor(node.bitwiseAND(2**_BITS - 1) / side)


def gradient_edges(nodes: DataFrame) -> DataFrame:
    """a < b and the size w of the change, for cells that touch side by side."""
    right = nodes.select(F.col("node").alias("a"), F.col("v").alias("va"), F.explode(F.array(F.col("node") + 2**_BITS, F.col("node") + 1)).alias("b"))
    return right.join(nodes.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", F.abs(F.col("va") - F.col("vb")).alias("w"))


class Sets:
    """Disjoint sets with the smallest member as name."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x: int, y: int) -> int:
        low, high = min(x, y), max(x, y)
        self.up[high] = low
        return low


def decide(edges: list[tuple[float, int, int, int, int]], own: list[tuple[bool, bool]]) -> tuple[list[int], list[int], Sets]:
    """Of a tile's edges (w, a, b, u, v), in order: those surely in the least forest, and those that are open; and the tile's sets.

    own: for each edge whether its ends u and v are the tile's. In order of weight, an edge joins two sets if for one of
    them it is the least that leaves it, that is if no earlier edge left that set undecided or left the tile. An edge that
    closes a cycle with earlier ones is in no forest.
    """
    sets, perhaps, held = Sets(), Sets(), set()
    sure, left = [], []
    for i, ((_, _, _, u, v), (mine_u, mine_v)) in enumerate(zip(edges, own)):
        if not (mine_u and mine_v):
            held.add(sets.find(u if mine_u else v))
            left.append(i)
            continue
        x, y = sets.find(u), sets.find(v)
        p, q = perhaps.find(u), perhaps.find(v)
        if x == y or p == q:
            continue
        perhaps.join(p, q)
        if x in held and y in held:
            left.append(i)
            continue
        sure.append(i)
        blocked = x in held or y in held
        name = sets.join(x, y)
        if blocked:
            held.add(name)
    return sure, left, sets


def _deciding(side: int):
    """The function of a tile's edges that gives the forest's edges (without labels) and the open ones with the tile's labels."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["w", "a", "b"])
        place = lambda c: (f[c].to_numpy() >> _BITS) // side << _BITS | (f[c].to_numpy() & (2**_BITS - 1)) // side
        here = f["home"].iloc[0]
        own = list(zip((place("u") == here).tolist(), (place("v") == here).tolist()))
        rows = list(zip(*(f[c].tolist() for c in ("w", "a", "b", "u", "v"))))
        sure, left, sets = decide(rows, own)
        out = [(rows[i][1], rows[i][2], rows[i][0], None, None) for i in sure]
        for i in left:
            w, a, b, u, v = rows[i]
            out.append((a, b, w, sets.find(u) if own[i][0] else None, sets.find(v) if own[i][1] else None))
        return pd.DataFrame({c: pd.array([r[k] for r in out], "Int64" if k != 2 else "float64") for k, c in enumerate("abwuv")})

    return run


def spanning_forest(edges: DataFrame, side: int = TILE_SIDE) -> DataFrame:
    """a, b, w of the least spanning forest; of equal weights the edge with smaller ends counts as less."""
    work = cut(edges.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")))
    found: list[DataFrame] = []
    while True:
        homes = work.withColumn("home", F.explode(F.array_distinct(F.array(_home("u", side), _home("v", side)))))
        told = cut(homes.groupBy("home").applyInPandas(_deciding(side), _EDGE))
        found.append(told.where("u is null and v is null").select("a", "b", "w"))
        open_ = told.where("u is not null or v is not null").groupBy("a", "b").agg(F.first("w").alias("w"), F.max("u").alias("u"), F.max("v").alias("v"))
        ends = F.least("u", "v"), F.greatest("u", "v")
        least = open_.where("u <> v").groupBy(ends[0].alias("x"), ends[1].alias("y")).agg(F.min(F.struct("w", "a", "b", "u", "v")).alias("e"))
        work = cut(least.select("e.a", "e.b", "e.w", "e.u", "e.v"))
        side *= GROWTH
        if work.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def tour(forest: DataFrame, nodes: DataFrame) -> DataFrame:
    """The arcs of the forest, each with the one that follows it on a walk around its tree.

    An arc carries its share (one over the degree) of the node that it enters and of that node's value: all arcs that enter the
    nodes below a tree edge lie between the edge's two arcs, so sums along the walk give the sums below.
    """
    both = forest.select(F.col("a").alias("node"), F.col("b").alias("to"), "w").unionByName(forest.select(F.col("b").alias("node"), F.col("a").alias("to"), "w"))
    around = both.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("to", "w"))).alias("near")).join(nodes, "node")
    arcs = around.select("node", "v", F.size("near").alias("d"), "near", F.posexplode("near").alias("i", "x"))
    after = F.get("near", (F.col("i") + 1) % F.col("d"))["to"]
    return arcs.select(
        F.col("x.to").alias("src"), F.col("node").alias("dst"), F.col("node").alias("nsrc"), after.alias("ndst"),
        F.lit(1).cast("long").alias("len"), F.expr(f"{PARTS} div d").alias("n"), (F.col("v") / F.col("d")).alias("s"), F.col("x.w").alias("w"),
    )


def _chains(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[int], list[bool]]:
    """The rows in order along their chains, the chain of each, and by chain its first row and whether it is a whole cycle."""
    keys = list(zip(f["src"].tolist(), f["dst"].tolist()))
    ids = {x: i for i, x in enumerate(keys)}
    after = [ids.get(x, -1) for x in zip(f["nsrc"].tolist(), f["ndst"].tolist())]
    entered = np.zeros(len(f), bool)
    entered[[a for a in after if a >= 0]] = True
    order, chain, first, closed = [], [], [], []
    seen = np.zeros(len(f), bool)
    starts = [i for i in range(len(f)) if not entered[i]]
    for i in [*starts, *sorted(range(len(f)), key=keys.__getitem__)]:
        if seen[i]:
            continue
        at = i
        while at >= 0 and not seen[at]:
            seen[at] = True
            order.append(at)
            chain.append(len(first))
            at = after[at]
        first.append(i)
        closed.append(at == i)
    return np.array(order, np.int64), np.array(chain, np.int64), first, closed


def along(arcs: DataFrame, side: int = TILE_SIDE) -> DataFrame:
    """The arcs with their tree's root, their place on its walk, the sums before them, and the tree's whole sums.

    A tile makes one arc of each stretch that stays inside it; the stretches are placed in wider tiles, then the arcs inside. A
    walk that closes inside a tile starts at its smallest arc.
    """
    arcs = cut(arcs)

    def shorten(f: pd.DataFrame) -> pd.DataFrame:
        order, chain, first, closed = _chains(f)
        rows = f.iloc[order]
        sums = rows.assign(chain=chain).groupby("chain")[["len", "n", "s"]].sum()
        last = rows.assign(chain=chain).groupby("chain")[["nsrc", "ndst"]].last()
        head = f.iloc[first]
        return pd.DataFrame({"src": head["src"].to_numpy(), "dst": head["dst"].to_numpy(), "nsrc": last["nsrc"].to_numpy(), "ndst": last["ndst"].to_numpy(), "len": sums["len"].to_numpy(), "n": sums["n"].to_numpy(), "s": sums["s"].to_numpy(), "w": np.array(closed, float)})

    def spread(f: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        order, chain, first, _ = _chains(f)
        rows = f.iloc[order].reset_index(drop=True)
        key = dict(zip(zip(heads["src"].tolist(), heads["dst"].tolist()), range(len(heads))))
        at = np.array([key[x] for x in zip(f["src"].iloc[first].tolist(), f["dst"].iloc[first].tolist())], np.int64)[chain]
        held = heads.iloc[at].reset_index(drop=True)
        out = pd.DataFrame({"src": rows["src"], "dst": rows["dst"], "root": held["root"]})
        for name, of, start in (("pos", "len", "pos"), ("n0", "n", "n0"), ("s0", "s", "s0")):
            run = rows[of].groupby(chain).cumsum() - rows[of]
            out[name] = held[start] + run
        out["all_n"], out["all_s"] = held["all_n"], held["all_s"]
        return out

    homed = arcs.withColumn("home", _home("dst", side))
    short = cut(homed.groupBy("home").applyInPandas(shorten, _ARC))
    none = F.lit(0)
    heads = short.where("w = 1").select("src", "dst", F.col("src").alias("root"), none.cast("long").alias("pos"), none.cast("long").alias("n0"), none.cast("double").alias("s0"), F.col("n").alias("all_n"), F.col("s").alias("all_s"))
    rest = short.where("w = 0")
    if not rest.isEmpty():
        heads = heads.unionByName(along(rest, side * GROWTH))
    placed = homed.groupBy("home").cogroup(heads.withColumn("home", _home("dst", side)).groupBy("home"))
    return cut(placed.applyInPandas(spread, _HEAD))


def tree_nodes(forest: DataFrame, nodes: DataFrame, side: int = TILE_SIDE) -> DataFrame:
    """A row for each tree edge: the node below it, its root, the stretch (start, stop) of the walk below it, the number n and
    sum s of the nodes there, the same of its tree, and the edge's weight."""
    placed = along(tour(forest, nodes), side)
    ends = F.struct("pos", "dst", "n0", "s0")
    pairs = placed.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(ends).alias("down"), F.max(ends).alias("up"), F.first("root").alias("root"), F.first("all_n").alias("all_n"), F.first("all_s").alias("all_s"))
    below = pairs.select(
        "a", "b", F.col("down.dst").alias("node"), "root", F.col("down.pos").alias("start"), F.col("up.pos").alias("stop"),
        F.expr(f"(up.n0 - down.n0) div {PARTS}").alias("n"), (F.col("up.s0") - F.col("down.s0")).alias("s"), F.expr(f"all_n div {PARTS}").alias("all_n"), "all_s",
    )
    return cut(below.join(forest, ["a", "b"]))


@dataclass
class Cut:
    """A tree edge that was cut: its stretch, what its part held then, and the cut whose part it was taken from (-1: a tree)."""

    root: int
    start: int
    stop: int
    n: int
    s: float
    of: int = -1


def _cuts(cuts: list[Cut]) -> Column:
    """The cuts as constants; low and high are the stretch of the part that a cut was taken from."""
    whole = Cut(0, -1, 2**62, 0, 0.0)
    rows = []
    for k, c in enumerate(cuts):
        of = cuts[c.of] if c.of >= 0 else whole
        longs = {"start": c.start, "stop": c.stop, "root": c.root, "n": c.n, "low": of.start, "high": of.stop}
        rows.append(F.struct(*[F.lit(x).cast("long").alias(name) for name, x in longs.items()], F.lit(k).alias("k"), F.lit(c.s).alias("s"), F.lit(c.of).alias("of")))
    return F.array(*rows)


def _part(cuts: list[Cut]) -> Column:
    """The number of the innermost cut that a node is below, -1 if none."""
    if not cuts:
        return F.lit(-1)
    around = F.filter(_cuts(cuts), lambda c: (c["root"] == F.col("root")) & (c["start"] <= F.col("start")) & (F.col("stop") <= c["stop"]))
    return F.coalesce(F.array_max(F.transform(around, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"))))["k"], F.lit(-1))


def _gains(below: DataFrame, cuts: list[Cut]) -> DataFrame:
    """below with the part that each edge is in, what its lower side now holds, and by how much a cut lowers the sum of squares."""
    rows = below.withColumn("part", _part(cuts))
    n, s, all_n, all_s = (F.col(c) for c in ("n", "s", "all_n", "all_s"))
    if cuts:
        every = _cuts(cuts)
        here = F.get(every, F.when(F.col("part") >= 0, F.col("part")))
        gone = F.filter(every, lambda c: (c["root"] == F.col("root")) & (c["of"] == F.col("part")))
        # taken from below this edge while both were in one part
        under = F.filter(every, lambda c: (c["root"] == F.col("root")) & (F.col("start") < c["start"]) & (c["stop"] < F.col("stop")) & (c["low"] <= F.col("start")) & (F.col("stop") <= c["high"]))
        total = lambda x, f, zero: F.aggregate(x, zero, lambda t, c: t + c[f])
        zero, none = F.lit(0).cast("long"), F.lit(0.0)
        n, s = n - total(under, "n", zero), s - total(under, "s", none)
        all_n = F.coalesce(here["n"], all_n) - total(gone, "n", zero)
        all_s = F.coalesce(here["s"], all_s) - total(gone, "s", none)
    rows = rows.select("root", "start", "stop", "part", n.alias("n"), s.alias("s"), (all_n - n).alias("m"), (all_s - s).alias("r"))
    apart = F.col("s") / F.col("n") - F.col("r") / F.col("m")
    return rows.where("n > 0 and m > 0").withColumn("gain", F.col("n") * F.col("m") / (F.col("n") + F.col("m")) * apart * apart)


def divisive(df: DataFrame, clusters: int, value: str = "truth", method: str = "ward", side: int = TILE_SIDE) -> DataFrame:
    """cell_id and cluster (its smallest cell) after splitting touching cells until there are `clusters` clusters.

    Clusters start as the trees of the least spanning forest of the gradients, one for each region of touching cells. method
    "single" cuts the forest's largest gradients; "ward" cuts, again and again, the tree edge that lowers the sum of squares
    most. A cut takes what its stretch of the walk holds away from the edges above it, so a split is one scan of the edges
    with the few cuts so far as constants; `clusters` is meant to be hundreds at most. Cells without a value are left out.
    """
    if method not in ("ward", "single"):
        raise ValueError("method: ward or single")
    nodes = cut(nodes_of(df, value))
    forest = cut(spanning_forest(gradient_edges(nodes), side))
    below = tree_nodes(forest, nodes, side)
    splits = clusters - (nodes.count() - forest.count())
    cuts: list[Cut] = []
    if method == "single" and splits > 0:
        for e in below.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(splits).collect():
            cuts.append(Cut(e.root, e.start, e.stop, e.n, e.s))
    while method == "ward" and len(cuts) < splits:
        best = _gains(below, cuts).agg(F.max(F.struct("gain", "root", "start", "stop", "part", "n", "s")).alias("e")).first()["e"]
        if best is None:
            break
        cuts.append(Cut(best["root"], best["start"], best["stop"], best["n"], best["s"], best["part"]))
    labels = below.select("node", "root", _part(cuts).alias("part"))
    rows = nodes.join(labels, "node", "left").select("cell_id", F.coalesce("root", "node").alias("root"), F.coalesce("part", F.lit(-1)).alias("part"))
    names = rows.groupBy("root", "part").agg(F.min("cell_id").alias("cluster"))
    return rows.join(names, ["root", "part"]).select("cell_id", "cluster")
