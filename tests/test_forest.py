"""Divisive clusters, the spanning forest and the walk around it against brute force."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.models import clusters, forest

SCHEMA = "cell_id long, ix int, iy int, truth double, w int"


def lattice(nx, ny, seed, ties=False, gaps=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for ix, iy in itertools.product(range(-2, nx - 2), range(3, ny + 3)):
        v = float(rng.integers(0, 4)) if ties else float(rng.normal() + 3 * (ix > nx // 3) + 2 * (iy > ny // 2))
        rows.append((1000 * iy + ix, ix, iy, None if rng.random() < gaps else v, 1))
    return rows


def kruskal(rows):
    at = {(r[1], r[2]): r[3] for r in rows if r[3] is not None}
    edges = sorted((abs(v - at[q]), p, q) for p, v in at.items() for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in at)
    up = {p: p for p in at}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    tree = []
    for w, p, q in edges:
        a, b = find(p), find(q)
        if a != b:
            up[a] = b
            tree.append((w, p, q))
    return at, tree


def sides(at, tree):
    near = defaultdict(set)
    for _, p, q in tree:
        near[p].add(q)
        near[q].add(p)
    seen, out = set(), []
    for p in at:
        if p not in seen:
            group, todo = set(), [p]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += near[x]
            seen |= group
            out.append(group)
    return out


def brute(rows, k, method):
    at, tree = kruskal(rows)
    while (left := k - len(sides(at, tree))) > 0 and tree:
        if method == "single":
            tree = sorted(tree)[:-left]
            continue
        whole = {p: g for g in map(frozenset, sides(at, tree)) for p in g}
        best = None
        for e in tree:
            rest = [x for x in tree if x != e]
            part = {p: g for g in map(frozenset, sides(at, rest)) for p in g}
            a, b = ([at[x] for x in part[p]] for p in e[1:])
            assert len(a) + len(b) == len(whole[e[1]])
            gain = len(a) * len(b) / (len(a) + len(b)) * (np.mean(a) - np.mean(b)) ** 2
            if best is None or gain > best[0]:
                best = (gain, rest)
        tree = best[1]
    cell = {(r[1], r[2]): r[0] for r in rows}
    return {cell[p]: min(cell[x] for x in g) for g in sides(at, tree) for p in g}


@pytest.mark.parametrize("side", [2, 5, 128])
def test_spanning_forest(spark, side):
    """In one tile and in many levels of tiles; equal gradients go by place."""
    for seed, ties in ((1, False), (2, True)):
        rows = lattice(13, 11, seed, ties)
        nodes = forest.nodes_of(spark.createDataFrame(rows, SCHEMA), "truth")
        got = forest.spanning_forest(forest.gradient_edges(nodes), side).collect()
        place = lambda n: ((n >> 32) - 2, (n & (2**32 - 1)) + 3)
        assert sorted((r.w, place(r.a), place(r.b)) for r in got) == kruskal(rows)[1]


@pytest.mark.parametrize("side", [3, 128])
def test_sums_below_tree_edges(spark, side):
    rows = lattice(12, 12, 4)
    at, tree = kruskal(rows)
    nodes = forest.nodes_of(spark.createDataFrame(rows, SCHEMA), "truth")
    below = forest.tree_nodes(forest.spanning_forest(forest.gradient_edges(nodes), side), nodes, side).collect()
    assert len(below) == len(tree)
    place = lambda n: ((n >> 32) - 2, (n & (2**32 - 1)) + 3)
    for r in below:
        rest = [e for e in tree if e[1:] != (place(r.a), place(r.b))]
        group = next(g for g in sides(at, rest) if place(r.node) in g)
        assert r.n == len(group) and r.s == pytest.approx(sum(at[p] for p in group)) and place(r.root) not in group
        under = {place(x.node) for x in below if x.root == r.root and r.start <= x.start and x.stop <= r.stop}
        assert under == group


@pytest.mark.parametrize("method", ["ward", "single"])
def test_divisive_equals_brute_force(spark, method):
    for seed, k, side in ((5, 9, 4), (6, 14, 128), (7, 1, 3)):
        rows = lattice(12, 12, seed)
        got = forest.divisive(spark.createDataFrame(rows, SCHEMA), k, method=method, side=side)
        assert {r.cell_id: r.cluster for r in got.collect()} == brute(rows, k, method)


def test_divisive_of_odd_tables(spark):
    """Cells without values, single cells, more clusters than cells, no cells."""
    rows = [(1, 0, 0, 1.0, 1), (2, 1, 0, 2.0, 1), (3, 5, 5, 2.0, 1), (4, 9, 9, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for method in ("ward", "single"):
        assert sorted(map(tuple, forest.divisive(df, 1, method=method).collect())) == [(1, 1), (2, 1), (3, 3)]
        assert sorted(map(tuple, forest.divisive(df, 99, method=method).collect())) == [(1, 1), (2, 2), (3, 3)]
        assert forest.divisive(df.where(F.lit(False)), 3, method=method).count() == 0
    with pytest.raises(ValueError):
        forest.divisive(df, 2, method="median")
