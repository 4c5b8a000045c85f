"""A solver for sparse symmetric systems over a lattice, in blocks of a square tile.

The system's rows belong to places; two rows are coupled only if their places are less than `reach` apart, so a tile's
rows need the columns of its halo and nothing else. The matrix is never whole anywhere: a task makes the part of its tile
and halo from the places. Vectors, several right-hand sides at a time, are tables with a row for each place.

Iteration: solving every tile with some of its halo, and keeping the tile's own part, is nearly a solution, as far places hardly matter.
The residual is corrected that way again, each time by the length that makes it smallest, until it is small: an iteration
is two exchanges of halos, and its norm never grows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.models.fields import summed
from gridloom.session import cut

#: The matrix between the places of the rows and of the columns; a place is (ix, iy).
Entries = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Tiles:
    """Square tiles, the halo that their rows reach into (the matrix is zero beyond), and the part of it that a tile is solved
    with: a narrower one costs less each time and takes more iterations."""

    side: int
    halo: int
    overlap: int

    def with_halos(self, df: DataFrame, halo: int | None = None) -> DataFrame:
        """df with tx, ty and own: each row goes to its own tile and to those whose halo it is in."""
        halo = self.halo if halo is None else halo
        at = lambda c, d: F.floor((F.col(c) + d) / self.side).cast("int")
        rows = df.withColumn("tx", F.explode(F.sequence(at("ix", -halo), at("ix", halo))))
        rows = rows.withColumn("ty", F.explode(F.sequence(at("iy", -halo), at("iy", halo))))
        return rows.withColumn("own", (F.col("tx") == at("ix", 0)) & (F.col("ty") == at("iy", 0)))


def _places(f: pd.DataFrame) -> np.ndarray:
    return f[["ix", "iy"]].to_numpy(float)


_FIELDS = {"id": "long", "ix": "int", "iy": "int"}


def _schema(vectors: str) -> str:
    return ", ".join([*(f"{c} {t}" for c, t in _FIELDS.items()), *(f"{c} binary" for c in vectors)])


def _matrix(column: pd.Series) -> np.ndarray:
    """A row for each of the column's vectors, which are the bytes of doubles."""
    return np.frombuffer(b"".join(column), float).reshape(len(column), -1)


def _rows(matrix: np.ndarray) -> list[bytes]:
    raw, width = np.ascontiguousarray(matrix).tobytes(), matrix.shape[1] * 8
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _none(vectors: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object if c in vectors else "int64") for c in [*_FIELDS, *vectors]})


def _correction(entries: Entries):
    """In a tile the solution of its rows and halo for the residual; its own part."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        own = f["own"].to_numpy(bool)
        if not own.any():
            return _none("xrz")
        at = _places(f)
        z = np.linalg.solve(entries(at, at), _matrix(f["r"]))
        return f.loc[own, [*_FIELDS, "x", "r"]].assign(z=_rows(z[own]))

    return run


def _product(entries: Entries):
    """In a tile the products of its own rows with z."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        kept = f[f["own"].to_numpy(bool)]
        if not len(kept):
            return _none("xrzq")
        q = entries(_places(kept), _places(f)) @ _matrix(f["z"])
        return kept[[*_FIELDS, "x", "r", "z"]].assign(q=_rows(q))

    return run


def _stepped(alpha: np.ndarray):
    """x + alpha z and r - alpha q."""

    def run(frames):
        for f in frames:
            if len(f):
                x, r, z, q = (_matrix(f[c]) for c in "xrzq")
                yield f[list(_FIELDS)].assign(x=_rows(x + z * alpha), r=_rows(r - q * alpha))

    return run


def _products(df: DataFrame, k: int, *pairs: str) -> np.ndarray:
    """By pair of vector columns the sums over all rows of their elementwise products."""

    def part(frames):
        for f in frames:
            held = {c: _matrix(f[c]) if len(f) else np.zeros((0, k)) for pair in pairs for c in pair}
            yield pd.DataFrame({"g": range(len(pairs)), "v": [(held[a] * held[b]).sum(axis=0) for a, b in pairs]})

    found = summed(df.select(*sorted({c for pair in pairs for c in pair})).mapInPandas(part, "g int, v array<double>"))
    return np.array([found.get(g, np.zeros(k)) for g in range(len(pairs))])


def _start(frames):
    for f in frames:
        if len(f):
            b = np.array(f["b"].tolist(), float)
            yield f[list(_FIELDS)].assign(x=_rows(np.zeros_like(b)), r=_rows(b))


def solve(b: DataFrame, k: int, entries: Entries, tiles: Tiles, tolerance: float = 1e-6, most: int = 30) -> DataFrame:
    """id, ix, iy and x (the bytes of k doubles): the solution of entries x = b for the k right-hand sides in the array b.

    Stops when every residual is below tolerance times its right-hand side's norm; a system that does not come there in `most`
    iterations is an error, not a poor answer.
    """
    state = b.select(*_FIELDS, "b").mapInPandas(_start, _schema("xr"))
    aim = None
    own_only = lambda *columns: {c: F.when(F.col("own"), F.col(c)) for c in columns}
    for _ in range(most):
        near = tiles.with_halos(state, tiles.overlap).withColumns(own_only("x"))
        z = near.groupBy("tx", "ty").applyInPandas(_correction(entries), _schema("xrz"))
        near = tiles.with_halos(z).withColumns(own_only("x", "r"))
        q = cut(near.groupBy("tx", "ty").applyInPandas(_product(entries), _schema("xrzq")))
        rr, rq, qq = _products(q, k, "rr", "rq", "qq")
        aim = tolerance**2 * rr if aim is None else aim
        length = rq / np.maximum(1e-300, qq)
        state = q.select(*_FIELDS, *"xrzq").mapInPandas(_stepped(length), _schema("xr"))
        if (rr - rq * length <= aim).all():
            return state.select(*_FIELDS, "x")
    raise ArithmeticError(f"no solution to {tolerance} in {most} iterations; take a wider overlap")


def apply_rows(x: DataFrame, to: DataFrame, entries: Entries, tiles: Tiles) -> DataFrame:
    """id, ix, iy and v (bytes of doubles): for each place of `to` the product of its row of entries with x; null where
    nothing is in reach."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        asked = f["x"].isna().to_numpy()
        if not asked.any():
            return _none("v")
        wanted, held = f[asked], f[~asked].sort_values("id")
        values = _rows(entries(_places(wanted), _places(held)) @ _matrix(held["x"])) if len(held) else None
        return wanted[list(_FIELDS)].assign(v=values)

    seen = tiles.with_halos(x).select(*_FIELDS, "x", "tx", "ty")
    asked = tiles.with_halos(to, 0).select(*_FIELDS, F.lit(None).cast("binary").alias("x"), "tx", "ty")
    return seen.unionByName(asked).groupBy("tx", "ty").applyInPandas(run, _schema("v"))
