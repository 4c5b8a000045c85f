"""Writers: parquet, CSV, fixed-decimal text, neighbour lists, rounded tables and plot data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def fixed_text(df: DataFrame, columns: list[str], decimals: int = 10) -> Column:
    """The columns with a fixed number of decimals, tab-separated; integers are left whole."""
    kinds = dict(df.dtypes)
    cells = [F.format_string(f"%.{decimals}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return F.concat_ws("\t", *cells)


def write_fixed(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(fixed_text(df, columns).alias("value")).write.text(path)


def neighbour_lines(edges: DataFrame, offset: int = 1) -> DataFrame:
    """"i n1,n2,..." for edges (i, rank, j); the lists are as short as the number of neighbours asked for."""
    lists = edges.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("rank", "j"))).alias("n"))
    names = F.transform("n", lambda x: (x["j"] + offset).cast("string"))
    return lists.select("i", F.concat(F.col("i") + offset, F.lit(" "), F.concat_ws(",", names)).alias("line"))


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """A table for printing: fractional columns rounded."""
    return df.select(*[F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def plot_data(df: DataFrame, values: list[str]) -> DataFrame:
    """ix, iy, name, fill with the common limits of all values (zmin, zmax)."""
    low, high = F.least(*[F.col(v) for v in values]), F.greatest(*[F.col(v) for v in values])
    ends = df.agg(F.min(low).alias("zmin"), F.max(high).alias("zmax"))
    long = df.unpivot(["ix", "iy"], values, "name", "fill")
    return long.join(F.broadcast(ends))  # one row
