"""Readers with explicit schemas: parquet, CSV, whitespace text, key-value configuration, raster bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, names: list[str] | None = None) -> DataFrame:
    """CSV with a header; names, if given, rename the columns in order."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.toDF(*names) if names else df


def read_whitespace(spark: SparkSession, path: str, columns: list[tuple[str, str]], header: bool = False) -> DataFrame:
    """Lines of values between white space; with header, lines equal to the names are left out. Blank lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header:
        lines = lines.where(F.concat_ws(" ", parts) != " ".join(n for n, _ in columns))
    return lines.select(*[F.element_at(parts, i + 1).cast(kind).alias(n) for i, (n, kind) in enumerate(columns)])


def read_matrix(spark: SparkSession, spec: str) -> DataFrame:
    """A "path,nrow,ncol" triple as rows (i, j, v); another number of rows, or of values in a line, is an error.

    The line number comes from the file's own order: one text file is read by offset, ordered by partition and place.
    """
    path, nrow, ncol = (x.strip() for x in spec.split(","))
    rows = spark.read.text(path).where(F.trim("value") != "")
    if (found := rows.count()) != int(nrow):
        raise ValueError(f"{path}: {found} rows, not {nrow}")
    parts = F.split(F.trim("value"), r"\s+")
    whole = F.when(F.size(parts) == int(ncol), parts).otherwise(F.raise_error(F.lit(f"{path}: a line without {ncol} values")))
    rows = rows.select(F.monotonically_increasing_id().alias("place"), whole.alias("parts"))
    rank = {r["pid"]: r["before"] for r in _before(rows)}
    first = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]) if rank else F.create_map()
    pid = F.shiftright("place", 33).cast("int")
    index = (F.element_at(first, pid) + F.col("place").bitwiseAND((1 << 33) - 1)).cast("long")
    return rows.select(index.alias("i"), F.posexplode("parts").alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def _before(rows: DataFrame) -> list[dict]:
    """By partition the number of rows in the partitions ahead of it."""
    sizes = rows.groupBy(F.shiftright("place", 33).cast("int").alias("pid")).count().orderBy("pid").collect()  # one a partition
    total, out = 0, []
    for r in sizes:
        out.append({"pid": r["pid"], "before": total})
        total += r["count"]
    return out


TRUE_WORDS = ("yes", "t", "true")
FALSE_WORDS = ("no", "f", "false")


@dataclass(frozen=True)
class Config:
    """Key-value settings: '#' starts a comment, the first two tokens of a line count, the first occurrence of a key wins."""

    values: dict[str, str]

    @classmethod
    def parse(cls, text: str) -> Config:
        values: dict[str, str] = {}
        for line in text.splitlines():
            tokens = line.partition("#")[0].split()
            if len(tokens) >= 2:
                values.setdefault(tokens[0], tokens[1])
        return cls(values)

    def override(self, arguments: list[str]) -> Config:
        """With name=value arguments of a command line put in place of the settings; text only, nothing is evaluated."""
        given: dict[str, str] = {}
        for a in arguments:
            name, sign, value = a.partition("=")
            if not sign or not name.isidentifier():
                raise ValueError(f"{a}: not of the form name=value")
            given[name] = value
        return Config(self.values | given)

    def text(self, key: str) -> str:
        if key not in self.values:
            raise KeyError(f"no setting {key}")
        return self.values[key]

    def integer(self, key: str) -> int:
        return int(self.text(key))

    def number(self, key: str) -> float:
        return float(self.text(key))

    def numbers(self, key: str) -> list[float]:
        return [float(x) for x in self.text(key).split(",")]

    def texts(self, key: str) -> list[str]:
        return self.text(key).split(",")

    def span(self, key: str) -> list[int]:
        """An inclusive range a:b with b > a."""
        a, b = (int(x) for x in self.text(key).split(":"))
        if b <= a:
            raise ValueError(f"{key}: the range {a}:{b} is empty")
        return list(range(a, b + 1))

    def flag(self, key: str) -> bool:
        word = self.text(key).lower()
        if word in TRUE_WORDS or word in FALSE_WORDS:
            return word in TRUE_WORDS
        raise ValueError(f"{key}: {word} is neither yes nor no")


DATASETS: dict[str, str] = {}


def register(name: str, path: str) -> None:
    """Make a Parquet path known as a dataset."""
    DATASETS[name] = path


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """A dataset registered by name in DATASETS (name to parquet path)."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name}; known: {sorted(DATASETS)}")
    return spark.read.parquet(DATASETS[name])


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Uncompressed little-endian one-band TIFF files of 16-bit cells as rows (path, ix, iy, v), column index first.

    Each file is decoded by the task that reads it; its strips become one frame each.
    """

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                (at,) = struct.unpack_from("<I", data, 4)
                (n,) = struct.unpack_from("<H", data, at)
                tags = {}
                for i in range(n):
                    tag, kind, count = struct.unpack_from("<HHI", data, at + 2 + 12 * i)
                    size = {3: 2, 4: 4}.get(kind, 1)
                    place = at + 10 + 12 * i if count * size <= 4 else struct.unpack_from("<I", data, at + 10 + 12 * i)[0]
                    if kind in (3, 4):
                        tags[tag] = struct.unpack_from(f"<{count}{'H' if kind == 3 else 'I'}", data, place)
                width, per_strip = tags[256][0], tags.get(278, tags[257])[0]
                for k, (start, length) in enumerate(zip(tags[273], tags[279])):
                    v = np.frombuffer(data, "<u2", length // 2, start)
                    cell = np.arange(len(v))
                    yield pd.DataFrame({"path": name, "ix": cell % width, "iy": k * per_strip + cell // width, "v": v.astype(np.int32)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, ix int, iy int, v int")
