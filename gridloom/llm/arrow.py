"""Run a function of whole Arrow batches beside the other columns of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text handled at a time; a longer text is handled by itself.
SLICE_BYTES = 4 << 20
BATCH_ROWS = 2000


def by_bytes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with about SLICE_BYTES of the column each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def small_batches(spark: SparkSession) -> None:
    """Batches of texts between Spark and Python of 2,000 rows at most, for the memory of both."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str, make: Callable[[list], dict[str, pa.Array]]) -> DataFrame:
    """For each row the columns `keep` and those that `make` returns for the list of the batch's texts.

    schema: the types of the new columns, as DDL; their order is that of the result. Only the needed columns are read.
    """
    small_batches(df.sparkSession)
    source = df.select(*[df[c] for c in keep], df[text].alias("__text"))
    new = T._parse_datatype_string(schema)
    out = T.StructType([source.schema[c] for c in keep] + new.fields)
    names = [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "__text"):
            made = make(part.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [made[c] for c in names], names=keep + names)

    return source.mapInArrow(run, out)
