"""How a chain of filters interacts, by a Walsh-Hadamard transform (operator 13).

Every document has a mask: bit i says that filter i fails it. For each part of the corpus and each label the tasks sum, for
each of the 32 subsets of filters, the parity sign of the mask on that subset, so a part is 3 x 32 sums whatever its size and
hot parts are summed before the shuffle. The transform is its own inverse up to 32, so the sums give the exact number of
documents with each mask, and from those follow all orders and steps. Shapley: a document that c filters fail is removed
by each of them in 120 / c of the orders.

Rows: a null text is an empty one. A text is a copy if a smaller id has the same text (by 128 bits of its SHA-256); null ids
are larger than all others and equal ids are no copies of each other. A document is good (toxic) if any of its label rows
says so; null ids have no labels. A null part is an empty string. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .store import Scratch
from .words import _LOWER as LOWER
from .words import Words, chunks

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
CELLS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#$%&*|")] = True
_UPPER = LOWER != np.arange(256)
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _distinct(hashes: np.ndarray) -> int:
    ordered = np.sort(hashes)
    return min(1, len(ordered)) + int(np.count_nonzero(ordered[1:] != ordered[:-1]))


def text_masks(texts: list[str | None]) -> dict[str, pa.Array]:
    """Bits 0 to 3 (A to D) of each text, and a hash of the text."""
    masks: list[np.ndarray] = []
    hashes: list[bytes] = []
    for _, run in chunks(texts):
        words = Words(run)
        n = np.diff(words.bounds)
        found = words.hashes()
        distinct = np.array([_distinct(found[a:b]) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())])
        within = lambda flag: np.add.reduceat(flag[words.buf], words.text_start, dtype=np.int64)  # noqa: E731  the line feed after a text is no such byte
        points = words.text_end - 1 - words.text_start - within(_CONTINUES)
        masks.append((n < 50) | (100 * distinct < 65 * n) << 1 | (100 * within(_UPPER) > 5 * points) << 2 | (within(_SYMBOLS) > 0) << 3)
        hashes += [hashlib.sha256(data).digest()[:16] for data in run]
    return {"mask": pa.array(np.concatenate(masks) if masks else [], pa.int32()), "same": pa.array(hashes, pa.binary())}


def document_masks(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask (five bits), good, toxic of every document.

    A text's first document is its smallest id, by an aggregate that combines in the tasks; documents are then joined to it by
    id and text, a key that no group of copies shares.
    """
    found = scratch.save(map_texts(docs, [id_col, part], text, "mask int, same binary", text_masks), "masks")
    firsts = found.groupBy(F.col("same").alias("first_same")).agg(F.min(id_col).alias("first_id"))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = found.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "mask", "same")
    is_first = (F.col("same") == F.col("first_same")) & F.col("id").eqNullSafe(F.col("first_id"))
    rows = rows.join(firsts, is_first, "left").select("id", "part", (F.col("mask") + F.when(F.col("first_same").isNull(), 16).otherwise(0)).alias("mask"))
    rows = rows.join(told, F.col("id") == F.col("of"), "left")
    return rows.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def parity_sums(masks: DataFrame) -> DataFrame:
    """A row for each part: its 32 signed sums for all, good and toxic documents (96 columns)."""
    sign = lambda s: F.lit(1) - F.lit(2) * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    weight: dict[str, Column] = {"all": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return masks.groupBy("part").agg(*[F.sum(sign(s) * weight[name]).alias(f"{name}_{s}") for name in LABELS for s in range(CELLS)])


def cells_of(sums: np.ndarray) -> np.ndarray:
    """The numbers of documents with each mask from the signed sums of each subset (last axis)."""
    at = np.arange(CELLS)
    parity = np.array([[bin(m & s).count("1") % 2 for s in at] for m in at])
    return sums @ (1 - 2 * parity) // CELLS


def evaluate(part: str, cells: np.ndarray) -> list[tuple]:
    """The rows of RESULT of a part; cells: by label and mask."""
    everything, good, toxic = cells
    masks = np.arange(CELLS)
    fails = np.array([bin(m).count("1") for m in masks])
    rows = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            failing, earlier = (masks & bit) > 0, (masks & before) > 0
            gone = failing & ~earlier
            before |= bit
            kept = everything[(masks & before) == 0].sum()
            shapley = (everything[failing] * (len(ORDERS) // fails[failing])).sum()
            numbers = (kept, everything[gone].sum(), everything[failing & earlier].sum(), everything[bit], good[gone].sum(), toxic[gone].sum(), shapley)
            rows.append((part, order, step, *map(int, numbers)))
    return rows


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """RESULT: for each part all orders and steps of the five filters."""
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    sums = parity_sums(document_masks(docs, labels, scratch, id_col, text, part))
    names = RESULT.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).reshape(-1, len(LABELS), CELLS)
            for name, cells in zip(batch.column("part").to_pylist(), cells_of(table)):
                columns = zip(*evaluate(name, cells))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n.split()[1]]) for c, n in zip(columns, names)], names=[n.split()[0] for n in names])

    return sums.mapInArrow(run, RESULT)


ORACLE = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tests AS (
    SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM words),
cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM tests LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
    SELECT [a.l, b.l, c.l, d.l, e.l] AS o, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
    WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
steps AS (SELECT array_to_string(o, '') AS filter_order, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k-1]), 0)::INT AS before FROM orders, range(1, 6) r(k))
SELECT part, filter_order, step,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER ((mask & bit) > 0), 0)::BIGINT AS shapley
FROM cells, steps GROUP BY ALL
"""
