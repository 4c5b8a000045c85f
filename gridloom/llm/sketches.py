"""Threshold-scaled sketches of documents (operator 8).

A sketch keeps every shingle hash below a fixed fraction of the hash range, the same for texts of all sizes, so its size
follows the document's: the union of two sketches is the sketch of the two texts together (`merge`), and containment is
estimated in both directions between texts of very different sizes. Sketches of two fractions are compared at the lesser.
A hash is its first 34 bits: of the hashes below a quarter of the range, or less, 32 bits say all. Fingerprint: "fraction
bits:text digest:hashes", the hashes sorted, of 32 bits each, in base64; `parse` reads it back.

Rows: a null text is an empty one; its sketch is empty. Two texts without a retained hash are alike (1.0) if equal, else
not (0.0). Ids are integers (other types are refused) and taken to be nearly unique: rows of one id stay in one range.
Equal ids are ordered by text; null ids come first. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import by_bytes
from .words import shingle_sets

HASH_BITS = 34


@dataclass(frozen=True)
class SketchParams:
    shingle_words: int = 5
    fraction_bits: int = 2  # hashes below 2**(34 - bits) stay; 2 at least
    bytes_per_range: int = 4 << 20
    most_ranges: int = 1 << 16  # of more than that many, each grows; a range is read as a stream

    def __post_init__(self):
        if self.fraction_bits < HASH_BITS - 32:
            raise ValueError("a fraction above a quarter needs hashes of more than 32 bits")


@dataclass(frozen=True)
class Sketch:
    bits: int
    digest: str
    hashes: np.ndarray

    def to(self, bits: int) -> Sketch:
        """The same at a fraction that is not larger."""
        return self if bits <= self.bits else Sketch(bits, self.digest, self.hashes[: np.searchsorted(self.hashes, 2 ** (HASH_BITS - bits))])

    def text(self) -> str:
        return f"{self.bits}:{self.digest[:16]}:{base64.b64encode(self.hashes.astype('>u4').tobytes()).decode()}"


def parse(fingerprint: str) -> Sketch:
    """The sketch of a fingerprint, with the part of the digest that it has."""
    bits, digest, raw = fingerprint.split(":")
    return Sketch(int(bits), digest, np.frombuffer(base64.b64decode(raw), ">u4").astype(np.int64))


def sketch_all(texts: list[str | None], p: SketchParams) -> list[Sketch]:
    out = []
    for text, s in zip(texts, shingle_sets(texts, p.shingle_words, lower=True), strict=True):
        digest = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
        short = np.unique((s >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        out.append(Sketch(0, digest, short).to(p.fraction_bits))
    return out


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together, at the lesser of the fractions."""
    bits = max(a.bits, b.bits)
    digest = a.digest if a.digest == b.digest else hashlib.sha256("".join(sorted((a.digest, b.digest))).encode()).hexdigest()
    return Sketch(bits, digest, np.union1d(a.to(bits).hashes, b.to(bits).hashes))


def containments(a: Sketch, b: Sketch) -> tuple[float, float]:
    """Estimates of the share of a's shingles that b has, and of b's that a has."""
    if a.digest == b.digest:
        return 1.0, 1.0
    bits = max(a.bits, b.bits)
    x, y = a.to(bits).hashes, b.to(bits).hashes
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x)), both / max(1, len(y))


def likeness(a: Sketch, b: Sketch) -> float:
    """The larger containment: the share of the smaller sketch's hashes that the other holds."""
    return max(containments(a, b))


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by as many characters from the start of `following`."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, in_next double, of_next double"


def _range_of(k: str, ends: list[int]) -> Column:
    """How many of the sorted bounds are at most k: first among every 256th of them, then among the 256 that follow."""
    rows = [ends[i : i + 256] for i in range(0, len(ends), 256)]
    if not rows:
        return F.lit(0)
    longs = lambda x: F.array(*[F.lit(e).cast("long") for e in x])
    below = lambda bounds: F.size(F.filter(bounds, lambda e: e <= F.col(k)))
    coarse = below(longs([r[0] for r in rows]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * 256 + below(F.element_at(F.array(*[longs(r) for r in rows]), F.greatest(coarse, F.lit(1)))))


def sketch_with_next(docs: DataFrame, p: SketchParams = SketchParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and their likeness.

    Documents are dealt by ranges of the id, one shuffle of the texts. The rows of a range's first id also go to the range
    before it (of the first range to the last), as that is all a range needs of the next. Each range is then read in
    order as a stream, a batch and one row carried over. in_next and of_next are the containments of the text in the next
    one and of the next one in it.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: documents are put in order by ids that are integers")
    lowest = -(2**63)
    key = F.coalesce(docs[id_col].cast("long"), F.lit(lowest)).alias("k")
    rows = docs.select(docs[id_col].alias(id_col), key, F.coalesce(docs[text], F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(p.most_ranges, int(size // p.bytes_per_range) + 1)
    steps = [i / ranges for i in range(1, ranges)]
    ends = sorted(set(rows.agg(F.percentile_approx("k", steps, 20 * ranges)).first()[0] or [])) if steps else []
    rows = rows.withColumn("bucket", _range_of("k", ends))
    firsts = rows.groupBy("bucket").agg(F.min("k").alias("k")).orderBy("bucket").collect()  # a row for each range
    moves = [(firsts[i]["k"], firsts[i - 1]["bucket"]) for i in range(len(firsts))]
    to = docs.sparkSession.createDataFrame(moves, "k long, before int")
    rows = rows.join(F.broadcast(to), "k", "left")  # a row for each range
    copies = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("tail")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail")))))
    dealt = rows.select(id_col, "k", "text", F.explode(copies).alias("at")).select("at.bucket", "at.tail", id_col, "k", "text")
    dealt = dealt.repartitionById(len(ends) + 1, "bucket").sortWithinPartitions("tail", "k", "text")
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(_OUT)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, str, Sketch] | None = None
        over = False
        for batch in by_bytes(batches, "text"):
            if over:
                continue
            ids, tails, texts = (batch.column(c).to_pylist() for c in (id_col, "tail", "text"))
            line = list(zip(ids, texts, sketch_all(texts, p), strict=True))
            if 1 in tails:
                line, over = line[: tails.index(1) + 1], True
            line = ([held] if held else []) + line
            held = line[-1]
            after = [edited(a[1], b[1]) for a, b in zip(line, line[1:])]
            rows = []
            for (i, t, s), (_, _, following), e in zip(line, line[1:], sketch_all(after, p)):
                inside, of = containments(s, following)
                rows.append((i, len(t), e.digest, s.text(), e.text(), likeness(s, e), max(inside, of), len(s.hashes), inside, of))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), schema.fields)], names=names)

    return dealt.mapInArrow(run, schema)
