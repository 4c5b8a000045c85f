"""Repeated lines across documents, as keep bitmaps (operator 12, DataFrame functions only).

A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at least `least_chars` code
points stay only in the smallest document that holds them. Key hashes (two of 64 bits) are written with document and place,
dealt by ranges of the hash and sorted by hash, document and place, so each task streams over its keys and sees every
key's first document first. A few hot keys, found by a frequent-items sketch of fixed size, would fill a task: their
first documents are found by a map-side minimum and looked up, so they are not shuffled. Which keys are taken to be hot
changes balance only, no result.

What comes back is small: for each document that loses a line, words of 64 bits, one bit a line (1: it stays), up to the
last word that loses a line; all further lines stay. `kept_text` applies them.

Rows: a null text is an empty one, a single empty line. Rows with equal ids are one document to others: they never take
lines from each other. A null id is larger than all others. Repeated rows lose the same lines. Extra columns are ignored;
an empty table gives no rows. Two keys are taken to be equal if all 128 bits are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineParams:
    least_chars: int = 10
    hot_keys: int = 4096  # looked up in a broadcast table of at most so many rows
    tracked: int = 32768  # items that the sketch of frequent keys holds


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, p: LineParams, id_col: str, text: str) -> DataFrame:
    """h, g, id, t, place of every line whose key is long enough."""
    base = docs.select(docs[id_col].alias("id"), _text_hash(docs[text]).alias("t"), F.posexplode(lines_of(docs[text])).alias("place", "line"))
    keyed = base.select("id", "t", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= p.least_chars)
    return keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), F.col("key")).alias("g"), "id", "t", "place")


def _hot(lines: DataFrame, p: LineParams) -> DataFrame:
    """The first document of each of the most frequent hashes: at most p.hot_keys keys of h, with few g each."""
    top = lines.agg(F.expr(f"approx_top_k(h, {p.hot_keys}, {p.tracked})").alias("top")).select(F.explode("top").alias("x"))
    share = 1 + lines.count() // p.tracked
    frequent = top.select(F.col("x.item").alias("h"), F.col("x.count").alias("n")).where(F.col("n") > share).select("h")
    return lines.join(F.broadcast(frequent), "h", "left_semi").groupBy("h", "g").agg(F.min("id").alias("least"))


def keep_bitmaps(docs: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, t (the text's hash), keep array<long>, n_dropped of every document that loses lines."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    lines = scratch.save(line_hashes(docs, p, id_col, text), "lines")
    hot = scratch.save(_hot(lines, p), "hot")
    later = ~F.col("id").eqNullSafe(F.col("least"))
    looked_up = lines.join(F.broadcast(hot), ["h", "g"]).where(later)
    rest = lines.join(F.broadcast(hot), ["h", "g"], "left_anti")
    ordered = [F.col("id").asc_nulls_last(), F.col("t"), F.col("place")]
    dealt = rest.repartitionByRange("h").sortWithinPartitions("h", "g", *ordered)
    stream = Window.partitionBy("h", "g").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = dealt.withColumn("least", F.first("id").over(stream)).where(later)
    dropped = looked_up.select("id", "t", "place").unionByName(streamed.select("id", "t", "place"))
    bit = F.expr("shiftleft(1L, place % 64)")
    words = dropped.groupBy("id", "t", F.expr("place div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    some = words.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("some"), F.sum(F.bit_count("bits")).alias("n_dropped"))
    before = F.expr("flatten(transform(some, (x, i) -> concat(array_repeat(-1L, x.word - if(i = 0, 0, some[i - 1].word + 1)), array(~x.bits))))")
    return some.select("id", "t", before.alias("keep"), "n_dropped")


def kept_lines(lines: Column, keep: Column) -> Column:
    """Those of a document's lines that its bitmap keeps (null: all)."""
    stays = lambda line, i: (i >= F.size(keep) * 64) | (F.get(keep, (i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0)
    return F.when(keep.isNull(), lines).otherwise(F.filter(lines, stays))


def dedup_lines(docs: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Each document's id, n_lines, n_dropped, its bitmap and its kept_text."""
    found = keep_bitmaps(docs, p, id_col, text, scratch)
    rows = docs.select(docs[id_col].alias("id"), _text_hash(docs[text]).alias("t"), docs[text].alias("text"))
    same = rows["id"].eqNullSafe(found["id"]) & (rows["t"] == found["t"])
    joined = rows.join(found, same, "left").select(rows["id"].alias(id_col), lines_of(F.col("text")).alias("lines"), "keep", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    kept = F.array_join(kept_lines(F.col("lines"), F.col("keep")), "\n")
    return joined.select(id_col, F.size("lines").cast("long").alias("n_lines"), "n_dropped", "keep", kept.alias("kept_text"))


ORACLE = r"""
WITH lines AS (
    SELECT doc_id, place, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS place FROM documents)),
firsts AS (SELECT key, min(doc_id) AS least FROM lines WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT lines.*, coalesce(doc_id <> least, FALSE) AS gone FROM lines LEFT JOIN firsts ON lines.key = firsts.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
