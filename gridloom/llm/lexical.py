"""Ranked lexical search with hierarchical max trees (operator 11).

Documents are dealt by ranges of their id; a task cuts its range into blocks of consecutive documents. A block holds, for each
term, a max tree over its documents: nodes of 16 documents, of 256, and the whole block, each with the largest term part that a
document under it has. A level is stored by node (the terms under it and their maxima), so that a node is opened by reading
one slice. Above the blocks the trees go on as Spark tables: a maximum for each term and block, then for each term and
task's range, then for 64 ranges at a time.

A query's bound at a node is the sum over its terms of weight times maximum. The descent goes down the Spark levels, then into
the blocks, where a heap opens the node with the highest bound first, of equal bounds the one with the smaller ids, until
the next bound is below the k-th score, or equals it with larger ids only. First each query opens its few best nodes
a level; their k-th score is a threshold that all documents of the result reach. Then it opens every node that reaches the
threshold, equal ones included, so the result is exact.

Term part of a document: (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L. Weight: floor(1000 ln((2N+2)/(2df+1))).
Only terms of the queries are indexed: a bitmap of fixed size, of hashes of query terms, lets a few others pass too. Two
terms are taken to be equal if 64 bits of their hashes and their lengths' part in them are.

Rows: null and empty texts have no terms. A null id comes before all others in ties; repeated rows are documents of their own. An
item without terms has no rows; items equal in id and text are one item, items with one id and several texts are
answered one by one. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import by_bytes, map_texts
from .store import Scratch
from .words import Words, chunks

#: Bytes of terms: ASCII digits and letters, and all bytes of other characters.
_TERM = np.zeros(256, dtype=bool)
_TERM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_TERM[128:] = True
SEQUENCE_BITS = 24  # blocks of a task's range


@dataclass(frozen=True)
class SearchParams:
    top: int = 20
    fan_out: int = 16
    block_documents: int = 4096
    block_postings: int = 1 << 20  # a block ends at either; one document is never cut
    filter_bits: int = 24
    nodes_first: int = 4  # that a query opens at each level to get its threshold
    chunk_items: int = 512  # queries that visit a block together
    upper_shift: int = 6


def term_counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By text the number of its terms, the distinct term hashes and how often each occurs."""
    for _, run in chunks(texts):
        words = Words(run, lower=True, inside=_TERM)
        hashes = words.hashes().view(np.int64)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            terms, times = np.unique(hashes[a:b], return_counts=True)
            yield b - a, terms, times


def counted(df: DataFrame, keep: list[str], text: str, p: SearchParams, bitmap: np.ndarray | None = None) -> DataFrame:
    """keep, n, terms array<long>, times array<int> of every row; with a bitmap only terms whose hash is in it."""
    shift = np.uint64(64 - p.filter_bits)

    def make(texts: list[str | None]) -> dict[str, pa.Array]:
        n, terms, times = [], [], []
        for count, t, c in term_counts(texts):
            if bitmap is not None:
                place = t.view(np.uint64) >> shift
                held = (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                t, c = t[held], c[held]
            n.append(count)
            terms.append(t)
            times.append(c.astype(np.int32))
        return {"n": pa.array(n, pa.int64()), "terms": _lists(terms, pa.int64()), "times": _lists(times, pa.int32())}

    return map_texts(df, keep, text, "n long, terms array<long>, times array<int>", make)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays) if arrays else [], kind))


def _bitmap(items: DataFrame, p: SearchParams) -> np.ndarray:
    """The bitmap of query terms: 2**filter_bits bits however many there are; its words are put together in Spark."""
    place = items.select(F.explode("terms").alias("h")).select(F.shiftrightunsigned("h", 64 - p.filter_bits).alias("at"))
    words = place.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    out = np.zeros(1 << (p.filter_bits - 6), np.int64)
    for row in words.collect():  # 2**(filter_bits - 6) rows at most
        out[row["word"]] = row["bits"]
    return out.view(np.uint8)


_LEVELS = (1, 2)
_BLOCK = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("most", T.ArrayType(T.IntegerType())), T.StructField("df", T.ArrayType(T.IntegerType()))]
    + [T.StructField(f"{name}{level}", T.BinaryType()) for level in (0, *_LEVELS) for name in ("starts", "term", "part")]
)


def max_tree(document: np.ndarray, term: np.ndarray, part: np.ndarray, documents: int, fan_out: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By level (documents, then nodes of fan_out**level of them) the bounds of each node's slice, its terms and maxima.

    Postings come in order of document and term."""
    levels, node = [], document
    for level in range(1 + len(_LEVELS)):
        if level:
            node = node // fan_out
            order = np.lexsort((term, node))
            node, term, part = node[order], term[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(node) != 0) | (np.diff(term) != 0)))) if len(node) else np.zeros(0, np.int64)
            part = np.maximum.reduceat(part, first) if len(first) else part
            node, term = node[first], term[first]
        nodes = -(-documents // fan_out**level)
        levels.append((np.searchsorted(node, np.arange(nodes + 1)).astype(np.int32), term.astype(np.int32), part.astype(np.int32)))
    return levels


def index(counts: DataFrame, n_documents: int, all_terms: int, id_col: str, p: SearchParams) -> DataFrame:
    """The blocks of the counted documents: ids, the root (terms, their maxima and document counts), and the levels below."""

    def block(number: int, ids: list, n: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        m = 75 + (25 * n * n_documents) // all_terms
        sizes = np.array([len(t) for t in terms])
        document, tf = np.repeat(np.arange(len(ids)), sizes), np.concatenate(times).astype(np.int64)
        found, term = np.unique(np.concatenate(terms), return_inverse=True)
        part = (10**9 * tf) // (1000 * tf + 12 * m[document])
        levels = max_tree(document, term, part, len(ids), p.fan_out)
        most = np.zeros(len(found), np.int32)
        np.maximum.at(most, term, part.astype(np.int32))
        row = [number, ids, found, most, np.bincount(term, minlength=len(found)).astype(np.int32)] + [x.tobytes() for level in levels for x in level]
        return pa.RecordBatch.from_arrays([pa.array([x], to_arrow_type(f.dataType)) for x, f in zip(row, _BLOCK.fields)], names=_BLOCK.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << SEQUENCE_BITS
        ids, n, terms, times, held = [], [], [], [], 0
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "n")), *(batch.column(c) for c in ("terms", "times")))
            for i, size, t, c in rows:
                t = t.values.to_numpy()
                if ids and (len(ids) == p.block_documents or held + len(t) > p.block_postings):
                    yield block(at, ids, np.array(n), terms, times)
                    ids, n, terms, times, held, at = [], [], [], [], 0, at + 1
                ids.append(i)
                n.append(size)
                terms.append(t)
                times.append(c.values.to_numpy())
                held += len(t)
        if ids:
            yield block(at, ids, np.array(n), terms, times)

    some = counts.where(F.size("terms") > 0).select(F.col(id_col).cast("long").alias("id"), "n", "terms", "times")
    spread = F.xxhash64("id", "n", "terms")  # rows that repeat an id need not stay together
    return some.repartitionByRange("id", spread).sortWithinPartitions("id", spread).mapInArrow(run, _BLOCK)


class Block:
    """One block's trees, to be searched by many queries."""

    def __init__(self, row: dict, p: SearchParams):
        self.p, self.ids = p, row["ids"]
        self.terms, self.most = row["terms"], row["most"]
        self.levels = [tuple(np.frombuffer(row[f"{name}{level}"], np.int32) for name in ("starts", "term", "part")) for level in (0, *_LEVELS)]
        self.weight = np.zeros(len(self.terms), np.int64)

    def bounds(self, level: int, first: int, last: int) -> np.ndarray:
        """The bounds of the nodes from first to before last of a level; for level 0 the scores of documents."""
        starts, term, part = self.levels[level]
        a, b = starts[first], starts[last]
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.weight[term[a:b]] * part[a:b])))
        edges = starts[first : last + 1] - a
        return sums[edges[1:]] - sums[edges[:-1]]

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(score, place) of the best documents whose score is at least `least`, best first.

        A heap opens the node with the highest bound, of equal ones that with the smaller places; a document that comes to
        its top is thus behind nothing that is left."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        held = self.terms[at] == terms
        at, weights = at[held], weights[held]
        self.weight[at] = weights
        top, fan_out = self.p.top, self.p.fan_out
        found: list[tuple[int, int]] = []
        level = len(self.levels) - 1
        heap: list[tuple[int, int, int]] = []

        def offer(level: int, first: int, last: int) -> None:
            for node, bound in enumerate(self.bounds(level, first, last).tolist(), first):
                if bound >= least:
                    heapq.heappush(heap, (-bound, node * fan_out**level, -level))  # by its first document; a node before that document

        offer(level, 0, len(self.levels[level][0]) - 1)
        while heap and len(found) < top:
            bound, place, level = heapq.heappop(heap)
            if level == 0:
                found.append((-bound, place))
                continue
            first = place // fan_out ** (-level - 1)
            offer(-level - 1, first, min(first + fan_out, len(self.levels[-level - 1][0]) - 1))
        self.weight[at] = 0
        return found


def _upper(blocks: DataFrame, scratch: Scratch, p: SearchParams) -> list[DataFrame]:
    """node, parent, term, most, df of the tree's levels above the blocks' inner ones: blocks, tasks' ranges, then 64 nodes at a time
    until no more than 64 are left."""
    held = F.explode(F.arrays_zip("terms", "most", "df")).alias("x")
    level = blocks.select(F.col("block").alias("node"), held).select("node", F.col("x.terms").alias("term"), F.col("x.most").alias("most"), F.col("x.df").cast("long").alias("df"))
    shift, out = SEQUENCE_BITS, []
    while True:
        out.append(scratch.save(level.withColumn("parent", F.shiftright("node", shift)), f"level{len(out)}"))
        if out[-1].select("node").distinct().count() <= 1 << p.upper_shift:
            return out
        level = out[-1].groupBy(F.col("parent").alias("node"), "term").agg(F.max("most").alias("most"), F.sum("df").alias("df"))
        shift = p.upper_shift


def _descend(wanted: DataFrame, levels: list[DataFrame], p: SearchParams, least: DataFrame | None) -> DataFrame:
    """q, block: at each level the few best nodes of each query, or with thresholds all that reach the query's."""
    opened = None
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "node")
    for level in reversed(levels):
        terms = wanted if opened is None else wanted.join(opened.withColumnRenamed("node", "parent"), "q")
        bounds = terms.join(level, ["term"] if opened is None else ["term", "parent"]).groupBy("q", "node").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
        if least is None:
            opened = bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= p.nodes_first).select("q", "node")
        else:
            opened = bounds.join(least, "q").where("bound >= least").select("q", "node")
    return opened.withColumnRenamed("node", "block")


def _open_blocks(opened: DataFrame, blocks: DataFrame, packed: DataFrame, chunks_of: int, p: SearchParams) -> DataFrame:
    """q, id, score: the best documents of each opened block for each query that opens it."""
    chunk = F.pmod(F.xxhash64("q"), F.lit(chunks_of)).cast("int").alias("chunk")
    asked = opened.join(packed, "q").select(chunk, "block", "q", "terms", "weights", "least")
    needed = blocks.join(opened.select("block").distinct(), "block", "left_semi")
    needed = needed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks_of - 1))))
    schema = "q long, id long, score long"

    def run(queries: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows:
            for row in held.select(_BLOCK.fieldNames()).to_batches():
                for k in range(row.num_rows):
                    one = {f: row.column(f)[k] for f in _BLOCK.fieldNames()}
                    arrays = {f: one[f].values.to_numpy() for f in ("terms", "most")}
                    block = Block({f: x.as_py() for f, x in one.items() if f not in arrays and f != "df"} | arrays, p)
                    for q, terms, weights, least in zip(*(queries.column(c) for c in ("q", "terms", "weights", "least"))):
                        found = block.search(terms.values.to_numpy(), weights.values.to_numpy(), least.as_py())
                        out += [(q.as_py(), block.ids[place], score) for score, place in found]
        columns = zip(*out) if out else ([], [], [])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("q", "id", "score"), columns)})

    return asked.groupBy("chunk", "block").cogroup(needed.groupBy("chunk", "block")).applyInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams(), id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """item, rank, document id and score of each item's `top` best documents."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lexical")
    asked = items.select(items[item_col].alias("item"), items[item_text].alias("item_text")).distinct()
    asked = scratch.save(counted(asked, ["item"], "item_text", p).withColumn("q", F.monotonically_increasing_id()), "items")
    counts = scratch.save(counted(docs, [id_col], text, p, _bitmap(asked, p)), "counts")
    n_documents, all_terms = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    blocks = scratch.save(index(counts, n_documents, all_terms or 1, id_col, p), "blocks")
    scratch.drop("counts")
    levels = _upper(blocks, scratch, p)
    df = levels[-1].groupBy("term").agg(F.sum("df").alias("df"))
    terms = asked.select("q", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("q", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))
    weight = F.floor(1000 * F.log((2.0 * n_documents + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    wanted = scratch.save(terms.join(df, "term").select("q", "term", weight.alias("w")).where("w > 0"), "wanted")
    packed = wanted.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x")).select("q", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
    chunks_of = 1 + asked.count() // p.chunk_items
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    opened = scratch.save(_descend(wanted, levels, p, None), "opened_first")
    first = scratch.save(_open_blocks(opened, blocks, packed.withColumn("least", F.lit(1).cast("long")), chunks_of, p), "first")
    last = ranked(first).where(F.col("rank") == p.top).select("q", F.col("score").alias("last"))
    least = scratch.save(wanted.select("q").distinct().join(last, "q", "left").select("q", F.coalesce("last", F.lit(1)).alias("least")), "least")
    opened = scratch.save(_descend(wanted, levels, p, least), "opened")
    found = scratch.save(_open_blocks(opened, blocks, packed.join(least, "q"), chunks_of, p), "found")
    return ranked(found).join(asked.select("q", "item"), "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
items AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n_all, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 75 + ((25 * len(w) * n_all) // l) AS m FROM d, s WHERE len(w) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_all),
scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM items JOIN df USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 20
"""
