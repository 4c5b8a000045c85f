"""N-gram Jaccard join of documents with adaptive multi-match prefixes (operator 3).

Two texts link when the Jaccard similarity of their sets of word shingles is at least a threshold t. Documents with equal
sets form a class and go on as one. Shingles have one global order, rare ones first. If r and s link, their first
|r| - ceil(t |r|) + l and |s| - ceil(t |s|) + l shingles have at least l in common, for every l. Each class picks its own l: a
longer prefix costs postings but asks for more matches before a pair is verified, so l grows with the estimated number of
candidates. A pair needs the lesser of its two l.

Postings are counted exactly. Lists of at most `light` classes give pairs, which are counted by pair; those with enough
matches are candidates. Of longer lists (groups of near copies, passages that many share) the pairs are not written out:
each list ties its classes together, and their matches are counted where they meet. What candidates and long lists connect
is a group; its classes meet in cells of bounded size, in one task for a small group, else two cells at a time where sizes
allow a link. There the matches of prefixes are counted for every pair, whatever the lists' lengths; only pairs with as
many as they need are verified on the full sets, and the task returns a spanning forest of the links. No list is cut, so
no link between different texts is lost. Tokens with so long a list that it would fill a task are joined by broadcast, at
most `hot_tokens` of them by construction; so one token never gathers in one task.

How often a shingle occurs is kept in a count sketch of fixed size over all documents; it only sets the order and l, so its
errors cost time, never links.

Rows: a null text or one without words has an empty set and links with nothing. A row with a null id belongs to the class
of its text, but a class of null ids only is not compared. Equal rows are one class. Extra columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import by_bytes
from .components import components
from .store import Scratch
from .words import shingle_sets

_BLOCK = 16  # bits of a counter's place within a block of the sketch


@dataclass(frozen=True)
class JaccardParams:
    shingle_words: int = 3
    percent: int = 90
    sketch_bits: int = 24
    longest: int = 8
    accident: float = 0.1
    verify_cost: float = 20.0
    light: int = 64
    cell_shingles: int = 500_000
    cell_classes: int = 1000
    broadcast_ids: int = 300_000
    hot_tokens: int = 100_000
    sketch_parts: int = 256


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, p: JaccardParams, id_col: str, text: str) -> DataFrame:
    """A row (id, n, key) for each document, and rows (block, counts) with parts of each task's sketch."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n long, key long, block int, part int, counts binary"
    bits, k = p.sketch_bits, p.shingle_words
    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint8)
        names = ["id", "n", "key", "block", "part", "counts"]
        task = TaskContext.get().partitionId() % p.sketch_parts
        for part in by_bytes(batches, "text"):
            sets = list(shingle_sets(part.column("text").to_pylist(), k, True))
            every = np.concatenate(sets) >> np.uint64(64 - bits)
            place, times = np.unique(every, return_counts=True)
            sketch[place] = np.minimum(sketch[place] + times, 255)  # only orders shingles; sums over tasks go on
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(s) for s in sets], kind), pa.array([_key(s) for s in sets], kind), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=names,
            )
        rows = [(i, b) for i, b in enumerate(np.split(sketch, 1 << max(0, bits - _BLOCK))) if b.any()]
        for i, b in rows:
            data = zlib.compress(b.tobytes(), 1)
            own = [pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, kind), pa.nulls(1, kind), *own], names=names)

    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    id_type = to_arrow_type(source.schema["id"].dataType)
    return source.mapInArrow(run, schema)


def merge_sketch(rows: DataFrame, p: JaccardParams) -> np.ndarray:
    """The counters over all documents as estimates of how many have a shingle, in classes of powers of two.

    Blocks are summed in Spark in two levels, first those of each `part` of the tasks, so a group stays small however many
    tasks there are. The result has a fixed size, a byte for each counter (16 MB at 24 bits).
    """

    def add(kind: type):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            total = np.zeros(1 << min(_BLOCK, p.sketch_bits), np.int64)
            for x in table.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), kind)
            data = zlib.compress(total.tobytes(), 1)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "load": pa.array([int(total.sum())], pa.int64()), "counts": pa.array([data], pa.binary())})

        return run

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.ceil(np.log2(np.maximum(1, np.frombuffer(zlib.decompress(x), np.int64) - noise))).astype(np.uint8).tobytes() for x in b.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out, pa.binary())], names=["block", "classes"])

    out = "block int, load long, counts binary"
    summed = rows.groupBy("block", "part").applyInArrow(add(np.uint8), out).groupBy("block").applyInArrow(add(np.int64), out).persist()
    noise = (summed.agg(F.sum("load")).first()[0] or 0) >> p.sketch_bits  # what other shingles add to a counter on average
    result = np.zeros((1 << max(0, p.sketch_bits - _BLOCK), 1 << min(_BLOCK, p.sketch_bits)), np.uint8)
    for r in summed.select("block", "counts").mapInArrow(classes, "block int, classes binary").toLocalIterator():
        result[r["block"]] = np.frombuffer(r["classes"], np.uint8)
    summed.unpersist()
    return result.ravel()


def least_overlap(n: int, p: JaccardParams) -> int:
    """The least number of shingles that a set of n shares with any that it links with."""
    return -(-p.percent * n // 100)


def prefix(s: np.ndarray, classes: np.ndarray, p: JaccardParams) -> tuple[int, np.ndarray]:
    """The matches a set asks for and its prefix: the length whose estimated cost of postings and candidates is least."""
    cls = classes[s >> np.uint64(64 - p.sketch_bits)]
    order = np.argsort((cls.astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6)), kind="stable")
    overlap = least_overlap(len(s), p)
    base, most = len(s) - overlap + 1, min(p.longest, overlap)
    # What a shingle adds: how many others are estimated to have it, and the chance that one more does by accident.
    found = np.exp2(cls[order[: base + most - 1]].astype(float)) - 1 + p.accident
    postings = np.cumsum(found)[base - 1 :]
    cost = postings + p.verify_cost * postings / np.arange(1, most + 1) + np.arange(most)
    ell = int(np.argmin(cost)) + 1
    return ell, s[order[: base + ell - 1]]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32), pa.array(flat.view(np.int64)))


def prefixes(docs: DataFrame, classes: np.ndarray, p: JaccardParams, text: str) -> DataFrame:
    """key, n, ell and prefix of each document with words."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # a byte for each counter of the sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text"):
            sets = [s for s in shingle_sets(part.column("text").to_pylist(), p.shingle_words, True) if len(s)]
            made = [prefix(s, shared.value, p) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in made], pa.int32()), _longs([m[1] for m in made])],
                names=["key", "n", "ell", "prefix"],
            )

    return docs.select(docs[text].alias("text")).mapInArrow(run, "key long, n long, ell int, prefix array<long>")


def linked(overlap, a, b, p: JaccardParams):
    """Whether sets of sizes a and b with this overlap link (numbers, arrays or columns)."""
    return 100 * overlap >= p.percent * (a + b - overlap)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share."""
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    times = np.bincount(token)
    column = np.cumsum(times > 1) - 1
    keep = times[token] > 1
    row, token = row[keep], column[token[keep]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [at, at + width])
        has = np.zeros((len(sets), width), np.float32)
        has[row[a:b], token[a:b] - at] = 1
        overlap += has @ has.T
    return overlap.astype(np.int64)


def cell_links(keys: np.ndarray, ells: np.ndarray, side: np.ndarray, starts: list[np.ndarray], sets: list[np.ndarray], p: JaccardParams) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides of a pair of cells (or within one, if all have side 0).

    Pairs whose prefixes (`starts`) share as many tokens as the lesser of their two ells are candidates; sets without a
    candidate are put aside before the full sets are compared.
    """
    sizes = np.array([len(s) for s in sets])
    able = np.triu(100 * np.minimum(sizes[:, None], sizes) >= p.percent * np.maximum(sizes[:, None], sizes), 1)
    if side.any():
        able &= side[:, None] != side[None, :]
    able &= overlaps(starts) >= np.minimum(ells[:, None], ells)
    kept = np.flatnonzero(able.any(axis=0) | able.any(axis=1))
    if not len(kept):
        return []
    able, sizes, keys, sets = able[np.ix_(kept, kept)], sizes[kept], keys[kept], [sets[i] for i in kept]
    good = able & linked(overlaps(sets), sizes[:, None], sizes[None, :], p)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for i, j in np.argwhere(good).tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            forest.append((int(keys[i]), int(keys[j])))
    return forest


def _placed(edges: DataFrame, classes: DataFrame, p: JaccardParams, scratch: Scratch) -> DataFrame:
    """Where the classes of each connected group of candidates meet: key, id, work, grp, one, two, side.

    A group that fits a cell meets whole; small groups share a unit of work. A larger one is laid out in bands of size, such
    that sets can link only within a band or with the next one, and each band in cells; cells meet two at a time.
    """
    joined = components(edges, scratch, "candidates")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    band = F.floor(F.log("n") / F.log(F.lit(100.0 / p.percent)) + 1e-9).cast("int")
    members = nodes.join(joined, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("grp"))
    members = scratch.save(members.join(classes, "key").select("key", "id", "n", "grp", band.alias("band")), "members")
    fit = F.greatest(F.ceil(F.sum("n") / p.cell_shingles), F.ceil(F.count("*") / p.cell_classes)).cast("int")
    groups = scratch.save(members.groupBy("grp").agg(fit.alias("size"), F.sum("n").alias("total")), "groups")
    units = F.lit(1 + (groups.where("size = 1").agg(F.sum("total")).first()[0] or 0) // p.cell_shingles)
    none = F.struct(F.lit(0).alias("b"), F.lit(0).alias("c"))
    whole = members.join(groups.where("size = 1").select("grp"), "grp")
    whole = whole.select("key", "id", F.pmod(F.xxhash64("grp"), units).alias("work"), "grp", none.alias("one"), none.alias("two"), F.lit(0).alias("side"))
    large = members.join(groups.where("size > 1").select("grp"), "grp")
    cells = scratch.save(large.groupBy("grp", "band").agg(fit.alias("cells")), "cells")
    near = cells.select("grp", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("band").alias("other"), F.col("cells").alias("others"))
    near = near.groupBy("grp", "band").agg(F.collect_list(F.struct("other", "others")).alias("around"))  # three at most
    spread = large.join(cells.join(near, ["grp", "band"]), ["grp", "band"]).withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
    met = F.expr("flatten(transform(around, x -> transform(sequence(0, x.others - 1), c -> struct(x.other as b, c as c))))")
    spread = spread.withColumn("own", F.struct(F.col("band").alias("b"), F.col("cell").alias("c"))).withColumn("met", F.explode(met))
    one, two = F.least("own", "met"), F.greatest("own", "met")
    spread = spread.select("key", "id", F.xxhash64("grp", one, two).alias("work"), "grp", one.alias("one"), two.alias("two"), (F.col("own") > F.col("met")).cast("int").alias("side"))
    return scratch.save(whole.unionByName(spread), "placed")


def verified_links(docs: DataFrame, edges: DataFrame, classes: DataFrame, order: np.ndarray, p: JaccardParams, scratch: Scratch, id_col: str, text: str) -> DataFrame:
    """The links (a, b) among the classes that edges (a, b) connect, as spanning forests; each set is shuffled once for each meeting.

    A set goes with its prefix first, as the order of its other shingles does not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)
    placed = _placed(edges, classes, p, scratch)
    placed = placed.withColumnRenamed("id", "__id")
    placed = F.broadcast(placed) if placed.count() <= p.broadcast_ids else placed
    rows = docs.select(docs[id_col].alias("__id"), docs[text].alias("text")).join(placed, "__id").select("key", "work", "grp", F.hash("one", "two").alias("cells"), "side", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text"):
            own = list(shingle_sets(part.column("text").to_pylist(), p.shingle_words, True))
            is_class = [_key(s) == k for s, k in zip(own, part.column("key").to_pylist(), strict=True)]  # ids may repeat
            ells, starts, rest = [], [], []
            for s, wanted in zip(own, is_class):
                ell, start = prefix(s, shared.value, p) if wanted else (0, s[:0])
                ells.append(ell)
                starts.append(len(start))
                rest.append(np.concatenate((start, np.setdiff1d(s, start, assume_unique=True))) if wanted else start)
            kept = ["key", "work", "grp", "cells", "side"]
            made = [*[part.column(c) for c in kept], pa.array(ells, pa.int32()), pa.array(starts, pa.int32()), _longs(rest)]
            yield pa.RecordBatch.from_arrays(made, names=[*kept, "ell", "start", "shingles"]).filter(pa.array(is_class))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("cells", "ascending")])
        grp, cells, keys, side, ells, starts = (table.column(c).to_numpy() for c in ("grp", "cells", "key", "side", "ell", "start"))
        lists = table.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        each = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        cut = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (cells[1:] != cells[:-1]), [True])))
        found = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            found += cell_links(keys[a:b], ells[a:b], side[a:b], [s[:n] for s, n in zip(each[a:b], starts[a:b])], each[a:b], p)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    made = rows.mapInArrow(sets, "key long, work long, grp long, cells int, side int, ell int, start int, shingles array<long>")
    return made.groupBy("work").applyInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, p: JaccardParams = JaccardParams(), id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links lead to, the row's own included) of every row.

    The id may be of any type that has an order, a struct too.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    read = scratch.save(signatures(docs, p, id_col, text), "signatures")
    rows = read.where("block is null").select("id", "n", "key")
    order = merge_sketch(read.where("block is not null").select("block", "part", "counts"), p)
    classes = scratch.save(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n")), "classes")

    made = prefixes(docs, order, p, text).dropDuplicates(["key"])
    made = scratch.save(made.join(classes.where("id is not null").select("key"), "key", "left_semi"), "prefixes")
    postings = made.select(F.explode("prefix").alias("token"), "key", "n", "ell")
    lists = scratch.save(postings.groupBy("token").agg(F.count("*").alias("list")).where("list > 1"), "lists")
    most = max(p.light, (lists.agg(F.sum("list")).first()[0] or 0) // p.hot_tokens)
    hot = F.broadcast(lists.where(F.col("list") > most))  # by their sum hot_tokens rows at most
    rest = postings.join(hot, "token", "left_anti").join(lists.where(F.col("list") <= most), "token")
    shared = scratch.save(postings.join(hot, "token").unionByName(rest), "postings")
    scratch.drop("prefixes")

    heavy = shared.where(F.col("list") > p.light)
    weights = heavy.groupBy("key").agg(F.count("*").alias("heavy"))
    light = shared.where(F.col("list") <= p.light).select("token", "key", "n", "ell")
    other = light.select("token", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "ell")])
    fits = (F.col("key") < F.col("key2")) & (100 * F.least("n", "n2") >= p.percent * F.greatest("n", "n2"))
    pairs = light.join(other, "token").where(fits).groupBy("key", "key2").agg(F.count("*").alias("met"), F.min(F.least("ell", "ell2")).alias("ell"))
    by = [weights.select(F.col("key").alias(k), F.col("heavy").alias(h)) for k, h in (("key", "h1"), ("key2", "h2"))]
    pairs = pairs.join(by[0], "key", "left").join(by[1], "key2", "left")
    also = F.coalesce(F.least(F.coalesce("h1", F.lit(0)), F.coalesce("h2", F.lit(0))), F.lit(0))  # matches on long lists, at most
    pairs = pairs.where(F.col("met") + also >= F.col("ell")).select(F.col("key").alias("a"), F.col("key2").alias("b"))
    first = heavy.groupBy("token", "list").agg(F.min("key").alias("b"))
    few, many = (lambda d: d.where(F.col("list") <= most)), (lambda d: d.where(F.col("list") > most))
    stars = few(heavy).join(few(first), ["token", "list"]).unionByName(many(heavy).join(F.broadcast(many(first)), ["token", "list"]))
    stars = stars.select(F.col("key").alias("a"), "b")
    edges = scratch.save(pairs.union(stars).distinct(), "edges")
    scratch.drop("postings")
    links = scratch.save(verified_links(docs, edges, classes, order, p, scratch, id_col, text), "links")

    joined = components(links, scratch, "components")
    rooted = classes.join(joined, F.col("key") == F.col("node"), "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = scratch.save(rooted.join(least, "root").select(F.col("key").alias("of"), "component_id"), "labels")
    out = rows.join(labels, (rows["key"] == labels["of"]) & (rows["n"] > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


#: jaccard_components() over the view documents, by brute force: all pairs with a common shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
u AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n_shingles + nb.n_shingles - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, n_shingles, min(b) AS component_id FROM reach JOIN n ON n.doc_id = a GROUP BY ALL
"""
