"""Mixing sources to target weights through a splitting tree (operator 7).

Native: DataFrame and SQL functions only. Sources in code-point order (null last) weigh `weights`, repeating, and share
all words; a target stops at `max_epochs` times its source's size and the excess goes to the others by weight. A source is
cut into blocks of documents by a hash of the id. It gives whole passes over all blocks, then blocks in permuted order
until its quota of words is met; of the block in which the quota ends, documents in permuted order, of the last of these
the first words. So the words taken from a source equal its target to within a word.

Output shards: the exact numbers of blocks of every source are split in two again and again; at each node half of the
blocks go left, their numbers by source drawn from the multivariate hypergeometric distribution (source by source, by
inverting the exact distribution function). A shard thus is a uniform draw without replacement of the whole mix. Its blocks
are the next ones of each source's permutation, its rows are shuffled by a hash. All draws are hashes of `seed`, so runs
agree. Places in a source's permutation are running sums over ranges of the hash that orders it, so no task orders all
blocks of a source; the tree's nodes are dealt to tasks again every few levels.

Rows: a null text has no words; a document without words is never taken. Equal rows are interchangeable. A null id is a
value like another. Extra columns do not matter. An empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    max_epochs: int = 3
    block_words: int = 250_000
    shard_words: int = 4_000_000
    seed: int = 7
    broadcast_sources: int = 100_000
    deal_every: int = 6
    tree_tasks: int = 4096
    ranges: int = 1024


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """source, source_size and target of each source; sizes: source, source_size, a row for each source.

    With sources in order of cap / weight, the capped ones come first; the level at which the others stand is found at the
    first source whose cap it does not pass.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.row_number().over(everything) - 1) % len(p.weights) + 1)
    rows = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * p.max_epochs).cast("double").alias("cap"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total - before) / left)
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def _let(values: dict[str, str], name: str, body: str) -> str:
    """SQL for `body` with the values bound to fields of `name`."""
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked ones among `drawn` of `total`, by inverting the distribution function at u.

    Twelve standard deviations about the mean are looked at; what lies beyond has a chance below 1e-30.
    """
    mean, spread = "h.n * h.k / greatest(h.t, 1D)", "sqrt(h.n * h.k / greatest(h.t, 1D) * (1 - h.k / greatest(h.t, 1D)) + 1)"
    bounds = {f: f"h.{f}" for f in "tknu"} | {
        "a": f"cast(greatest(0D, h.n + h.k - h.t, floor({mean} - 12 * {spread})) as bigint)",
        "b": f"cast(least(h.n, h.k, ceil({mean} + 12 * {spread})) as bigint)",
    }
    step = "if(x = g.a, 0D, s.lw + ln((g.k - x + 1) * (g.n - x + 1) / (x * (g.t - g.k - g.n + x))))"
    norm = _let(
        {"lw": step, "m": "s.m", "s": "s.s"}, "v", "named_struct('lw', v.lw, 'm', greatest(v.m, v.lw), 's', v.s * exp(v.m - greatest(v.m, v.lw)) + exp(v.lw - greatest(v.m, v.lw)))"
    )
    sums = f"aggregate(sequence(g.a, g.b), named_struct('lw', 0D, 'm', 0D, 's', 0D), (s, x) -> {norm})"
    find = _let({"lw": step, "c": "s.c", "r": "s.r"}, "v", "named_struct('lw', v.lw, 'c', v.c + exp(v.lw - z.m), 'r', if(v.c < g.u * z.s, x, v.r))")
    found = f"aggregate(sequence(g.a, g.b), named_struct('lw', 0D, 'c', 0D, 'r', g.a), (s, x) -> {find}, s -> s.r)"
    inner = f"element_at(transform(array({sums}), z -> {found}), 1)"
    body = _let(bounds, "g", inner)
    return _let({"t": f"cast({total} as double)", "k": f"cast({marked} as double)", "n": f"cast({drawn} as double)", "u": u}, "h", body)


def split_tree(quotas: DataFrame, levels: int, p: MixParams) -> DataFrame:
    """shard, source and quota for 2**levels shards; quotas: source, blocks (a row for each source)."""
    root = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("blocks").alias("q"), "source"))).alias("parts"))
    root = root.select(F.lit(0).cast("long").alias("shard"), "parts")
    draw = hypergeometric("a.total", "x.q", "a.rest", "x.u")
    taken = _let({"d": draw}, "y", "named_struct('rest', a.rest - y.d, 'total', a.total - x.q, 'out', concat(a.out, array(y.d)))")
    for level in range(levels):
        chance = f"(pmod(xxhash64({p.seed}, {level}, shard, i), 9007199254740992) + 0.5D) / 9007199254740992D"
        node = root.withColumn("total", F.expr("aggregate(parts, 0L, (a, x) -> a + x.q)"))
        node = node.withColumn("asked", F.expr(f"transform(parts, (x, i) -> named_struct('q', x.q, 'u', {chance}))"))
        start = "named_struct('rest', total div 2, 'total', total, 'out', cast(array() as array<bigint>))"
        node = node.withColumn("left", F.expr(f"aggregate(asked, {start}, (a, x) -> {taken}, a -> a.out)"))
        sides = "explode(array(named_struct('shard', shard * 2, 'parts', zip_with(parts, left, (x, n) -> named_struct('q', n, 'source', x.source))), named_struct('shard', shard * 2 + 1, 'parts', zip_with(parts, left, (x, n) -> named_struct('q', x.q - n, 'source', x.source)))))"
        root = node.select(F.expr(sides).alias("side")).select("side.*")
        if level % p.deal_every == p.deal_every - 1:
            root = root.repartition(min(2 ** (level + 1), p.tree_tasks), "shard")
    return root.select("shard", F.explode("parts").alias("x")).select("shard", "x.source", F.col("x.q").alias("quota"))


def mix(docs: DataFrame, keep: list[str], p: MixParams = MixParams(), scratch: Scratch | None = None) -> DataFrame:
    """The columns `keep` and, by document: size, source_size, target, taken and parts: array of (pass, shard, words).

    docs: text, source and the id in keep[0]. One narrow table of sizes is written; all later steps read that. Sums by
    source and by block are aggregated before they are shuffled; only the documents of one block of a source are ordered
    together. Source figures are broadcast when their counted number allows it.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch.save(docs.select(*[docs[c] for c in keep], docs["source"].alias("__source"), size.alias("size")), "sizes")
    return allot(rows, keep, p, scratch)


def running(df: DataFrame, key: str, order: str, amount: Column, after: list[str], p: MixParams) -> DataFrame:
    """df with `before`: the sum of `amount` over the rows of the same key that come earlier by order (a hash) and `after`.

    Rows are dealt to ranges of the hash; a range's start comes from the sums of the ranges, at most p.ranges of a key.
    """
    rows = df.withColumn("__amount", amount).withColumn("__range", F.floor((F.shiftright(order, 32) + F.lit(1 << 31)) / F.lit((1 << 32) // p.ranges)).cast("int"))
    sums = rows.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__nr")).agg(F.sum("__amount").alias("__sum"))
    ahead = Window.partitionBy("__key").orderBy("__nr").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__key", "__nr", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "__range").orderBy(order, *after).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    rows = rows.join(sums, _same(rows[key], sums["__key"]) & (rows["__range"] == sums["__nr"]))
    return rows.withColumn("before", F.col("__start") + F.col("__inside")).drop("__amount", "__range", "__key", "__nr", "__start", "__inside")


def _by_source(p: MixParams, sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= p.broadcast_sources else sources


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def allot(rows: DataFrame, keep: list[str], p: MixParams, scratch: Scratch) -> DataFrame:
    """mix() from a table that has the columns keep, __source and size."""
    mark = lambda *c: F.xxhash64(F.lit(p.seed), *c)
    sums = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sums, p).withColumn("quota", F.round("target").cast("long"))
    passes = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    plan = scratch.save(plan.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / p.block_words))), "plan")
    sources = _by_source(p, plan)
    block = F.pmod(mark(F.lit("block"), F.col(keep[0])), F.col("n_blocks"))
    docs = rows.join(sources, _same(rows["__source"], sources["source"])).withColumn("block", block).withColumn("order", mark(F.lit("doc"), F.col(keep[0])))

    # Blocks: permuted within their source; before: the words of the blocks ahead, for the partial pass.
    blocks = docs.groupBy("source", "block", "passes", "rest").agg(F.sum("size").alias("words")).withColumn("place", mark(F.lit("place"), "source", "block"))
    blocks = running(scratch.save(blocks.where("words > 0"), "placed"), "source", "place", F.col("words"), ["block"], p)
    blocks = scratch.save(blocks.withColumn("part", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before")))).drop("before"), "blocks")

    # Each pass over a block is one unit of the tree; each shard takes the next units of each source's permutation.
    units = blocks.select("source", "block", "words", "part", F.explode(F.expr("sequence(0, passes)")).alias("pass"), "passes")
    units = units.where("pass < passes or part > 0")
    quotas = units.groupBy("source").agg(F.count("*").alias("blocks"))
    words = plan.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, (int(words // p.shard_words)).bit_length())
    tree = scratch.save(split_tree(quotas, levels, p), "tree")
    # A shard's share of a source are the next `quota` units of its permutation: a row for each, met by place.
    tree = tree.where("quota > 0").withColumn("turn", mark(F.lit("shard"), "shard"))
    shares = running(tree, "source", "turn", F.col("quota"), ["shard"], p).select(F.col("source").alias("of"), "shard", F.explode(F.expr("sequence(before, before + quota - 1)")).alias("nr"))
    units = running(units.withColumn("turn", mark(F.lit("unit"), "source", "block", "pass")), "source", "turn", F.lit(1).cast("long"), ["block", "pass"], p)
    units = units.join(shares, _same(F.col("source"), F.col("of")) & (F.col("before") == F.col("nr")))
    placed = units.groupBy(F.col("source").alias("of"), F.col("block").alias("nr")).agg(F.sort_array(F.collect_list(F.struct("pass", F.col("shard").cast("int").alias("shard")))).alias("units"))  # passes + 1 at most
    none = F.expr("cast(array() as array<struct<pass: int, shard: int>>)")
    shards = blocks.join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nr")), "left")
    shards = shards.select(F.col("source").alias("of"), F.col("block").alias("nr"), "words", "part", F.coalesce("units", none).alias("units"))
    shards = scratch.save(shards, "shards")

    # Documents: whole passes, and of the partial pass all or, in the block where the quota ends, the first in order.
    docs = docs.join(shards, _same(docs["source"], shards["of"]) & (docs["block"] == shards["nr"]), "left")
    cut = (F.col("part") > 0) & (F.col("part") < F.col("words"))
    whole = docs.where(~F.coalesce(cut, F.lit(False))).withColumn("last", F.when(F.col("part") > 0, F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("source", "block").orderBy("order", *keep).rowsBetween(Window.unboundedPreceding, -1)
    cutting = docs.where(cut).withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("part") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    docs = whole.unionByName(cutting)
    parts = F.expr("filter(transform(units, x -> struct(x.pass as pass, x.shard as shard, if(x.pass < passes, size, last) as words)), x -> x.words > 0)")
    parts = F.coalesce(parts, F.expr("cast(array() as array<struct<pass: int, shard: int, words: bigint>>)"))
    taken = F.col("passes") * F.col("size") + F.col("last")
    return docs.select(*keep, "size", "source_size", "target", taken.cast("long").alias("taken"), parts.alias("parts"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", p: MixParams = MixParams(), scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: all columns of docs, a row for each time a document is taken, with shard and position order.

    A document of which only the first words are taken has these, joined by single spaces, as its text.
    """
    kept = [id_col, *[c for c in docs.columns if c != id_col]]
    if "source" not in docs.columns:
        raise ValueError("docs needs a column source")
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keys = {k: F.xxhash64(F.lit(k), *[F.col(c) for c in kept]) for k in ("__key", "__key2")}  # 128 bits tell rows apart
    narrow = scratch.save(docs.select(id_col, *[c.alias(k) for k, c in keys.items()], F.col("source").alias("__source"), size.alias("size")), "sizes")
    taken = allot(narrow, [id_col, *keys], p, scratch).where("taken > 0")
    # Equal rows share their keys: they are taken as one row with the sum of their parts.
    taken = taken.groupBy(*keys).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    full = docs.withColumns(keys).dropDuplicates([*keys]).withColumn("__size", size)
    out = full.join(taken, [*keys]).withColumn("__part", F.explode("parts"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("__part.words").cast("int")), " ")
    text = F.when(F.col("__part.words") < F.col("__size"), first).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns, F.col("__part.shard").alias("shard"), F.xxhash64(F.lit(p.seed), "__key", "__part.pass").alias("position"))
