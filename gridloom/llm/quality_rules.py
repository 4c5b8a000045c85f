"""Quality rules whose cutoffs carry a statistical guarantee (operator 4).

Each rule rejects a text when one statistic exceeds a cutoff. In each stratum (texts of like length) the cutoffs of all
rules are tightened along one path, a cutoff of one rule at a step, so the texts that any rule rejects only become more.
The path is followed for as long as the exact binomial (Clopper-Pearson) upper bound on the share of labelled good texts
that the rules together would reject stays within the budget. The path is laid by texts that are not labelled good, so it
does not depend on those that test it; testing ends at the first failure, so the steps need no correction among
themselves, and strata are corrected by Bonferroni. With probability 1 - `delta` at least, the rules together reject no
more than `max_false_rejection` of the good texts of any stratum.

Strata of neighbouring lengths are joined until each has the labelled good texts that a cutoff without a false rejection
needs: 217 each for four strata at the default budget, 149 for a single one. Only numbers of texts decide this, not what
the rules do to them, so the bound holds for the joined strata. With fewer labelled good texts in all no rule rejects.

Rows: a null text counts as empty. Extra columns are ignored. Repeated rows give repeated results, an empty table none.
Copies of one text are one trial, good if any of their labels is. Without labels no rule rejects.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .store import Scratch
from .words import Words, chunks

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, text_key long"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Upper ends of the strata, in words; the last stratum is open.
STRATA = (100, 300, 1000)
#: Of each rule: the statistic, and its cutoffs from the loosest to the strictest.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.06, 0.03),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeat_word_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08),
    "mean_word_length": (20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
}


#: How many cutoffs of each rule hold, in the order of GRIDS.
State = tuple[int, ...]


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_false_rejection: float = 0.02
    delta: float = 0.05


def _statistics(texts: list[str | None]) -> dict[str, pa.Array]:
    rows = []
    for first, run in chunks(texts):
        w = Words(run)
        cont = (w.buf & 0xC0) != 0x80
        inside = np.concatenate(([0], np.cumsum(w.inside & cont)))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[w.buf])))
        upper = np.concatenate(([0], np.cumsum((w.buf >= 65) & (w.buf <= 90))))
        span = lambda total: total[w.text_end] - total[w.text_start]
        counts = np.stack([np.diff(w.bounds), span(inside), span(symbols), span(upper)], axis=1)
        for i, s in enumerate(w.shingles(3, whole_if_fewer=False)):
            repeated = 0
            if len(s) > 1:
                _, place, times = np.unique(s, return_inverse=True, return_counts=True)
                hit = np.zeros(len(s) + 2, dtype=bool)
                twice = times[place] > 1
                for j in range(3):
                    hit[j : j + len(s)] |= twice
                repeated = int(hit.sum())
            lines = [x for x in (texts[first + i] or "").split("\n") if x.strip(" \t\n\v\f\r")]
            rows.append((*counts[i], len(lines), len(lines) - len(set(lines)), repeated))
    names = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(names)).T
    keys = [int.from_bytes(hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts]
    return {n: pa.array(c) for n, c in zip(names, columns, strict=True)} | {"text_key": pa.array(keys, pa.int64())}


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the counts of STATISTICS of each whole text."""
    return map_texts(docs, keep, text, STATISTICS, _statistics)


def _ratios() -> dict[str, F.Column]:
    words, per = F.col("n_words"), lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "mean_word_length": per("word_chars", "n_words"),
        "stratum": sum((words > b).cast("int") for b in STRATA),
    }


def base_failed(p: RuleParams) -> F.Column:
    return (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))


def binomial_cdf(k: int, n: int, q: float) -> float:
    """P(X <= k) for X binomial with n trials of chance q."""
    if q <= 0 or k >= n:
        return 1.0
    x = np.arange(k + 1)
    lg = np.cumsum(np.log(np.concatenate(([1.0], (n - x[1:] + 1) / x[1:]))))
    return float(min(1.0, np.exp(lg + x * math.log(q) + (n - x) * math.log1p(-q)).sum()))


def texts_needed(strata: int, p: RuleParams) -> int:
    """From how many good texts on a cutoff that rejects none of them is certified, where so many strata are judged."""
    return math.ceil(math.log(p.delta / strata) / math.log1p(-p.max_false_rejection))


def join_strata(good: list[int], p: RuleParams) -> list[int]:
    """For each stratum, from the numbers of good texts in them, the joined stratum (from 0) that it belongs to.

    While one has too few, the one with the fewest goes to that of its neighbours with fewer.
    """
    joined = [[i] for i in range(len(good))]
    size = lambda j: sum(good[i] for i in joined[j])
    while len(joined) > 1:
        least = min(range(len(joined)), key=size)
        if size(least) >= texts_needed(len(joined), p):
            break
        other = min((j for j in (least - 1, least + 1) if 0 <= j < len(joined)), key=size)
        a, b = sorted((least, other))
        joined[a : b + 1] = [joined[a] + joined[b]]
    return [k for k, members in enumerate(joined) for _ in members]


def learn_cutoffs(counts: dict[tuple[str, int], tuple[int, list[int]]], p: RuleParams, paths: dict[str, tuple] = GRIDS, strata: int = len(STRATA) + 1) -> dict[tuple[str, int], float | State]:
    """The strictest certified cutoff of each path and stratum; the paths share the budget.

    counts: the number of good holdout texts, and how many of them each cutoff of the path would reject. A cutoff is
    certified when no more than its count would be unlikely (below delta / tests) were the true share over the path's part.
    """
    tests, share = len(paths) * strata, p.max_false_rejection / len(paths)
    found = {}
    for (rule, stratum), (n, rejected) in counts.items():
        for cutoff, k in zip(paths[rule], rejected, strict=True):
            if n == 0 or binomial_cdf(k, n, share) > p.delta / tests:
                break
            found[rule, stratum] = cutoff
    return found


def lay_path(need: np.ndarray, bad: np.ndarray, other: np.ndarray) -> tuple[State, ...]:
    """States of the rules, each with one cutoff more than the one before, up to all cutoffs of all rules.

    need: for each kind of text and rule, from how many of the rule's cutoffs on it is rejected; bad and other: how many
    labelled bad and unlabelled texts are of that kind. First come cutoffs that reject nothing more, then those with the
    most bad texts for the others that they reject, then those that reject the fewest others.
    """
    ends = [len(g) for g in GRIDS.values()]
    state, path, left = [0] * len(ends), [], np.ones(len(need), dtype=bool)
    while state != ends:
        best = None
        for r, end in enumerate(ends):
            for to in range(state[r] + 1, end + 1):
                more = left & (need[:, r] <= to)
                gain, cost = int(bad[more].sum()), int(other[more].sum())
                key = (0, 0.0) if gain == cost == 0 else (1, -gain / (cost + 1)) if gain else (2, float(cost))
                if best is None or key < best[0]:
                    best = key, r, to
        _, r, to = best
        while state[r] < to:
            state[r] += 1
            path.append(tuple(state))
        left &= need[:, r] > to
    return tuple(path)


def certify(rows: list[tuple[tuple[int, ...], int, int, int]], p: RuleParams, strata: int = len(STRATA) + 1) -> State | None:
    """How many cutoffs of each rule hold in one of `strata` strata. rows: (need, texts labelled good, labelled bad, unlabelled)."""
    need = np.array([r[0] for r in rows]).reshape(-1, len(GRIDS))
    good, bad, other = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2, 3))
    path = lay_path(need, bad, other)
    rejected = [int(good[(need <= state).any(axis=1)].sum()) for state in path]
    return learn_cutoffs({("all", 0): (int(good.sum()), rejected)}, p, {"all": path}, strata).get(("all", 0))


def quality_rules(docs: DataFrame, labels: DataFrame, p: RuleParams = RuleParams(), id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """id, the statistics, base_failed, kept and the first rule that rejects (null: none).

    labels: id_col and quality (1: good). The texts are read once; their counts, a narrow table, are written, and only
    these meet the labels. Labelled texts are first reduced to one row a text. Counting is one aggregation, by the cutoffs
    that reject a text: a few numbers of steps a row, so its size is bounded by the grids.
    """
    ratios = _ratios()
    scratch = scratch or Scratch(docs.sparkSession, "rules")
    counted = scratch.save(statistics(docs, [id_col]), "statistics")
    known = labels.where("quality in (0, 1)").where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").alias("quality"))
    judged = counted.where(~base_failed(p))
    needs = [(F.lit(1) + sum((ratios[r] <= c).cast("int") for c in grid)).alias(r) for r, grid in GRIDS.items()]
    kinds = [ratios["stratum"].alias("stratum"), *needs]
    named = judged.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), "text_key", *kinds).join(known, "__id", "left").drop("__id")
    trials = named.where("quality is not null").groupBy("text_key", "stratum", *GRIDS).agg(F.max("quality").alias("quality")).drop("text_key")
    others = named.where("quality is null").drop("text_key").unionByName(judged.where(F.col(id_col).isNull()).select(*kinds, F.lit(None).cast("int").alias("quality")))
    kinds = trials.unionByName(others)
    number = lambda c: F.count(F.when(c, 1))
    quality = F.col("quality")
    kinds = kinds.groupBy("stratum", *GRIDS).agg(number(quality == 1).alias("good"), number(quality == 0).alias("bad"), number(quality.isNull()).alias("other"))
    counts = kinds.orderBy("stratum", *GRIDS).collect()
    of = join_strata([sum(r["good"] for r in counts if r["stratum"] == s) for s in range(len(STRATA) + 1)], p)
    found: dict[int, list] = {}
    for row in counts:
        found.setdefault(of[row["stratum"]], []).append((tuple(row[r] for r in GRIDS), row["good"], row["bad"], row["other"]))
    cutoffs = {}
    for joined, rows in found.items():
        for (rule, grid), steps in zip(GRIDS.items(), certify(rows, p, max(of) + 1) or (), strict=False):
            for stratum in (s for s, j in enumerate(of) if steps and j == joined):
                cutoffs[rule, stratum] = grid[steps - 1]
    fails = [
        (rule, F.coalesce(*[F.when(ratios["stratum"] == s, ratios[rule] > c) for (r, s), c in cutoffs.items() if r == rule], F.lit(False)))
        for rule in GRIDS
        if any(r == rule for r, _ in cutoffs)
    ]
    rule = F.coalesce(*[F.when(f, F.lit(r)) for r, f in fails], F.lit(None).cast("string"))
    out = counted.drop("text_key").withColumn("base_failed", base_failed(p))
    return out.withColumn("failed_rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
