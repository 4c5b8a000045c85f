"""Quality classifier learned from positives and unlabelled text (operator 2).

Method: non-negative risk minimisation. With trusted positives P, unlabelled text U and the class prior pi, the risk of a
scorer g is pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]); the second part estimates the risk on negatives without
any negative label and is kept from going below zero. The prior is estimated from first scorers of P against U, each from
one half of the samples and applied to the other: the least ratio of the two samples' shares above a score, less their
errors. The scorer is additive: a weight for each of a few ranges of each feature.
Its logistic output estimates the chance that a text is good.

Features are counts of the whole text; ids, languages and sources are no inputs. Training uses at most about `sample` rows
each of P and U, picked by a hash of the id; everything else covers all rows. Rows: a null text counts as empty and gets
a score as any other. Ids may be null or repeated (each row is scored). Extra columns are ignored. An empty table gives no
rows; without positives all scores are the prior's default of 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_texts
from .store import Scratch
from .words import Words, chunks, mix

FEATURES = (
    "log_words", "word_length", "upper", "symbols", "marks", "digits", "pipes", "repeat_windows", "echo", "distinct", "dup_lines", "words_per_line",
    "title_words", "end_marks", "top_word", "non_ascii", "long_words", "short_lines",
)


@dataclass(frozen=True)
class QualityParams:
    sample: int = 20_000
    bins: int = 12
    steps: int = 400
    rate: float = 0.05
    ridge: float = 2e-3
    margin: float = 2.0
    few: float = 300.0  # the penalty doubles at that many positives and goes on with the inverse of their number
    threshold: float = 0.3
    folds: int = 5


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves no remainder by `folds`."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def text_features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = []
    for first, run in chunks(texts):
        w = Words(run)
        buf, hashes = w.buf, w.hashes()
        lead = (buf & 0xC0) != 0x80
        total = {
            "chars": w.inside & lead, "upper": (buf >= 65) & (buf <= 90), "symbols": np.isin(buf, list(b"#*$%&|<>@^~=+\\")),
            "marks": np.isin(buf, list(b"!?;:")), "digits": (buf >= 48) & (buf <= 57), "pipes": buf == 124, "letters": (buf >= 97) & (buf <= 122), "wide": lead & (buf >= 128),
        }
        count = {}
        for k, v in total.items():
            c = np.concatenate(([0], np.cumsum(v)))
            count[k] = (c[w.text_end] - c[w.text_start]).astype(float)
        n = np.diff(w.bounds).astype(float)
        lengths = w.end - w.start
        by_word = {
            "long": lengths > 24, "title": (buf[w.start] >= 65) & (buf[w.start] <= 90), "end": np.isin(buf[w.end - 1], list(b".!?")),
            "echo": np.concatenate(([False], hashes[1:] == hashes[:-1])),
        }
        for k, v in by_word.items():
            c = np.concatenate(([0], np.cumsum(v)))
            count[k] = (c[w.bounds[1:]] - c[w.bounds[:-1]]).astype(float)
        rest = []
        for i, windows in enumerate(w.shingles(3, whole_if_fewer=False)):
            h = np.sort(mix(hashes[w.bounds[i] : w.bounds[i + 1]]))
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
            distinct, top = len(edge) - 1, int(np.diff(edge).max()) if len(h) else 0
            again = len(windows) - len(np.unique(windows))
            lines = [x for x in (texts[first + i] or "").split("\n") if x.strip(" \t\n\v\f\r")]
            short = sum(len(x) < 40 for x in lines)
            rest.append((distinct, top, again / max(len(windows), 1), len(lines), len(lines) - len(set(lines)), short))
        distinct, top, again, lines, dup, short = np.array(rest, float).T
        out.append(
            np.stack(
                [
                    np.log1p(n), _share(count["chars"], n), _share(count["upper"], count["upper"] + count["letters"]), _share(count["symbols"], n), _share(count["marks"], n),
                    _share(count["digits"], count["chars"]), _share(count["pipes"], n), again, _share(count["echo"], n), distinct / np.maximum(n, 1) ** 0.9, _share(dup, lines), np.log1p(_share(n, lines)),
                    _share(count["title"], n), _share(count["end"], n), _share(top, n), _share(count["wide"], count["chars"]), _share(count["long"], n), _share(short, lines),
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _features(texts: list[str | None]) -> dict[str, pa.Array]:
    x = text_features(texts).astype(np.float32)
    return {"features": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.ravel()))}


@dataclass
class Additive:
    """g(x): a bias and a weight for the range of each feature that x lies in."""

    edges: list[np.ndarray]
    weights: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def logit(self, cells: np.ndarray) -> np.ndarray:
        return self.bias + sum((w[cells[:, i]] for i, w in enumerate(self.weights)), np.zeros(len(cells)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each feature: quantiles, with finer ones in both tails, where bad texts lie."""
    at = np.unique(np.concatenate(([0.005, 0.02, 0.05], np.linspace(0, 1, bins)[1:-1], [0.95, 0.98, 0.995])))
    return [np.unique(np.quantile(x[:, i], at)) for i in range(x.shape[1])]


def _descend(model: Additive, sides: list[tuple[np.ndarray, float, float]], p: QualityParams, guard: bool) -> None:
    """Adam on sum of scale * mean log(1 + exp(-sign * g)) over (cells, sign, scale), with an L2 penalty.

    guard: the parts after the first are the estimated risk on negatives; while it is below zero only it is raised.
    """
    params = [*model.weights, np.array([model.bias])]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, p.steps + 1):
        grads, risks = [], []
        for cells, sign, scale in sides:
            z = sign * model.logit(cells)
            risks.append(scale * np.logaddexp(0, -z).mean())
            slope = -sign * scale * _sigmoid(-z) / len(z)
            grads.append([np.bincount(cells[:, i], slope, len(w)) for i, w in enumerate(model.weights)] + [np.array([slope.sum()])])
        below = guard and sum(risks[1:]) < 0
        for i, x in enumerate(params):
            g = -sum(part[i] for part in grads[1:]) if below else sum(part[i] for part in grads)
            g = g + (p.ridge * x if i < len(model.weights) else 0)
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            x -= p.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
        model.bias = float(params[-1][0])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 0.0) -> float:
    """The least ratio of the shares of the unlabelled and of the positive scores above a score that half the positives pass.

    It is lowered by the shares' errors (of order 1 / sqrt(n) each, times `margin`): with too large a prior the estimated
    risk on negatives is below zero for every good scorer, and the guard would keep it from telling the two apart.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    ratio = (above(unlabelled) / np.maximum(above(positive), 1e-9)).min()
    return float(np.clip(ratio / (1 + margin * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, p: QualityParams) -> tuple[Additive, float]:
    """The scorer and the estimated prior from the feature rows of positives and of unlabelled texts."""
    p = replace(p, ridge=p.ridge * (1 + p.few / len(positive)))
    edges = _edges(np.concatenate([positive, unlabelled]), p.bins)
    fresh = lambda: Additive(edges, [np.zeros(len(e) + 1) for e in edges])
    model = fresh()
    cp, cu = model.cells(positive), model.cells(unlabelled)
    priors = []
    for half in (0, 1) if min(len(cp), len(cu)) > 1 else ():
        first = fresh()
        _descend(first, [(cp[half::2], 1.0, 1.0), (cu[half::2], -1.0, 1.0)], p, guard=False)
        priors.append(estimate_prior(first.logit(cp[1 - half :: 2]), first.logit(cu[1 - half :: 2]), p.margin))
    prior = float(np.mean(priors or [0.5]))
    _descend(model, [(cp, 1.0, prior), (cu, -1.0, 1.0), (cp, -1.0, -prior)], p, guard=True)
    return model, prior


def score_quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", keep: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The columns keep (else the id), held_out, score and predicted of every row of docs; labels: id_col and quality (1: good).

    The texts are read once. Their features, a narrow table, are written; the sample and the scores come from that. With
    `keep`, rows are scored from their texts in a second reading instead, so that wide columns need no join.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    rows = scratch.save(map_texts(docs, [id_col], "text", "features array<float>", _features), "features")
    good = labels.where("quality = 1").select(F.col(id_col).alias("__id")).where("__id is not null").where(~held_out(F.col("__id"), p.folds)).distinct()
    n_good, n_rows = good.count(), rows.count()
    some = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(1 << 30)) < int((1 << 30) * min(1.0, p.sample / max(n, 1)))
    picked = rows.join(good.where(some(F.col("__id"), n_good, "p")), rows[id_col] == F.col("__id"), "left_semi")
    others = rows.where(F.coalesce(some(F.col(id_col), n_rows, "u"), F.lit(True)))  # as collected web text, good and bad
    matrix = lambda df: np.array([r[0] for r in df.select("features").toLocalIterator()], float).reshape(-1, len(FEATURES))
    positive, unlabelled = matrix(picked), matrix(others)
    model = fit(positive, unlabelled, p)[0] if len(positive) and len(unlabelled) else None

    def score(x: np.ndarray) -> pa.Array:
        return pa.array(_sigmoid(model.logit(model.cells(x.astype(np.float32).astype(float)))) if model else np.full(len(x), 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(id_col), score(x)], names=[id_col, "score"])

    if keep and set(keep) & {"held_out", "score", "predicted"}:
        raise ValueError("keep: held_out, score and predicted are columns of the result")
    if keep:
        scored = map_texts(docs, keep, "text", "score double", lambda texts: {"score": score(text_features(texts))})
    else:
        scored = rows.select(id_col, "features").mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())]))
    return scored.select(*(keep or [id_col]), held_out(F.col(id_col), p.folds).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
