"""Toxicity by a weighted finite-state grammar over clauses (operator 10).

Three kinds of machine are composed. Letter transducers read a word: the insult machine holds learned words and word
beginnings, the threat machine verb stems with their endings; each writes a symbol with a weight at the word's end. Word
transducers read a clause's symbols: they rewrite insults and threats that are negated, inside reported speech, or aimed at
a target before them; a last one, run from the right, sees targets that follow. The arcs that write a kind of match carry
that kind's weight. A clause scores the sum over kinds of arc weight times the log of one plus the lexical weight gathered.
A text's score is a logistic function of its strongest clause and of what its other matched clauses add.

The insult lexicon is learned: words and word beginnings that are much more frequent in toxic texts and there stand in
many different contexts (copies of one text thus count once). Only labels outside the held-out fold are used, of at most
about `sample` texts for each label, picked by a hash; all texts are scored whole. Threat, target, negation and report
words are the short lists below. One tokeniser serves learning and scoring: apostrophes part words ("idiot's", "you're"),
only contractions of "not" stay whole; typographic apostrophes are plain ones.

Rows: null and empty texts have no match and get the score of that. Ids may be null or repeated; extra columns are
ignored; an empty table gives no rows. Without usable labels the lexicon is empty and only threats at a target count.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import by_bytes, map_texts
from .quality_model import held_out
from .store import Scratch

# Fixed word lists of the grammar, in English, German, French and Spanish. Threats: stems, and the endings they take.
THREATS = [
    ("kill hurt destroy punish smash shoot stab stabb burn", ["", "s", "es", "ed", "ing"]),
    ("töt verletz zerstör schlag", ["e", "st", "t", "en", "et", "te", "ten"]),
    ("tu frapp bless", ["e", "es", "er", "ez", "ent", "erai", "era"]),
    ("détrui", ["re", "s", "t", "sent", "rai", "ra"]),
    ("mat golpe", ["ar", "o", "as", "a", "an", "aré", "ará", "ando"]),
    ("destru her", ["ir", "iré", "irá"]),
]
TARGETS = "you your yours yourself him his her them their they he she du dich dir dein deine euch ihr sie ihn ihm tu toi ton ta te vous votre il elle leur tú ti tus usted ustedes él ella ellos".split()
NEGATIONS = "not no never nobody nicht kein keine niemals nie non pas jamais aucun nunca jamás ningún ninguna".split()
REPORTS = "said says say claimed claims wrote reported quoted called sagte sagt behauptete schrieb dit disait affirma écrit dijo dice afirmó escribió".split()
# The end of the fixed lists.

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;\n]|[\"“”«»„]")
ENDS, QUOTES = ".!?;\n", '"“”«»„'
#: Symbols: I insult, T threat, G target, N negation, R report, Q quotation mark, E clause end, o other.
FIXED = {w: s for s, words in (("G", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("E", ENDS), ("Q", QUOTES)) for w in words}
#: Kinds of match that arcs write, with the arcs' weights before learning, and the weight of the clauses after the strongest.
KINDS = {"I": 1.0, "J": 1.3, "n": 0.3, "q": 0.4, "T": 0.0, "U": 1.0}
MORE = 0.5
THREAT_WEIGHT = 2.0
REACH = 3
PREFIXES = (4, 5, 6)
#: Entries that a task counts before it hands on their sums; words whose symbols a process keeps.
HELD_ENTRIES = 500_000


def tokens(text: str | None) -> list[str]:
    """Words in lower case, clause ends and quotation marks, in order."""
    low = (text or "").lower().replace("’", "'")
    found = TOKEN.findall(low)
    if "'" not in low:
        return found
    return [part for t in found for part in ([t] if "'" not in t or t.endswith("n't") else t.split("'"))]


def words(text: str | None) -> list[str]:
    return [t for t in tokens(text) if t not in ENDS and t not in QUOTES]


@dataclass(frozen=True)
class ToxicParams:
    sample: int = 6000
    min_ratio: float = 20.0
    min_power: float = 0.3  # of n toxic texts an entry must be in n ** min_power: 3 of 20, 5 of 180, 14 of 6000
    threshold: float = 0.5
    folds: int = 5
    ridge: float = 1.0
    bias: float = -2.5


@dataclass(frozen=True)
class Transducer:
    """A deterministic letter-to-letter machine: (state, symbol) gives (state, symbol); what is not listed is copied."""

    start: int
    moves: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (state, symbol))

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this machine writes, the other reads."""
        states = {(self.start, other.start): 0}
        moves, todo = {}, [(self.start, other.start)]
        while todo:
            a, b = pair = todo.pop()
            for s in "ITGNRQEoJUnq":
                a2, mid = self.step(a, s)
                b2, out = other.step(b, mid)
                if (a2, b2) not in states:
                    states[a2, b2] = len(states)
                    todo.append((a2, b2))
                moves[states[pair], s] = (states[a2, b2], out)
        return Transducer(0, moves)


def within(trigger: str, change: dict[str, str]) -> Transducer:
    """Rewrites the symbols of `change` up to REACH words after `trigger`, in the same clause. The state counts down."""
    moves = {}
    for left in range(REACH + 1):
        for s in "ITGNRQEoJUnq":
            after = REACH if s == trigger else 0 if s == "E" else max(0, left - 1)
            moves[left, s] = (after, change.get(s, s) if left else s)
    return Transducer(0, moves)


def reported() -> Transducer:
    """Rewrites matches between a report word or an opening quotation mark and the clause's end or the closing mark."""
    hide = {"I": "q", "J": "q", "n": "q", "U": "q", "T": "q"}
    moves = {}
    for s in "ITGNRQEoJUnq":
        moves[0, s] = ({"R": 1, "Q": 2}.get(s, 0), s)
        moves[1, s] = ({"E": 0, "Q": 2}.get(s, 1), hide.get(s, s))
        moves[2, s] = ({"Q": 0, "E": 0}.get(s, 2), hide.get(s, s))
    return Transducer(0, moves)


AIMED = {"I": "J", "T": "U"}
FORWARD = within("G", AIMED).then(within("N", {"I": "n", "J": "n", "T": "n", "U": "n"})).then(reported())
BACKWARD = within("G", AIMED)


class Letters:
    """A weighted letter transducer: it reads the letters of a word and gives the largest weight at the word's end.

    A path may end with the word, or be open: then it accepts whatever letters follow.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.closed: dict[int, float] = {}
        self.open: dict[int, float] = {}

    def add(self, letters: str, weight: float, is_open: bool = False) -> None:
        state = 0
        for c in letters:
            if c not in self.arcs[state]:
                self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
            state = self.arcs[state][c]
        ends = self.open if is_open else self.closed
        ends[state] = max(weight, ends.get(state, 0.0))

    def read(self, word: str) -> float:
        state, best = 0, 0.0
        for c in word:
            state = self.arcs[state].get(c, -1)
            if state < 0:
                return best
            best = max(best, self.open.get(state, 0.0))
        return max(best, self.closed.get(state, 0.0))


@dataclass
class Lexicon:
    """Weights of insult words and of beginnings of words."""

    weights: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)


class Grammar(dict):
    """Symbol of each word, read by the letter transducers when first met, and the clauses of texts with their matches."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(FIXED)
        self.insults, self.threats = Letters(), Letters()
        for found, is_open in ((lexicon.weights, False), (lexicon.starts, True)):
            for w, x in found.items():
                self.insults.add(w, x, is_open)
        for stems, endings in THREATS:
            for w in (a + b for a in stems.split() for b in endings):
                self.threats.add(w, THREAT_WEIGHT)

    def __missing__(self, word: str) -> str:
        if len(self) > HELD_ENTRIES:
            self.clear()
            self.update(FIXED)
        self[word] = s = "I" if self.insults.read(word) else "T" if self.threats.read(word) else "N" if word.endswith("n't") else FIXED.get(word, "o")
        return s

    def clauses(self, text: str | None) -> list[list[float]]:
        """For each clause with a match the log of one plus the lexical weight gathered by each of KINDS."""
        line = tokens(text)
        symbols = "".join(map(self.__getitem__, line))
        if "I" not in symbols and "T" not in symbols:
            return []
        out, at = [], 0
        for clause in symbols.split("E"):
            if "I" in clause or "T" in clause:
                found = dict.fromkeys(KINDS, 0.0)
                kinds = BACKWARD.run(FORWARD.run(clause)[::-1])[::-1]
                for i, s in enumerate(clause):
                    if s == "I":
                        found[kinds[i]] += self.insults.read(line[at + i])
                    elif s == "T":
                        found[kinds[i]] += self.threats.read(line[at + i])
                out.append([math.log1p(x) for x in found.values()])
            at += len(clause) + 1
        return out


@dataclass(frozen=True)
class Weights:
    """Weights of the arcs that write KINDS, of the clauses after the strongest, and a bias."""

    arcs: np.ndarray = field(default_factory=lambda: np.array([*KINDS.values()]))
    more: float = MORE
    bias: float = -2.5

    def features(self, clauses: list[list[float]]) -> np.ndarray:
        """The matches of the strongest clause, and the log of one plus what the others score together."""
        if not clauses:
            return np.zeros(len(KINDS) + 1)
        x = np.array(clauses)
        scores = x @ self.arcs
        best = int(scores.argmax())
        return np.append(x[best], math.log1p(max(0.0, scores.sum() - scores[best])))

    def score(self, clauses: list[list[float]]) -> float:
        z = float(self.features(clauses) @ np.append(self.arcs, self.more)) + self.bias
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, z))))


def entries(text: str | None) -> dict[str, int]:
    """The words and word beginnings of a text, each with a hash of its first left neighbour."""
    line = words(text)
    out: dict[str, int] = {}
    for left, w in zip(["", *line], line):
        if w not in out:
            near = hash_word(left)
            out[w] = near
            for k in PREFIXES:
                if len(w) >= k:
                    out.setdefault(w[:k] + "*", near)
    return out


def hash_word(word: str) -> int:
    """A small hash that is the same in every process."""
    h = 2166136261
    for c in word:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h & 0x7FFFFFFF


def _count(sample: DataFrame) -> DataFrame:
    """A row for each entry of the sample (toxic, half, text): clean_h and toxic_h, its texts of each label in half h, and
    near_h, its contexts in the toxic ones of that half. Counts are first summed within each task,
    of HELD_ENTRIES or a little more at a time.

    Contexts are counted as the bits that the hashes of left neighbours set, of 63: enough to tell few from many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, near = [Counter() for _ in range(4)], [Counter() for _ in range(2)]

        def summed() -> pa.RecordBatch:
            keys = list(set().union(*docs))
            columns = [pa.array(keys, pa.string())] + [pa.array([x[k] for k in keys], pa.int64()) for x in docs + near]
            for x in docs + near:
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for part in by_bytes(batches, "text"):
            for toxic, half, text in zip(*(part.column(c).to_pylist() for c in ("toxic", "half", "text")), strict=True):
                found = entries(text)
                docs[2 * toxic + half].update(found.keys())
                if toxic:
                    for e, left in found.items():
                        near[half][e] |= 1 << left % 63
                if sum(map(len, docs)) > HELD_ENTRIES:
                    yield summed()
        yield summed()

    names = ["entry", "clean_0", "clean_1", "toxic_0", "toxic_1", "near_0", "near_1"]
    rows = sample.select("toxic", "half", "text").mapInArrow(run, "entry string, " + ", ".join(f"{c} long" for c in names[1:]))
    return rows.groupBy("entry").agg(*[F.sum(c).alias(c) for c in names[1:5]], *[F.bit_count(F.bit_or(c)).alias(c) for c in names[5:]])


def _ratio(n: dict[tuple[int, int], int], halves: tuple[int, ...], p: ToxicParams) -> F.Column:
    """How much more frequent an entry of _count is in the toxic texts of `halves` than in their other texts; null where it
    is not frequent there, stands in few contexts or is not rare in the others. n: the texts by label and half.

    A half's toxic texts count from the second on, in two contexts: a single one may be chance, whatever the sample's size.
    """
    n_toxic, n_clean = (sum(n.get((y, h), 0) for h in halves) for y in (1, 0))
    least = max(2, math.ceil(n_toxic**p.min_power))
    twice = lambda c, h: F.when((F.col(f"toxic_{h}") >= 2) & (F.col(f"near_{h}") >= 2), F.col(f"{c}_{h}")).otherwise(0)
    docs, contexts = (sum(twice(c, h) for h in halves) for c in ("toxic", "near"))
    clean = sum(F.col(f"clean_{h}") for h in halves)
    ratio = ((docs + F.lit(0.5)) / (n_toxic + 1)) / ((clean + F.lit(0.5)) / (n_clean + 1))
    return F.when((docs >= least) & (contexts >= F.greatest(F.lit(float(least)), F.least(F.lit(40), docs) * F.lit(0.3))) & (ratio >= p.min_ratio), ratio)


def choose(counts: DataFrame, n: dict[tuple[int, int], int], p: ToxicParams) -> tuple[Lexicon, Lexicon, Lexicon]:
    """The lexicons of half 0, of half 1 and of both. All entries are judged in Spark; only what one takes is collected."""
    each = counts.select("entry", *[_ratio(n, h, p).alias(f"r{k}") for k, h in enumerate([(0,), (1,), (0, 1)])])
    out = Lexicon(), Lexicon(), Lexicon()
    for row in each.where("r0 is not null or r1 is not null or r2 is not null").toLocalIterator():
        for lexicon, ratio in zip(out, row[1:], strict=True):
            if ratio is not None:
                (lexicon.starts if row["entry"][-1] == "*" else lexicon.weights)[row["entry"].rstrip("*")] = math.log(ratio)
    return out


def learn(sample: DataFrame, p: ToxicParams) -> tuple[Lexicon, Weights]:
    """The lexicon and the weights from a bounded sample (toxic, half, text).

    The weights are learned from clauses that each half of the sample has with the other half's lexicon, so that words
    which only look toxic by chance lower them. Which clause is a text's strongest depends on the weights: a few rounds.
    """
    n = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    if not any(y == 1 for y, _ in n):
        return Lexicon(), Weights(bias=p.bias)
    first, second, both = choose(_count(sample), n, p)
    rows = map_texts(sample.where("half = 0"), ["toxic"], "text", "found array<array<double>>", _found(second))
    rows = rows.union(map_texts(sample.where("half = 1"), ["toxic"], "text", "found array<array<double>>", _found(first)))
    seen = [(r["found"], r["toxic"]) for r in rows.toLocalIterator()]
    weights = start = Weights(bias=p.bias)
    for _ in range(3):
        weights = learn_weights(np.array([weights.features(c) for c, _ in seen]), np.array([y for _, y in seen], float), start, p)
    return both, weights


def _found(lexicon: Lexicon):
    def make(texts: list[str | None]) -> dict[str, pa.Array]:
        grammar = Grammar(lexicon)
        return {"found": pa.array([grammar.clauses(t) for t in texts], pa.list_(pa.list_(pa.float64())))}

    return make


def learn_weights(x: np.ndarray, y: np.ndarray, start: Weights, p: ToxicParams) -> Weights:
    """Logistic weights; a ridge pulls them to the grammar's own, so they hold with few labels too."""
    theta = np.array([*start.arcs, start.more, start.bias])
    first, data = theta.copy(), np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(data @ theta, -30, 30)))
        grad = data.T @ (q - y) + p.ridge * (theta - first)
        hess = (data * (q * (1 - q))[:, None]).T @ data + p.ridge * np.eye(len(theta))
        move = np.linalg.solve(hess, grad)
        theta = theta - move
        if np.abs(move).max() < 1e-6:
            break
    theta[:-1] = np.maximum(theta[:-1], 0)
    return Weights(theta[:-2], float(theta[-2]), float(theta[-1]))


_GRAMMARS: dict[str, Grammar] = {}


def _grammar(token: str, lexicon: Lexicon) -> Grammar:
    """This process's grammar of one run, so that the words one batch has met serve the next."""
    if token not in _GRAMMARS:
        _GRAMMARS.clear()
        _GRAMMARS[token] = Grammar(lexicon)
    return _GRAMMARS[token]


def score_toxicity(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams(), id_col: str = "doc_id", keep: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The columns keep (else the id), held_out, score and predicted of every row of docs; labels: id_col and toxic (1: toxic).

    The labelled sample is bounded, so its ids are broadcast and its texts written; all texts are then read once.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    known = labels.where("toxic in (0, 1)").select(F.col(id_col).alias("__id"), "toxic").where("__id is not null").where(~held_out(F.col("__id"), p.folds))
    known = known.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, p.sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, p.sample / max(1, counts.get(0, 0))))
    known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < share * (1 << 30))
    known = known.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(2)).cast("int"))
    sample = docs.select(F.col(id_col).alias("__id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "__id")  # about 2 * sample ids
    lexicon, weights = learn(scratch.save(sample.select("toxic", "half", "text"), "sample"), p)
    token = uuid.uuid4().hex

    def score(texts: list[str | None]) -> dict[str, pa.Array]:
        grammar = _grammar(token, lexicon)
        return {"score": pa.array([weights.score(grammar.clauses(t)) for t in texts], pa.float64())}

    keep = keep or [id_col]
    if set(keep) & {"held_out", "score", "predicted"}:
        raise ValueError("keep: held_out, score and predicted are columns of the result")
    scored = map_texts(docs, keep, "text", "score double", score)
    return scored.select(*keep, held_out(F.col(id_col), p.folds).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
