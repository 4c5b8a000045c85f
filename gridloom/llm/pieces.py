"""SentencePiece encoding and decoding by suffix-array matching (operator 9).

The distinct stretches of a batch's texts (a run of word-boundary marks and what follows up to the next) are laid end to end
and indexed by a suffix array; a binary search of every piece of the vocabulary gives the range of its occurrences. These
are the edges of the segmentation lattice, sorted by position. Relaxation then depends on the model: in a unigram model the
best-scored path to each position; in a BPE model, edges replace two adjoining symbols in order of score, leftmost first.
Characters that no piece covers become byte pieces. Results equal those of the public library on the same model file.

Whole texts are encoded; a text's length is not bounded, long stretches are merged with a heap. Rows: a null text has null
ids, an empty one an empty list. Repeated rows and extra columns do not matter; an empty table gives no rows. The model
file's path is a parameter; the vocabulary is read on the driver and sent to the tasks.
"""

from __future__ import annotations

import heapq
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_NONE = np.int64(2**62)
_ID_BITS = 20


@dataclass
class Vocabulary:
    """Pieces with scores; `normal` marks those that match text, the others are control, unknown and byte pieces."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: list[int]
    unknown: int
    kind: str = "bpe"
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        # Stretches end where no piece reaches on: before a mark, and at line ends and tabs that no longer piece holds.
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        pattern = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.split: Callable[[str], list[str]] = (lambda t: [t] if t else []) if inner else pattern.findall
        long = [(p, i) for p, i in self.ids.items() if len(p) > 1 or self.kind == "unigram"]
        self.width = max((len(p) for p, _ in long), default=1)
        if self.width > 63:
            raise ValueError("a piece of more than 63 characters")  # a lattice key has six bits for a length
        self.codes = np.zeros((len(long), self.width), np.int64)
        for row, (p, _) in enumerate(long):
            self.codes[row, : len(p)] = [ord(c) for c in p]
        self.lengths = np.array([len(p) for p, _ in long], np.int64)
        self.piece_ids = np.array([i for _, i in long], np.int64)
        _, rank = np.unique(-self.scores, return_inverse=True)  # equal scores share a rank
        self.rank = rank.astype(np.int64)
        self.text = [p.replace(MARK, " ") for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    def spell(self, char: str) -> list[int]:
        """The ids of a character: its piece, else its bytes, else the unknown piece."""
        if (i := self.ids.get(char)) is not None:
            return [i]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


def load(path: str = MODEL, kind: str = "bpe") -> Vocabulary:
    """The vocabulary of a SentencePiece model file; kind: bpe or unigram."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    normal = np.array([not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)])
    by_byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    return Vocabulary([m.id_to_piece(i) for i in range(n)], np.array([m.get_score(i) for i in range(n)]), normal, [by_byte[b] for b in sorted(by_byte)], m.unk_id(), kind)


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Places in order of the `width` codes that follow them: as many as go into 63 bits at once, then by doubling."""
    ahead = lambda x, k: np.concatenate((x[k:], np.zeros(min(k, len(x)), np.int64)))
    held = np.zeros(int(codes.max(initial=0)) + 1, bool)
    held[codes] = True
    dense = np.cumsum(held)[codes]  # the codes numbered in order, from 1
    bits = int(dense.max(initial=1)).bit_length()
    k = 63 // bits
    key = np.zeros(len(codes), np.int64)
    for i in range(k):
        key = key << bits | ahead(dense, i)
    while k < width:
        _, rank = np.unique(key, return_inverse=True)
        key = (rank + 1) * (len(rank) + 2) + ahead(rank + 1, k)
        k *= 2
    return np.argsort(key, kind="stable")


def occurrences(codes: np.ndarray, order: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece the range of its occurrences in the suffix array, by binary search of all pieces at once.

    A first search is by the first two characters alone; only inside the ranges that it gives, whole pieces are compared."""
    padded = np.concatenate((codes, np.zeros(v.width, np.int64)))
    inside = np.arange(v.width) < v.lengths[:, None]
    pairs = ((padded[:-1] << 21) | padded[1:])[order]
    head, two = v.codes[:, 0] << 21, v.lengths > 1
    second = v.codes[:, 1] if v.width > 1 else np.zeros(len(v.codes), np.int64)
    first_low = np.searchsorted(pairs, np.where(two, head | second, head))
    first_high = np.searchsorted(pairs, np.where(two, (head | second) + 1, head + (1 << 21)))

    def bound(after: bool) -> np.ndarray:
        low, high = first_low.copy(), first_high.copy()
        while (open_ := low < high).any():
            rows = np.flatnonzero(open_)
            mid = (low[rows] + high[rows]) >> 1
            differ = np.where(inside[rows], padded[order[mid][:, None] + np.arange(v.width)] - v.codes[rows], 0)
            first = differ[np.arange(len(rows)), (differ != 0).argmax(axis=1)]
            right = first <= 0 if after else first < 0
            low[rows[right]] = mid[right] + 1
            high[rows[~right]] = mid[~right]
        return low

    return bound(False), bound(True)


def edges(codes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces, sorted by place and length: keys place * 64 + length, and the pieces' ids."""
    order = suffix_array(codes, v.width)
    low, high = occurrences(codes, order, v)
    times = high - low
    start = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times)
    place = order[start + np.arange(times.sum())]
    key = place * 64 + np.repeat(v.lengths, times)
    both = np.sort(key << _ID_BITS | np.repeat(v.piece_ids, times))
    return both >> _ID_BITS, both & ((1 << _ID_BITS) - 1)


class Lattice:
    """The stretches of a batch end to end (a 0 after each), with their edges."""

    def __init__(self, stretches: list[str], v: Vocabulary):
        self.v = v
        self.codes = np.frombuffer("".join(s + "\0" for s in stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.ends = np.cumsum([len(s) + 1 for s in stretches]) - 1
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        # A text may hold U+0000 itself: the separators are told apart by a code that no text has.
        self.codes[self.ends] = 0x110000
        self.keys, self.ids = edges(self.codes, v)

    def find(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The id of the piece that covers each span, or -1."""
        length = end - start
        if not len(self.keys):
            return np.full(len(start), -1)
        want = start * 64 + np.minimum(length, 63)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (length <= self.v.width), self.ids[at], -1)


def relax_merges(lattice: Lattice, short: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """BPE: the bounds of the spans that are left, in order, when no two adjoining ones of a stretch form a piece.

    All stretches advance together, each by its best merge in a round; after a merge only its two new pairs are looked up.
    """
    v = lattice.v
    size = lattice.ends - lattice.starts
    starts, ends = [], []
    for i in np.flatnonzero(size > short):
        for a, b in _merge_long(lattice, int(lattice.starts[i]), int(lattice.ends[i])):
            starts.append(np.array([a]))
            ends.append(np.array([b]))
    active = np.flatnonzero(size <= short)
    unit = np.repeat(active, size[active])
    place = np.arange(len(unit)) - np.repeat(np.cumsum(size[active]) - size[active], size[active])
    start = lattice.starts[unit] + place
    end = start + 1

    def worth(i: np.ndarray) -> np.ndarray:
        """The order of merging symbol i with the next: rank, then place."""
        last = i + 1 >= len(start)
        j = np.minimum(i + 1, len(start) - 1)
        piece = lattice.find(start[i], end[j])
        good = ~last & (unit[i] == unit[j]) & (piece >= 0)
        return np.where(good, v.rank[piece] * (1 << 40) + start[i], _NONE)

    pair = worth(np.arange(len(start))) if len(start) else np.zeros(0, np.int64)
    while len(start):
        head = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        best = np.repeat(np.minimum.reduceat(pair, head), np.diff(np.concatenate((head, [len(start)]))))
        chosen, done = pair == best, best == _NONE
        if done.any():
            starts.append(start[done])
            ends.append(end[done])
            unit, start, end, pair, chosen = (x[~done] for x in (unit, start, end, pair, chosen))
        left = np.flatnonzero(chosen)
        end[left] = end[left + 1]
        keep = np.ones(len(start), bool)
        keep[left + 1] = False
        left -= np.arange(len(left))
        unit, start, end, pair = unit[keep], start[keep], end[keep], pair[keep]
        fresh = np.unique(np.concatenate((left, left[left > 0] - 1)))
        pair[fresh] = worth(fresh)
    none = [np.zeros(0, np.int64)]
    start, end = np.concatenate(starts or none), np.concatenate(ends or none)
    order = np.argsort(start)
    return start[order], end[order]


def _merge_long(lattice: Lattice, first: int, last: int) -> list[tuple[int, int]]:
    """The same for one long stretch, with a heap of merges and linked symbols."""
    v = lattice.v
    places = np.arange(first, last)
    after = {p: p + 1 for p in range(first, last)}  # a symbol's start gives its end
    before = {p + 1: p for p in range(first, last)}
    found = lattice.find(places[:-1], places[1:] + 1)
    heap = [(int(v.rank[f]), int(p), int(p) + 1, int(p) + 2) for p, f in zip(places, found) if f >= 0]
    heapq.heapify(heap)

    def offer(a: int, b: int, c: int) -> None:
        piece = lattice.find(np.array([a]), np.array([c]))[0]
        if piece >= 0:
            heapq.heappush(heap, (int(v.rank[piece]), a, b, c))

    while heap:
        _, a, b, c = heapq.heappop(heap)
        if after.get(a) != b or after.get(b) != c:
            continue
        after[a], before[c] = c, a
        del after[b], before[b]
        if a > first:
            offer(before[a], a, c)
        if c < last:
            offer(a, c, after[c])
    spans, at = [], first
    while at < last:
        spans.append((at, after[at]))
        at = after[at]
    return spans


def relax_scores(lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Unigram: the bounds of the spans, in order, of each stretch's best-scored path; a character without a piece costs ten more than the worst piece."""
    v = lattice.v
    worst = float(v.scores[v.normal].min()) - 10
    key_start, key_length = lattice.keys >> 6, lattice.keys & 63
    scores = v.scores[lattice.ids]
    out = []
    for first, last in zip(lattice.starts.tolist(), lattice.ends.tolist()):
        best, back = [0.0] + [-np.inf] * (last - first), [0] * (last - first + 1)
        a, b = np.searchsorted(key_start, [first, last])
        at = a
        for p in range(first, last):
            here, single = best[p - first], False
            while at < b and key_start[at] == p:
                n = int(key_length[at])
                single |= n == 1
                if here + scores[at] > best[p - first + n]:
                    best[p - first + n], back[p - first + n] = here + scores[at], p
                at += 1
            if not single and here + worst > best[p - first + 1]:
                best[p - first + 1], back[p - first + 1] = here + worst, p
        spans, end = [], last
        while end > first:
            spans.append((back[end - first], end))
            end = back[end - first]
        out += spans[::-1]
    flat = np.array(out, np.int64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


class Encoder:
    """Encodes texts batch by batch. What a short stretch becomes is kept for later batches, in `keep_bytes` of memory and what one batch
    adds; longer stretches hardly come again and are encoded each time."""

    def __init__(self, v: Vocabulary, keep_bytes: int = 224 << 20, most_kept_chars: int = 64, most_chars: int = 1 << 20):
        self.v, self.keep_bytes, self.most_kept_chars, self.most_chars = v, keep_bytes, most_kept_chars, most_chars
        self.known: dict[str, bytes] = {}
        self.held_bytes = 0

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids (int32, as bytes) of each stretch."""
        lattice = Lattice(stretches, self.v)
        start, end = relax_merges(lattice) if self.v.kind == "bpe" else relax_scores(lattice)
        found = lattice.find(start, end)
        one = (found < 0) & (end - start == 1)  # single characters are no edges in a BPE lattice
        chars, place = np.unique(lattice.codes[start[one]], return_inverse=True)
        spelled = [self.v.spell(chr(c)) for c in chars.tolist()]
        times = np.ones(len(found), np.int64)
        times[one] = np.array([len(x) for x in spelled], np.int64)[place] if len(chars) else 1
        total = np.cumsum(times)
        flat = np.repeat(found, times).astype(np.int32)
        for at, i in zip((total - times)[one].tolist(), place.tolist()):
            flat[at : at + len(spelled[i])] = spelled[i]
        bounds = np.concatenate(([0], total))[np.searchsorted(start, lattice.ends)] * 4
        raw, before, out = flat.tobytes(), 0, {}
        for s, to in zip(stretches, bounds.tolist()):
            out[s] = raw[before:to]
            before = to
        return out

    def forget(self, made: dict[str, bytes]) -> None:
        """Drop the long ones of what was just learned, and everything once the short ones have taken keep_bytes."""
        for s, ids in made.items():
            if len(s) > self.most_kept_chars:
                del self.known[s]
            else:
                self.held_bytes += sys.getsizeof(s) + sys.getsizeof(ids) + 100  # the two objects and a place in the table
        if self.held_bytes > self.keep_bytes:
            self.known, self.held_bytes = {}, 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.v.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list({s for c in cut if c for s in c if s not in self.known})
        fresh: dict[str, bytes] = {}
        at = 0
        while at < len(new):
            run, held = [], 0
            while at < len(new) and (not run or held + len(new[at]) <= self.most_chars):
                held += len(new[at]) + 1
                run.append(new[at])
                at += 1
            fresh |= self.learn(run)
        self.known.update(fresh)
        get = self.known.__getitem__
        out = [None if c is None else np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]
        self.forget(fresh)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(v: Vocabulary) -> Encoder:
    """This process's encoder for v, so that one task's stretches serve the next."""
    if v.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[v.key] = Encoder(v)
    return _ENCODERS[v.key]


def decode(ids: list[int] | np.ndarray, v: Vocabulary) -> str:
    """The text of ids; byte pieces that are no UTF-8 together give U+FFFD."""
    get = v.text.__getitem__
    text = "".join(map(get, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    if not text.isascii():
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode_texts(docs: DataFrame, v: Vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep, n_tokens, ids, and whether decoding gives the text back (with U+2581 as a space)."""

    def make(texts: list[str | None]) -> dict[str, pa.Array]:
        found = encoder(v).encode(texts)
        flat = np.concatenate([f for f in found if f is not None] or [np.zeros(0, np.int32)])
        ends = np.concatenate(([0], np.cumsum([0 if f is None else len(f) for f in found]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array([f is None for f in found]))
        same = [None if f is None else decode(f, v) == t.replace(MARK, " ") for f, t in zip(found, texts, strict=True)]
        return {"n_tokens": pa.array([None if f is None else len(f) for f in found], pa.int64()), "ids": ids, "round_trip": pa.array(same, pa.bool_())}

    return map_texts(docs, keep, text, "n_tokens long, ids array<int>, round_trip boolean", make)


def decode_ids(encoded: DataFrame, v: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the column `text` decoded from its ids (null ids: null, no ids: empty); a column of that name is replaced."""
    encoded = encoded.select(*[c for c in encoded.columns if c != text])
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if x is None else decode(x, v) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, text])

    return encoded.mapInArrow(run, schema)
