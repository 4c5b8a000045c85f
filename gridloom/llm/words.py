"""Vectorised word and shingle hashes of a batch of texts (a helper for code inside tasks).

A word is a maximal run of characters other than space, tab, LF, VT, FF and CR. Texts are hashed as UTF-8 bytes in
pieces of about ``CHUNK_BYTES``, so memory stays bounded whatever the size of an Arrow batch; a longer text is a piece
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 18
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_COEF = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, up to exponent n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 65536)
        inverse = pow(_BASE, -1, 2**64)
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 (null: empty) of about CHUNK_BYTES, each with the place of its first text."""
    first, run, held = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and held + len(data) > CHUNK_BYTES:
            yield first, run
            first, run, held = i, [], 0
        run.append(data)
        held += len(data) + 1
    if run:
        yield first, run


class Words:
    """The words of one run of texts: bytes, word bounds, word hashes and, by text, the range of its words.

    inside: by byte whether it belongs to a word, where words are not just what white space leaves.
    """

    def __init__(self, run: list[bytes], lower: bool = False, inside: np.ndarray | None = None):
        buf = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
        self.buf = buf = _LOWER[buf] if lower else buf
        inside = ~_SEP[buf] if inside is None else inside[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.inside = inside
        sizes = np.fromiter(map(len, run), np.int64, len(run)) + 1
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        last = np.searchsorted(self.start, self.text_end)
        self.bounds = np.concatenate(([0], last))

    def spelled(self, first: int, last: int) -> list[bytes]:
        """The words from the first to before the last."""
        raw = self.buf.data
        return [bytes(raw[a:b]) for a, b in zip(self.start[first:last].tolist(), self.end[first:last].tolist())]

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self.buf))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[self.buf] * up[: len(self.buf)], dtype=np.uint64)))
        length = (self.end - self.start).astype(np.uint64)
        return mix((total[self.end] - total[self.start]) * down[self.start] + length * _COEF[63])

    def shingles(self, k: int, whole_if_fewer: bool = True) -> list[np.ndarray]:
        """By text the hash of each window of k words in order; with fewer words, the whole sequence as one."""
        h = self.hashes()
        n = len(h)
        windows = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            windows += h[j : n - k + 1 + j] * _COEF[j] if n >= k else np.zeros(0, np.uint64)
        windows = mix(windows + np.uint64(k))
        out = []
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            if b - a >= k:
                out.append(windows[a : b - k + 1])
            elif b > a and whole_if_fewer:
                out.append(mix((h[a:b] * _COEF[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def shingle_sets(texts: list[str | None], k: int, lower: bool) -> Iterator[np.ndarray]:
    """By text the sorted distinct hashes of its k-word shingles."""
    for _, run in chunks(texts):
        for s in Words(run, lower).shingles(k):
            yield np.unique(s)
