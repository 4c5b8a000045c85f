"""License scan: windows retrieved by MinHash bands, matches verified by shingle containment (operator 1).

Templates are wordings of license notices and license texts. Every text is seen through overlapping windows of shingles, at
a few scales. A scale serves templates of up to `shingles` shingles: the next window begins half as many later, and any
passage of up to `slack` times as many lies in one window whole. Of every window the least hashes under a number of
permutations are its one-row bands; a window retrieves the templates that share a band with it. A template contained to
`containment` in a window has at least a known Jaccard similarity with it, and the number of bands is chosen from that so
that the chance of missing a window is below `miss`. Retrieved pairs are verified exactly on the words: the share of the
template's shingles that the window has.

Words are runs of ASCII letters, digits, underscores and characters beyond ASCII, with A-Z in lower case; typographic
quotation marks and dashes part words. A template of fewer words than a shingle is one shingle. Rows: a null or empty text
has no matches. Rows with equal ids are one document. Extra columns are ignored. An empty table, or no templates, gives no
rows. Result: a row for each document and license found, with its best wording.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import by_bytes
from .words import Words, chunks

# Wordings of widely used licenses.
_WARRANTY = (
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
)
_FORMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation"
_CC = "This work is licensed under a Creative Commons {0} International License."
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License",
        "is licensed under the MIT License",
        "under the terms of the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "under the terms of the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License version 3",
        _GNU.format("This program", "") + ", either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL": (_GNU.format("This library", "Lesser"),),
    "AGPL": (_GNU.format("This program", "Affero"),),
    "BSD-2-Clause": (_FORMS + _AS_IS + _WARRANTY,),
    "BSD-3-Clause": (_FORMS + _NAMES + _AS_IS + _WARRANTY,),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format("Attribution-NonCommercial 4.0")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format("Attribution 4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format("Attribution-ShareAlike 4.0")),
    "CC0-1.0": ("has waived all copyright and related or neighboring rights to this work", "dedicated to the public domain under CC0 1.0"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
}
# The end of the fixed values.

_PARTS = "“”‘’–—…«»"
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")


@dataclass(frozen=True)
class LicenseParams:
    shingle_words: int = 5
    containment: float = 0.8
    miss: float = 1e-4
    slack: float = 1.25
    max_templates: int = 10_000  # bounds what goes to every task
    seed: int = 11


def _plain(text: str) -> str:
    if not text.isascii():
        for c in _PARTS:
            text = text.replace(c, " ")
    return text


def _words(text: str) -> list[bytes]:
    return _WORD.findall(_plain(text).encode("utf-8", "surrogatepass").translate(_LOW))


_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


class Scale:
    """The templates of one shingle length and similar numbers of shingles: windows, permutations and the bands' values."""

    def __init__(self, k: int, shingles: int, names: list[int], sets: list[set[bytes]], hashes: list[np.ndarray], p: LicenseParams):
        self.k, self.names, self.sets = k, names, sets
        self.stride = max(1, shingles // 2)
        self.window = max(shingles, int(p.slack * shingles)) + self.stride - 1
        needed = [(math.ceil(p.containment * len(s)), len(s)) for s in sets]
        self.jaccard = min(hit / (self.window + n - hit) for hit, n in needed)
        self.bands = 1 if self.jaccard >= 1 else math.ceil(math.log(p.miss) / math.log1p(-self.jaccard))
        least = np.array([[permuted(h, b, p.seed).min() for b in range(self.bands)] for h in hashes], np.uint64)
        order = np.argsort(least, axis=0, kind="stable")
        self.values = np.take_along_axis(least, order, axis=0).T.copy()  # of each band, sorted
        self.owner = order.T.copy()

    def spans(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and end shingle of every window; bounds: where each text's shingles begin, and the end of the last."""
        size = np.diff(bounds)
        times = -(-size // self.stride)
        text = np.repeat(np.arange(len(size)), times)
        start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)) * self.stride
        return text, start, np.minimum(start + self.window, bounds[text + 1])


def permuted(h: np.ndarray, band: int, seed: int) -> np.ndarray:
    """The hashes in the order of the band's permutation."""
    a, b = np.random.Generator(np.random.PCG64([seed, band])).integers(1, 2**63, 2, dtype=np.uint64)
    mixed = (h ^ b) * (a | np.uint64(1))
    return mixed ^ (mixed >> np.uint64(29))


class Scanner:
    """Retrieves templates by the windows of texts and verifies them."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], p: LicenseParams):
        self.p = p
        self.licenses = [name for name, _ in templates]
        grouped: dict[tuple[int, int], list[int]] = defaultdict(list)
        sets = []
        for i, (_, words) in enumerate(templates):
            k = min(p.shingle_words, len(words))
            sets.append(_shingles(words, k))
            size = 1
            while size < len(sets[-1]):
                size = max(size + 1, size * 3 // 2)
            grouped[k, size].append(i)
        self.scales: dict[int, list[Scale]] = defaultdict(list)
        for (k, size), own in grouped.items():
            hashes = [np.unique(Words([b" ".join(templates[i][1])]).shingles(k)[0]) for i in own]
            self.scales[k].append(Scale(k, size, own, [sets[i] for i in own], hashes, p))

    def retrieved(self, h: np.ndarray, bounds: np.ndarray, scales: list[Scale]) -> Iterator[tuple[Scale, int, int, int, int]]:
        """Scale, text, first and end shingle, and template of each window and template that share a band."""
        spans = [s.spans(bounds) for s in scales]
        pairs: list[set[tuple[int, int]]] = [set() for _ in scales]
        for band in range(max(s.bands for s in scales)):
            mixed = np.append(permuted(h, band, self.p.seed), np.uint64(2**64 - 1))  # a last one, so that every end is a place
            for s, (_, start, end), found in zip(scales, spans, pairs):
                if band >= s.bands:
                    continue
                least = mixed[start] if s.window == 1 else np.minimum.reduceat(mixed, np.stack([start, end], axis=1).ravel())[::2]
                values = s.values[band]
                low = np.searchsorted(values, least)
                for i in np.flatnonzero(values[np.minimum(low, len(values) - 1)] == least).tolist():
                    for j in range(int(low[i]), int(np.searchsorted(values, least[i], side="right"))):
                        found.add((i, int(s.owner[band, j])))
        for s, (text, start, end), found in zip(scales, spans, pairs):
            for i, j in sorted(found):
                yield s, int(text[i]), int(start[i]), int(end[i]), j

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, str, float, int, int]]:
        """Text, license, containment and first word of the best window, and number of windows that match."""
        for first, run in chunks([_plain(t or "") for t in texts]):
            w = Words(run, lower=True, inside=_INSIDE)
            best: dict[tuple[int, str], tuple[float, int]] = {}
            windows: dict[tuple[int, str], set] = defaultdict(set)
            for k, scales in self.scales.items():
                each = w.shingles(k, whole_if_fewer=False)
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in each])))
                if not bounds[-1]:
                    continue
                for s, text, start, end, j in self.retrieved(np.concatenate(each), bounds, scales):
                    at = start - int(bounds[text])
                    words = w.spelled(int(w.bounds[text]) + at, int(w.bounds[text]) + at + end - start + k - 1)
                    share = len(s.sets[j] & _shingles(words, k)) / len(s.sets[j])
                    if share >= self.p.containment:
                        key = text, self.licenses[s.names[j]]
                        windows[key].add((s.window, at))
                        best[key] = max(best.get(key, (0.0, 0)), (share, -at))
            for (text, name), (share, place) in best.items():
                yield first + text, name, share, -place, len(windows[text, name])


def scan(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, p: LicenseParams = LicenseParams(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, license, containment, first_word (of the best window) and windows (that match), a row for each license found."""
    spark = docs.sparkSession
    wordings = [(n, t) for n, ts in (TEMPLATES if templates is None else templates).items() for t in ((ts,) if isinstance(ts, str) else ts)]
    worded = [(n, w) for n, t in wordings if (w := _words(t))]
    if len(worded) > p.max_templates:
        raise ValueError(f"more than {p.max_templates} templates: scan with a part of them at a time")
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("license string, containment double, first_word long, windows long")])
    if not worded:
        return spark.createDataFrame([], schema)
    scanner = Scanner(worded, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text"):
            rows = list(scanner.scan(part.column("text").to_pylist()))
            if rows:
                at, *columns = zip(*rows, strict=True)
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    found = docs.select(docs[id_col].alias(id_col), docs[text].alias("text")).mapInArrow(run, schema)
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("place")))
    out = found.groupBy(id_col, "license").agg(best.alias("best"), F.sum("windows").alias("windows"))  # rows with equal ids
    return out.select(id_col, "license", F.col("best.containment").alias("containment"), (-F.col("best.place")).alias("first_word"), "windows")
