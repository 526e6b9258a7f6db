"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are data: a mapping, or a table (license, text) read by `read_templates`; the default ones are notices and short licence texts.
Texts become tokens (runs of ASCII letters and digits and of other characters, A-Z lower-cased), hashed in bulk with numpy.  Each
template's k-grams are winnowed: of every w neighbouring ones the least hash is kept, so any shared run of
k + w - 1 tokens shares a fingerprint; k and w are K and WINDOW, and less for templates of under LONG tokens, which are notices.  The inverted index (fingerprint -> template, position) is small and goes out
with the task.  All k-grams of a document are looked up, first in a bit table and then in the index; hits of a
template whose diagonals lie within BAND of the first one's make a candidate.  If enough of the template's tokens are there at all, a local alignment of the template with the document around
those diagonals (a band of BAND to each side) gives the matched tokens, and so coverage (matched tokens of the template's)
and span; what matched is masked and the rest aligned again, until too little is left, so every repetition is found.  Matches of at least COVERAGE are reported; of
overlapping ones the one with most matched tokens.  Bands have a fixed width, so time is linear in the text and its hits.

Edge cases: null and empty text match nothing; templates under k tokens are one fingerprint of their own length and matched by it; repeated
rows are scanned one by one; long texts are scanned whole, and repeated notices in them are all reported; an empty table gives an empty result; clashing
columns of the input are replaced.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import chunks
from .common import arrow_batches, by_bytes, frugal
from .near_dedup import _BASE, _BYTE, mix

K, WINDOW, BAND, COVERAGE = 5, 4, 4, 0.8
#: Shorter templates have their own k and w.
LONG, NOTICE_K, NOTICE_WINDOW = 40, 3, 2
CHUNK = 250_000
_U = np.uint64
_PART = np.ones(256, bool)
_PART[:128] = False
_PART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

#: Notices and short texts of common licences (fixed values).  Neighbouring licences and versions are there so that the best match decides.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "proprietary": ["All rights reserved"],
}


def read_templates(table: DataFrame) -> dict[str, list[str]]:
    """Templates from a table (license, text): licence texts, as many as a worker holds an index of."""
    found: dict[str, list[str]] = {}
    for r in table.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL").distinct().orderBy("license", "text").collect():
        found.setdefault(r.license, []).append(r.text)
    return found


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of lower-cased text, and where they start and end in bytes."""
    raw = np.frombuffer(data, np.uint8)
    solid = _PART[raw]
    edges = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, _U), starts, ends
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    return mix(np.add.reduceat(_BYTE[raw[solid]] * powers[inside], firsts) + lengths.astype(_U)), starts, ends


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, _U)
    g = hashes[:n]
    for j in range(1, k):
        g = mix(g * _U(3) + hashes[j : j + n])
    return g


def winnow(g: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions kept: the rightmost least hash of every window."""
    if len(g) <= window:
        return [len(g) - 1 - int(g[::-1].argmin())] if len(g) else []
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1)).tolist()


class Index:
    """Templates by their winnowed fingerprints."""

    def __init__(self, templates: Mapping[str, list[str]]):
        self.names, self.hashes, self.at = [], [], {}
        self.sizes: set[int] = set()
        for name, texts in sorted(templates.items()):
            for text in texts:
                h = tokens(text.encode().lower())[0]
                k, window = (K, WINDOW) if len(h) >= LONG else (min(NOTICE_K, len(h)), NOTICE_WINDOW)
                if not k:
                    continue
                self.sizes.add(k)
                g = grams(h, k)
                for i in winnow(g, window):
                    self.at.setdefault((k, int(g[i])), []).append((len(self.names), i))
                self.names.append(name)
                self.hashes.append(h)
        self.table = np.zeros(1 << 16, bool)
        self.table[[g & 0xFFFF for _, g in self.at]] = True

    def seeds(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, its position, position in h) of shared fingerprints."""
        for k in self.sizes:
            g = grams(h, k)
            for i in np.flatnonzero(self.table[(g & _U(0xFFFF)).astype(np.int64)]).tolist():
                for template, j in self.at.get((k, int(g[i])), ()):
                    yield template, j, i


def align(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Local alignment of template a with text b on diagonals (position in b - in a) low..high: matched tokens, and
    the span [start, end) of b that they take.  A match scores 2, a gap or mismatch -1."""
    width = high - low + 1
    # per diagonal: score, matches, start of the alignment; the same for the row before
    previous = [(0, 0, -1)] * width
    best = (0, 0, 0, 0)
    for i in range(len(a)):
        row: list[tuple[int, int, int]] = []
        for d in range(width):
            j = i + low + d
            if j < 0 or j >= len(b):
                row.append((0, 0, -1))
                continue
            score, n, start = previous[d]
            if a[i] == b[j]:
                cell = (score + 2, n + 1, start if score > 0 else j)
            else:
                options = [(score - 1, n, start)]
                if d + 1 < width:
                    options.append((previous[d + 1][0] - 1, *previous[d + 1][1:]))
                if d:
                    options.append((row[d - 1][0] - 1, *row[d - 1][1:]))
                cell = max(options)
                if cell[0] <= 0:
                    cell = (0, 0, -1)
            row.append(cell)
            if a[i] == b[j] and cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
        previous = row
    return best[1], best[2], best[3]


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    start: int
    end: int


def occurrences(a: np.ndarray, h: np.ndarray, low: int, high: int, least: float) -> Iterator[tuple[int, int, int]]:
    """Matches (matched tokens, first token, past last token) of template a in text h on diagonals low..high: the best, then the best of what it
    leaves, and so on."""
    first, last = max(0, low), min(len(h), high + len(a))
    part = h[first:last].copy()
    while np.isin(a, part).sum() >= least * len(a):
        n, start, end = align(a, part, low - first, high - first)
        if n < least * len(a):
            return
        yield n, start + first, end + first
        part[start:end] = 0  # no token's hash but by chance, and then one token is lost


def scan_tokens(index: Index, h: np.ndarray, least: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first token, past last token, matched) without overlaps, in order."""
    diagonals: dict[int, set[int]] = {}
    for template, j, i in index.seeds(h):
        diagonals.setdefault(template, set()).add(i - j)
    found = set()
    for template, hits in diagonals.items():
        a = index.hashes[template]
        low = high = None
        for d in [*sorted(hits), None]:
            if low is not None and (d is None or d - low > BAND):
                for n, start, end in occurrences(a, h, low - BAND, high + BAND, least):
                    found.add((index.names[template], round(n / len(a), 4), start, end, n))
                low = None
            low, high = d if low is None else low, d
    out: list[tuple[str, float, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[4], -m[1], m[2], m[0])):
        at = bisect(out, m[2], key=lambda o: o[2])
        if (at == 0 or out[at - 1][3] <= m[2]) and (at == len(out) or out[at][2] >= m[3]):
            out.insert(at, m)
    return out


def scan_texts(index: Index, texts: list[str], least: float = COVERAGE) -> Iterator[list[Match]]:
    """The matches of each text, with spans in code points."""
    for chunk in chunks(texts, CHUNK):
        data = [t.encode().lower() for t in chunk]
        joined = b"\n".join(data) + b"\n"
        h, starts, ends = tokens(joined)
        begins = np.cumsum([0] + [len(d) + 1 for d in data])
        bounds = np.searchsorted(starts, begins)
        # texts without a fingerprint, which are most, cost no more than the bit table
        hot = np.zeros(len(h) + 1, np.int64)
        for k in index.sizes:
            g = grams(h, k)
            hot[1 : len(g) + 1] += index.table[(g & _U(0xFFFF)).astype(np.int64)]
        hot = np.cumsum(hot)
        for i, d in enumerate(data):
            a, b = int(bounds[i]), int(bounds[i + 1])
            found = scan_tokens(index, h[a:b], least) if hot[b] > hot[a] else []
            # code points before each byte
            before = np.cumsum(np.frombuffer(d, np.uint8) & 0xC0 != 0x80) if found else []
            place = lambda at: int(before[at - 1]) if at else 0  # noqa: B023, E731
            yield [Match(name, coverage, place(int(starts[a + s] - begins[i])), place(int(ends[a + e - 1] - begins[i]))) for name, coverage, s, e, _ in found]


def scan(docs: DataFrame, templates: Mapping[str, list[str]] | None = None, least: float = COVERAGE, text: str = "text") -> DataFrame:
    """docs' columns without the text, and licenses array<struct<license, coverage, start, end>> in text order."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates or TEMPLATES))
    kept = [c for c in docs.columns if c not in (text, "licenses")]
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["licenses array<struct<license: string, coverage: double, start: bigint, end: bigint>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in (part for whole in batches for part in by_bytes(whole)):
            found = [[vars(m) for m in ms] for ms in scan_texts(index, [t or "" for t in batch.column(text).to_pylist()], least)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(found, kind)], [*kept, "licenses"])

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(frugal(run), schema)
