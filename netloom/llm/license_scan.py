"""License notices found by MinHash bands over overlapping windows and confirmed by exact shingle containment.

Templates fall into classes by length. A text's shingles are covered by windows of twice a class's length that overlap
by half, so each notice lies within a window. The bands of all templates' MinHash signatures are an index, in which the
bands of windows are looked up, so that the work for a window does not grow with the number of templates; rows and bands of a class follow from the least similarity that a containing window can have, so that the
chance of missing one is below ``LOSS``. Containment is then computed on the shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, the share of a template's shingles that a window must hold, the chance of a miss, and hashes at most.
SHINGLE, CONTAINED, LOSS, HASHES = 5, 0.75, 1e-6, 128
MEMORY = 100_000
#: Shingles of a text that are hashed at a time, a multiple of every window.
PART = 1 << 15

#: Notices and whole texts of public licenses, as they are commonly written.
LICENSES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_EDGES = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$")


class Words:
    """Hashes of words without case (ASCII) and without punctuation at their ends; words of punctuation alone do not count."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None, width: int = SHINGLE) -> np.ndarray:
        """The hash of the shingle at each word, in order; a shorter text is one shingle."""
        known, words = self.known, (text or "").encode().lower().split()
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(core) if (core := _EDGES.sub(b"", w)) else 0
        ids = np.array([h for w in words if (h := known[w])], np.uint64)
        width = min(width, len(ids))
        n = len(ids) - width + 1 if width else 0
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out


def band_settings(similarity: float, loss: float = LOSS, hashes: int = HASHES) -> tuple[int, int]:
    """(rows, bands): the most rows a band can have while windows of this similarity are missed with a chance below loss."""
    best = (1, ceil(log(loss) / log(1 - similarity)) if similarity < 1 else 1)
    for rows in range(2, 9):
        p = similarity**rows
        bands = ceil(log(loss) / log(1 - p)) if p < 1 else 1
        if rows * bands > hashes:
            break
        best = (rows, bands)
    return best


class BandIndex:
    """From the bands of signatures to the templates that have them."""

    def __init__(self, rows: int, bands: int, signs: list[np.ndarray]):
        self.rows, self.bands = rows, bands
        own = np.stack([s[: rows * bands].reshape(bands, rows) for s in signs]).reshape(-1, rows)
        keys = self.keys(own, np.tile(np.arange(bands), len(signs)))
        order = np.argsort(keys, kind="stable")
        self.sorted, self.template = keys[order], np.repeat(np.arange(len(signs)), bands)[order]
        self.free = np.uint32(32 - min(32, max(16, (64 * len(keys) - 1).bit_length())))
        self.held = np.zeros(1 << (32 - int(self.free)), bool)  # by a band's first hash: most bands are no template's at one look
        self.held[own[:, 0] >> self.free] = True

    @staticmethod
    def keys(hashes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """A 64-bit key for each row of hashes; a band's place is part of it."""
        out = (band + 1).astype(np.uint64)
        for r in range(hashes.shape[1]):
            out = (out ^ hashes[:, r].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xD6E8FEB86659FD93)

    def find(self, signs: np.ndarray) -> set[tuple[int, int]]:
        """(row of signs, template) for each that share a band."""
        window, band = np.nonzero(self.held[signs[:, :: self.rows] >> self.free])
        if not len(window):
            return set()
        wanted = self.keys(signs.reshape(len(signs), self.bands, self.rows)[window, band], band)
        first, last = np.searchsorted(self.sorted, wanted, "left"), np.searchsorted(self.sorted, wanted, "right")
        return {(int(window[k]), int(t)) for k in np.flatnonzero(first < last) for t in self.template[first[k] : last[k]]}


class Scanner:
    def __init__(self, templates: dict[str, str], contained: float = CONTAINED, loss: float = LOSS):
        self.words, self.contained, sets = Words(), contained, {}
        for name, text in templates.items():
            s = np.unique(self.words.shingles(text))
            if len(s):
                sets[name] = (s, len(self.words.shingles(text)))
        self.classes: dict[int, tuple[int, int, list]] = {}
        by: dict[int, list[str]] = {}
        for name, (_, length) in sets.items():
            by.setdefault(1 << (length - 1).bit_length(), []).append(name)
        for span, names in sorted(by.items()):
            least = min(contained * len(sets[n][0]) / (2 * span + (1 - contained) * len(sets[n][0])) for n in names)
            rows, bands = band_settings(least, loss)
            self.classes[span] = (rows, bands, [(n, sets[n][0]) for n in names])
        most = max((r * b for r, b, _ in self.classes.values()), default=1)
        rng = np.random.default_rng(1)
        self.factors = rng.integers(1, 1 << 32, most, dtype=np.uint32) | np.uint32(1)
        self.offsets = rng.integers(0, 1 << 32, most, dtype=np.uint32)
        self.index = {span: BandIndex(rows, bands, [self._hash(s).min(axis=0) for _, s in ts]) for span, (rows, bands, ts) in self.classes.items()}

    def _hash(self, shingles: np.ndarray) -> np.ndarray:
        """One row of hashes for each shingle."""
        return (shingles >> np.uint64(32)).astype(np.uint32)[:, None] * self.factors + self.offsets

    def _candidates(self, shingles: np.ndarray) -> Iterator[tuple[str, np.ndarray, int, int]]:
        """(template, its shingles, window's first shingle, its length): windows of 2 * span shingles, one each span.

        Minima of blocks are those of two blocks of half the length, so all classes share one pass of hashing. A text
        is taken in parts that overlap by the longest window.
        """
        longest = max(self.classes, default=1)
        for at in range(0, len(shingles), PART):
            block, size = self._hash(shingles[at : at + PART + longest]), 1
            while True:
                if size in self.classes:
                    rows, bands, templates = self.classes[size]
                    window = np.minimum(block, np.concatenate([block[1:], block[-1:]]))[: -(-PART // size), : rows * bands]
                    for i, t in sorted(self.index[size].find(window)):
                        yield *templates[t], at + i * size, 2 * size
                if size >= longest:
                    break
                even, odd = block[::2], block[1::2]
                if len(odd) < len(even):
                    odd = np.concatenate([odd, even[-1:]])
                block, size = np.minimum(even, odd), 2 * size

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, greatest containment, windows that contain it, first shingle of the first best) for each one found."""
        shingles, found = self.words.shingles(text), {}
        if not len(shingles):
            return []
        for name, own, at, size in self._candidates(shingles):
            share = len(np.intersect1d(own, shingles[at : at + size])) / len(own)
            if share >= self.contained:
                best, n, where = found.get(name, (0.0, 0, 0))
                found[name] = (share, n + 1, at) if share > best else (best, n + 1, where)
        return [(name, *found[name]) for name in sorted(found)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, n_windows, first_shingle: one row for each row of docs and template found in it.

    Null and empty texts hold none; a text shorter than a shingle is one shingle, and one of any length is scanned whole, in
    parts. Repeated rows are scanned each for itself, null ids stay null, other columns are not read, and an empty table
    gives an empty result. Templates travel with the task, as an index of their bands.
    """
    templates = LICENSES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, contained)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = scanner.scan(text)
                at += [i] * len(found)
                rows += found
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], names=["doc_id", "license", "containment", "n_windows", "first_shingle"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, containment double, n_windows long, first_shingle long")
