"""License scan: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

A template of L words is sought in windows of L + L // 2 words, one every L // 4 words, so that any passage of up to
L + L // 4 words lies in one window whole. If a window contains THRESHOLD of a template's 3-word shingles, the two sets'
Jaccard similarity is at least about one half; with 24 bands of 2 hashes they then share a band with probability of about 0.999 or more.
What shares a band is verified by counting the template's shingles in the window. Windows without a single shingle of any
template have similarity 0 with all of them: their signatures are not computed, which changes no result.

Standard headers share most of their words (GPL-3.0's in AGPL-3.0's: 0.95), so templates compete for a place. Where most of a
template's shingles stand in its own order in the window is its place, and the share of them that does so its rank; by falling
rank, then length, each takes the words of its place, and what finds half or more of them taken by another license is not
reported. Notices at different places in a document do not compete. Of an SPDX
expression (MIT OR Apache-2.0) only the first license is read.

Templates are few and fixed (a parameter), so they travel with the code; the scan itself moves no rows.

Defined results: words are runs of letters, digits, underscores and non-ASCII bytes, in lower case; punctuation and line
breaks do not count. A null, empty or too short text has no license. Rows are scanned one by one: repeated rows give
repeated results. Of a license's several templates or places in a document the greatest containment counts, of equals the
first place. Rows without doc_id are left out; empty input gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from winnow.llm import vec
from winnow.llm.common import texts

K, BANDS, ROWS, THRESHOLD = 3, 24, 2, 0.92


_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Licenses whole, from the words after the copyright line.
BODIES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("BSD", f"{_TWO} {_BSD}"),
    ("BSD", f"{_TWO} {_THIRD} {_BSD}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

#: (license, notice): whole licenses, and the notices that the licenses' own publishers ask for.
TEMPLATES: tuple[tuple[str, str], ...] = (
    *BODIES,
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("All-Rights-Reserved", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {spdx}") for name, spdx in (("MIT", "MIT"), ("MIT-0", "MIT-0"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0"), ("GPL-3.0", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3.0"), ("AGPL-3.0", "AGPL-3.0"), ("BSD", "BSD-2-Clause"), ("BSD", "BSD-3-Clause"), ("ISC", "ISC"), ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"), ("CC-BY-ND-4.0", "CC-BY-ND-4.0"), ("CC-BY-NC-ND-4.0", "CC-BY-NC-ND-4.0"), ("CC0-1.0", "CC0-1.0"), ("0BSD", "0BSD"), ("Zlib", "Zlib"), ("BSL-1.0", "BSL-1.0"), ("EPL-2.0", "EPL-2.0"))),
)


def read_templates(folder: str) -> tuple[tuple[str, str], ...]:
    """(license, text) of the files <license>.txt or <license>.<anything>.txt of a folder, for scan(): licenses too long to be listed
    here, such as the GPL's whole text. Read on the driver; they are as few as licenses are."""
    out = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out.append((re.sub(r"(\.[a-z_]\w*)?\.txt$", "", name), f.read()))
    return tuple(out)


_FINE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = vec.seeded(BANDS * ROWS, 9)


def shingles(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the K words from each word on, the row of each word, words in each row); a shingle that would leave its row has hash 0."""
    low = vec.lower(b)
    s, e = vec.words(low, offs)
    h = vec.Hasher(low)(s, e)
    row = vec.owners(s, offs)
    g = np.zeros(len(h), np.uint64)
    if len(h) >= K:
        whole = row[K - 1 :] == row[: len(row) - K + 1]
        x = h[: len(h) - K + 1].copy()
        for k in range(1, K):
            x = x * _FINE + h[k : len(h) - K + 1 + k]
        g[: len(x)] = np.where(whole, np.maximum(vec.mix64(x), np.uint64(1)), 0)
    return g, row, np.bincount(row, minlength=len(offs) - 1)


def _signatures(sets: np.ndarray) -> np.ndarray:
    """Band hashes of rows of shingle hashes; 0 is padding."""
    out = np.empty((len(sets), BANDS), np.uint64)
    for k in range(BANDS):
        out[:, k] = 0
        for r in range(ROWS):
            x = vec.mix64(sets ^ _SEEDS[k * ROWS + r])
            x[sets == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
            out[:, k] = vec.mix64(out[:, k] + x.min(1))
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.names, self.threshold = [n for n, _ in templates], threshold
        self.sets, self.size, self.bands, self.order = [], [], [], []
        for _, t in templates:
            data = np.frombuffer(t.encode(), np.uint8)
            g, _, n = shingles(data, np.array([0, len(data)]))
            u = np.unique(g[g > 0])
            if not len(u):
                raise ValueError(f"a template needs {K} words: {t}")
            self.sets.append(u)
            self.order.append(g[g > 0])
            self.size.append(int(n[0]))
            self.bands.append(_signatures(u[None])[0])
        every = np.unique(np.concatenate(self.sets))
        self.map = vec.Lookup(12)
        self.map.put(every, np.arange(len(every)))

    def _place(self, t: int, window: np.ndarray) -> tuple[float, int]:
        """(share of a template's shingles that stand in its order, give or take a quarter of its length; where it begins)."""
        i, p = np.nonzero(self.order[t][:, None] == window)
        begin = int(np.bincount(p - i + len(self.order[t])).argmax()) - len(self.order[t])
        return len(np.unique(i[np.abs(p - i - begin) <= self.size[t] // 4])) / len(self.order[t]), begin

    def hits(self, b: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float, int, float, int]]:
        """(row, template, containment, first word of the window, rank, first word of its place) of a chunk."""
        g, row, n = shingles(b, offs)
        hits = np.flatnonzero((self.map.get(g) >= 0) & (g > 0))
        if not len(hits):
            return []
        first = np.cumsum(n) - n
        out = []
        for size in sorted(set(self.size)):
            wide, step = size + size // 2, max(1, size // 4)
            q = hits - first[row[hits]]
            low = np.maximum(0, -((wide - K - q) // step))
            count = np.maximum(0, q // step - low + 1)
            own = np.repeat(row[hits], count)
            windows = np.unique(np.stack([own, vec.expand(low, count) * step], 1), axis=0)
            cols = np.arange(wide - K + 1)
            mine = [t for t, s in enumerate(self.size) if s == size]
            for k in range(0, len(windows), 1 << 12):
                r, at = windows[k : k + (1 << 12)].T
                place = (first[r] + at)[:, None] + cols
                sets = np.where(at[:, None] + cols < n[r][:, None], g[np.minimum(place, len(g) - 1)], 0)
                bands = _signatures(sets)
                for t in mine:
                    for w in np.flatnonzero((bands == self.bands[t]).any(1)).tolist():
                        share = np.isin(self.sets[t], sets[w]).sum() / len(self.sets[t])
                        if share >= self.threshold:
                            rank, begin = self._place(t, sets[w])
                            out.append((int(r[w]), t, float(share), int(at[w]), rank, max(0, int(at[w]) + begin)))
        return out

    def _best(self, hits: list[tuple[int, int, float, int, float, int]]) -> list[tuple[int, str, float, int]]:
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for r, t, share, at, *_ in hits:
            key = (r, self.names[t])
            best[key] = max(best.get(key, (0.0, 0)), (share, -at))
        return [(r, name, share, -at) for (r, name), (share, at) in sorted(best.items())]

    def chunk(self, b: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, float, int]]:
        """(row, license, containment, first word of the window) of all licenses that a chunk contains, in order."""
        return self._best(self.hits(b, offs))

    def winners(self, b: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, float, int]]:
        """chunk() without the licenses that lose each of their places to another."""
        by: dict[int, list[tuple[int, int, float, int, float, int]]] = {}
        for hit in self.hits(b, offs):
            by.setdefault(hit[0], []).append(hit)
        licenses = {name: k for k, name in enumerate(dict.fromkeys(self.names))}
        left = []
        for hits in by.values():
            low = min(h[5] for h in hits)
            owner = np.full(max(h[5] + self.size[h[1]] for h in hits) - low, -1, np.int32)
            for hit in sorted(hits, key=lambda h: (-h[4], -len(self.sets[h[1]]), h[3], h[1])):
                begin, mine = hit[5] - low, licenses[self.names[hit[1]]]
                place = owner[begin : begin + self.size[hit[1]]]
                if 2 * np.count_nonzero((place >= 0) & (place != mine)) < len(place):
                    place[place < 0] = mine
                    left.append(hit)
        return self._best(left)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, containment, word) of each document and license found; word counts from 0 to the window's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            for i, b, offs in vec.chunks(batch.column(1)):
                found = scanner.winners(b, offs)
                if found:
                    r, name, share, at = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + x for x in r])), pa.array(name), pa.array(share), pa.array(at, pa.int64())], names=["doc_id", "license", "containment", "word"])

    return texts(docs).mapInArrow(run, "doc_id bigint, license string, containment double, word bigint")
