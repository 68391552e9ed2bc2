"""Licences in texts: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are grouped by length; for each group, windows of twice the group's least number of shingles,
moved by a quarter of that, slide over each text. A band is one MinHash value. A window that holds at
least `containment` of a template has a Jaccard similarity of at least J with it, J following from the
window's size, and escapes all bands with probability (1 - J)**bands: 1e-4 or less at the settings here.
What a window retrieves is compared shingle by shingle, over the window and a template's length on both
sides, so that a copy counts whole however the windows cut it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbits import U64, bare_word, block_words, blocks, mix, text_buffers

#: Texts that BSD licences share (fixed values; public wording).
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licence texts and notices by licence (fixed values; public wording).
TEMPLATES = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "BSD-2-Clause": (_BSD + _BSD_END,),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        _BSD + _BSD_THIRD + _BSD_END,
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "LGPL-2.1": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "MIT-0": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
        be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution.""",
    ),
}


@dataclass(frozen=True)
class LicenseScanConfig:
    """Words of a shingle, containment that counts as a match, MinHash values of a window, and whether similar templates of other licences are told apart."""

    width: int = 5
    containment: float = 0.8
    bands: int = 32
    tell_apart: bool = False


def _word_hash(text: str) -> int:
    value = 1469598103934665603
    for byte in text.encode():
        value = (value ^ byte) * 1099511628211 % (1 << 64)
    return value


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` word hashes, in order; a shorter text is one run."""
    n = max(len(words) - width + 1, min(len(words), 1))
    total = np.zeros(n, U64)
    for k in range(min(width, len(words))):
        total = mix(total + words[k : n + k] * U64(0x9E3779B97F4A7C15) + U64(k + 1))
    return total


@dataclass(frozen=True)
class Group:
    """Templates of one length class: log2 of the window, its stride, and for each band the sorted values that retrieve templates."""

    level: int
    stride: int
    values: list[np.ndarray]
    owners: list[np.ndarray]
    quick: np.ndarray  # by band and top bits of a scrambled value: may it be one of these?

    @classmethod
    def of(cls, k: int, members: list[int], lowest: np.ndarray) -> Group:
        """`lowest`: template by band."""
        values, owners, quick = [], [], np.zeros((lowest.shape[1], 1 << QUICK_BITS), bool)
        for band in range(lowest.shape[1]):
            order = np.argsort(lowest[:, band], kind="stable")
            values.append(lowest[order, band])
            owners.append(np.array(members)[order])
            quick[band, quick_slots(values[-1])] = True
        return cls(0 if k == 0 else k + 1, max(1, (1 << k) // 4), values, owners, quick)

    def windows(self, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, first shingle) of the windows of texts of these sizes; a text that is no longer than a window is one."""
        size = 1 << self.level
        count = np.where(sizes > size, -(-(sizes - size) // self.stride) + 1, np.minimum(sizes, 1))
        text = np.repeat(np.arange(len(sizes)), count)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        return text, begins[text] + np.minimum(turn * self.stride, np.maximum(sizes[text] - size, 0))


QUICK_BITS = 12


def quick_slots(values: np.ndarray) -> np.ndarray:
    return ((values * U64(0x9E3779B97F4A7C15)) >> U64(64 - QUICK_BITS)).astype(np.int64)


class Index:
    """Templates by length group, with the MinHash values that retrieve them."""

    def __init__(self, templates: list[tuple[str, str]], config: LicenseScanConfig) -> None:
        self.config, self.cache = config, {}
        self.seeds = mix(np.arange(1, config.bands + 1, dtype=U64)) | U64(1)
        self.names, self.sets = [], []
        groups: dict[int, list[int]] = {}
        for name, text in templates:
            words = np.array([_word_hash(w) for w in map(bare_word, text.encode().split()) if w], U64)
            found = np.unique(shingles(words, config.width))
            if len(found):
                groups.setdefault(int(len(found)).bit_length() - 1, []).append(len(self.sets))
                self.names.append(name)
                self.sets.append(found)
        self.rivals = [self._rivals(t) if config.tell_apart else [] for t in range(len(self.sets))]
        self.groups = []
        for k, members in sorted(groups.items()):
            self.groups.append(Group.of(k, members, np.array([np.multiply.outer(self.seeds, self.sets[t]).min(axis=1) for t in members])))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _rivals(self, t: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(what only this template has, what only the other has, shingles of the other) for templates of other licences that share half of the smaller one."""
        found, own = [], self.sets[t]
        for u, other in enumerate(self.sets):
            if self.names[u] != self.names[t] and 2 * len(np.intersect1d(own, other)) >= min(len(own), len(other)):
                found.append((np.setdiff1d(own, other), np.setdiff1d(other, own), len(other)))
        return found

    def outdone(self, template: int, items: np.ndarray, a: int, b: int, low: int, high: int) -> bool:
        """Whether around the shingles a..b of a text low..high there is more of what only a rival has than of what only this template has.

        A template that a rival holds whole stands back where half of the rival's rest is there.
        """
        for own, other, size in self.rivals[template]:
            near = items[max(low, a - size) : min(high, b + size)]
            share = np.isin(own, near).mean() if len(own) else 0.5
            if len(other) and np.isin(other, near).mean() > share:
                return True
        return False

    def hashes(self, distinct: list[bytes]) -> np.ndarray:
        """Hashes of raw words; 0 for those without a letter or digit."""
        out = np.empty(len(distinct), U64)
        for k, word in enumerate(distinct):
            found = self.cache.get(word)
            if found is None:
                bare = bare_word(word)
                found = _word_hash(bare) if bare else 0
                if len(self.cache) > 100_000:
                    self.cache.clear()
                self.cache[word] = found
            out[k] = found
        return out

    def items(self, words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles of all texts, where each text's begin) of the texts `cuts` of a list of word hashes."""
        width, n = self.config.width, np.diff(cuts)
        sizes = np.maximum(n - width + 1, np.minimum(n, 1))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(int(begins[-1]), U64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(out)) - begins[text] + cuts[text]
        whole = n[text] >= width
        if whole.any():
            out[whole] = shingles(words, width)[place[whole]]
        for k in np.flatnonzero((n > 0) & (n < width)):
            out[begins[k]] = shingles(words[cuts[k] : cuts[k + 1]], width)[0]
        return out, begins

    def retrieved(self, items: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """(text, template) -> first shingles of the windows that share a MinHash value with it."""
        sizes, found = np.diff(begins), {}
        if not len(items) or not self.groups:
            return found
        windows = [g.windows(sizes, begins[:-1]) for g in self.groups]
        top = max(g.level for g in self.groups)
        power = np.frexp(np.maximum(sizes, 1).astype(float))[1] - 1  # floor of log2
        whole_at = [np.flatnonzero((power == t) & (sizes > 0)) for t in range(top + 1)]
        for band, seed in enumerate(self.seeds):
            low = items * seed  # minima of the 2**t shingles from each on
            least = np.zeros(len(sizes), U64)  # of whole texts
            for t in range(top + 1):
                if t:
                    low = np.concatenate([np.minimum(low[: -(1 << t - 1)], low[1 << t - 1 :]), low[-(1 << t - 1) :]]) if len(low) > 1 << t - 1 else low
                here = whole_at[t]
                least[here] = np.minimum(low[begins[here]], low[begins[here + 1] - (1 << t)])
                for g, (text, first) in zip(self.groups, windows, strict=True):
                    if g.level != t:
                        continue
                    value = np.where(sizes[text] > 1 << t, low[first], least[text])
                    some = np.flatnonzero(g.quick[band][quick_slots(value)])
                    for at in some[np.isin(value[some], g.values[band])]:
                        a, b = np.searchsorted(g.values[band], value[at]), np.searchsorted(g.values[band], value[at], "right")
                        for template in g.owners[band][a:b]:
                            found.setdefault((int(text[at]), int(template)), []).append(int(first[at]))
        return found

    def scan(self, words: np.ndarray, cuts: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(text, licence, best containment, its first word, matching windows) of the texts `cuts` of a list of word hashes."""
        items, begins = self.items(words, cuts)
        best: dict[tuple[int, str], list] = {}
        for (text, template), starts in sorted(self.retrieved(items, begins).items()):
            whole = self.sets[template]
            size = 1 << (0 if len(whole) == 1 else int(len(whole)).bit_length())
            for start in sorted(set(starts)):
                a, b = max(begins[text], start - len(whole)), min(begins[text + 1], start + size + len(whole))
                here = np.isin(items[a:b], whole)
                share = len(np.unique(items[a:b][here])) / len(whole)
                if share >= self.config.containment and not self.outdone(template, items, a, b, begins[text], begins[text + 1]):
                    first = int(a + np.argmax(here) - begins[text])
                    entry = best.setdefault((text, self.names[template]), [0.0, first, 0])
                    if share > entry[0]:
                        entry[:2] = [share, first]
                    entry[2] += 1
        return [(text, name, *entry) for (text, name), entry in sorted(best.items())]


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            data, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets):
                distinct, inverse, owner, _, _ = block_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hashes = index.hashes(distinct)[inverse] if len(distinct) else np.zeros(0, U64)
                keep = hashes != 0
                hashes, owner = hashes[keep], owner[keep]
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                out += [(ids[i + k], *row) for k, *row in index.scan(hashes, cuts)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "license", "containment", "first_word", "windows"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, config: LicenseScanConfig = LicenseScanConfig()) -> DataFrame:
    """Licence notices in `docs` (doc_id, text): doc_id, license, containment, first_word, windows.

    One row for each document and licence with a template of which `containment` or more of the shingles
    stand in and around one window; with `tell_apart`, unless a similar template of another licence (another version, one clause more or
    less) is told from it there by the shingles that only one of the two has. first_word, the first of them, counts words that have a letter or digit. Null ids and texts, and texts
    with no match, give no row. Rows that repeat a doc_id give rows each. The templates are a parameter of
    fixed size and go to the tasks with the code.
    """
    chosen = TEMPLATES if templates is None else templates
    index = Index([(name, text) for name, texts in sorted(chosen.items()) for text in texts], config)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return source.mapInArrow(_scan(index), "doc_id long, license string, containment double, first_word long, windows long")
