"""License notices in whole texts: MinHash bands retrieve templates, exact containment decides.

Words are runs of letters and digits, lower-cased; five of them are a shingle. For every size class of
templates the shingles of a text are cut into windows of four times the class size that overlap by half. So a
notice lies inside one window as long as insertions stretch it to no more than twice the class size, which is
at least twice the template; wider ones are found only where a window happens to hold them. Each window is known by the minima of its shingles under several hash
functions; each minimum is a band of its own, and a template is retrieved if one band agrees. The number of
bands follows from the least similarity a match can have, so that a match is missed with probability
``MISS`` at most. Retrieved pairs are then verified: a window holds a notice if at least ``CONTAINED`` of the
template's shingles are in it. Overlapping windows with one notice are one finding.

Texts that share no shingle with any template cannot match, so no bands are computed for them. Null and
short texts have no findings. Repeated rows have findings each. Only doc_id and text are looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatlake.llm.common import LOWER, WORD_BYTE, map_texts, mix, prefix_sums, runs, span_hashes, text_bytes

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6

#: Fixed wording of public license notices.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at"
    ),
    "CC BY 4.0 notice": "Licensed under CC BY 4.0.",
    "CC BY-SA 4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC BY-NC 4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT license notice": "Licensed under the MIT License",
    "MIT inclusion": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "MIT warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0 short notice": "under the Apache License 2.0",
    "Apache-2.0 warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "BSD retention": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD endorsement": (
        "may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    "BSD warranty": (
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "LGPL header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation"
    ),
    "AGPL header": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0 permission": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit "
        "the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
        "is furnished to do so"
    ),
    "EPL-2.0 notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    ),
    "Zlib permission": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions"
    ),
    "CC0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
    ),
    "Public domain": "This is free and unencumbered software released into the public domain.",
}


def shingles(texts: pa.Array, size: int = SHINGLE):
    """Shingle hashes of all texts, where each text's start, and first and last byte of each shingle."""
    data, offsets = text_bytes(texts)
    starts, ends = runs(WORD_BYTE[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    words = span_hashes(prefix_sums(LOWER[data]), starts, ends)
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    until = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(bounds[:-1] - until[:-1], counts) + np.arange(until[-1])
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    text = np.repeat(offsets[:-1], counts)
    return value, until, starts[at] - text, ends[at + size - 1] - text


@dataclass
class SizeClass:
    """Templates of one size class: window length, seeds of bands, and the templates' minima by band."""

    window: int
    seeds: list[int]
    names: list[str]
    minima: np.ndarray


@dataclass
class Scanner:
    sets: dict[str, np.ndarray]
    classes: list[SizeClass]
    known: np.ndarray


def scanner(templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, miss: float = MISS) -> Scanner:
    """Templates with fewer words than a shingle cannot be found and are refused."""
    sets = {name: np.unique(shingles(pa.array([text]))[0]) for name, text in templates.items()}
    if any(not len(found) for found in sets.values()):
        raise ValueError(f"a template needs {SHINGLE} words at least")
    by_window: dict[int, list[str]] = {}
    for name, found in sets.items():
        by_window.setdefault(4 << (len(found) - 1).bit_length(), []).append(name)
    classes = []
    for window, names in sorted(by_window.items()):
        # the least similarity of a window with a template it contains well enough
        least = min(
            math.ceil(contained * len(sets[n])) / (window + len(sets[n]) - math.ceil(contained * len(sets[n]))) for n in names
        )
        bands = max(1, math.ceil(math.log(miss) / math.log(1 - least)))
        seeds = [(0xA24BAED4963EE407 * (i + 1)) % (1 << 64) for i in range(bands)]
        minima = np.array([[mix(sets[n] ^ np.uint64(seed)).min() for n in names] for seed in seeds], np.uint64)
        classes.append(SizeClass(window, seeds, names, minima))
    return Scanner(sets, classes, np.unique(np.concatenate(list(sets.values()))))


def _windows(count: int, window: int) -> list[tuple[int, int]]:
    half = window // 2
    return [(a, min(a + window, count)) for a in range(0, max(count - half, 1), half)]


def retrieve(own: np.ndarray, group: SizeClass) -> set[tuple[int, int]]:
    """(window, template) pairs of one text that agree in at least one band."""
    half = group.window // 2
    edges = np.arange(0, len(own), half)
    found: set[tuple[int, int]] = set()
    for seed, minima in zip(group.seeds, group.minima, strict=True):
        lows = np.minimum.reduceat(mix(own ^ np.uint64(seed)), edges)
        if len(lows) > 1:
            lows = np.minimum(lows[:-1], lows[1:])
        for k, low in enumerate(minima):
            found.update((int(w), k) for w in np.flatnonzero(lows == low))
    return found


def scan_text(own: np.ndarray, scan: Scanner, contained: float = CONTAINED) -> list[tuple[str, int, int, float]]:
    """Findings in the shingles of one text: name, first and last shingle, containment."""
    findings = []
    for group in scan.classes:
        windows = _windows(len(own), group.window)
        hits: dict[str, list[tuple[int, float]]] = {}
        for place, k in sorted(retrieve(own, group)):
            name = group.names[k]
            a, b = windows[place]
            wanted = scan.sets[name]
            share = len(np.intersect1d(own[a:b], wanted)) / len(wanted)
            if share >= contained:
                hits.setdefault(name, []).append((place, share))
        for name, found in hits.items():
            start = 0
            for i in range(1, len(found) + 1):
                if i == len(found) or found[i][0] > found[i - 1][0] + 1:
                    a, b = windows[found[start][0]][0], windows[found[i - 1][0]][1]
                    inside = a + np.flatnonzero(np.isin(own[a:b], scan.sets[name]))
                    share = max(x[1] for x in found[start:i])
                    findings.append((name, int(inside[0]), int(inside[-1]), share))
                    start = i
    return sorted(findings)


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, first_byte, last_byte (exclusive) and containment of every notice found."""
    scan = scanner(templates, contained)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, until, first, last = shingles(batch.column("text"))
        place = np.minimum(np.searchsorted(scan.known, value), len(scan.known) - 1)
        shared = np.concatenate([[0], np.cumsum(scan.known[place] == value)])
        rows: list[tuple] = []
        for i in np.flatnonzero(shared[until[1:]] > shared[until[:-1]]).tolist():
            a, b = until[i], until[i + 1]
            for name, x, y, share in scan_text(value[a:b], scan, contained):
                rows.append((i, name, int(first[a + x]), int(last[a + y]), share))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                pa.array(columns[1], pa.string()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.float64()),
            ],
            ["doc_id", "license", "first_byte", "last_byte", "containment"],
        )

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, license string, first_byte long, last_byte long, containment double"
    return map_texts(docs.select("doc_id", "text"), work, schema)
