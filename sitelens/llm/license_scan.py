"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of ASCII letters (A-Z as a-z), digits and bytes beyond ASCII, so that marks, case and line breaks don't matter.
A text is read in windows as long as a template (in shingles of five words), an eighth of it apart. A window's MinHash bands are
looked up among the templates of its length; the number of bands follows from the least similarity that a window over a match
can have, so that it meets its template with probability COLLISION. Around a window found, the template's distinct shingles are
counted exactly: CONTAINMENT of them make a match. Windows without any shingle of the templates of their length can't meet one in
a band (a band is the hash of one shingle) and get no signature. Of overlapping
matches the one with more containment stays, then the longer one.

Templates of fewer than five words have no shingle and never match. Null and empty texts and such of fewer than five words have
no matches. The whole text is read, however long. Repeated rows give repeated matches; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, utf8_parts
from .words import mix, parts, shingles, word_hashes

WORDS = 5
CONTAINMENT = 0.8
COLLISION = 0.9999
STEPS = 8
#: A match's shingles may lie within so many template lengths.
SPAN = 1.5

# License notices as their holders ask to state them, and short statements in common use.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = False
_SEPARATOR[128:] = False


def bands_needed(containment: float = CONTAINMENT, steps: int = STEPS, collision: float = COLLISION) -> int:
    """Bands of one MinHash value with which the worst-placed window over a match, spread over SPAN, still meets its template."""
    held = containment / SPAN - 1 / (2 * steps)
    least = held / (2 - held)
    return math.ceil(math.log(1 - collision) / math.log(1 - least))


def min_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of a set of shingle hashes."""
    return np.array([mix(x ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))).min() for k in range(n)], dtype=np.uint64)


class Templates:
    def __init__(self, templates: dict[str, list[str]], bands: int):
        self.bands = bands
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        for name, texts in templates.items():
            for text in texts:
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                h, _, _, rows = word_hashes(np.array([0, len(data)]), data, separator=_SEPARATOR)
                found, _ = shingles(h, rows, WORDS, whole=False)
                if len(found):
                    self.names.append(name)
                    self.sets.append(np.unique(found))
        self.every = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.by_length: dict[int, dict[tuple[int, int], list[int]]] = {}
        for i, x in enumerate(self.sets):
            at = self.by_length.setdefault(len(x), {})
            for band, value in enumerate(min_hashes(x, bands).tolist()):
                at.setdefault((band, value), []).append(i)
        self.of_length = {size: np.unique(np.concatenate([x for x in self.sets if len(x) == size])) for size in self.by_length}

    def hits(self, x: np.ndarray) -> np.ndarray:
        if not len(self.every):
            return np.zeros(len(x), dtype=bool)
        return self.every[np.minimum(np.searchsorted(self.every, x), len(self.every) - 1)] == x

    def matches(self, x: np.ndarray, hit: np.ndarray) -> list[tuple[str, int, int, float]]:
        """License, first and last word, containment of each match in a text's shingles; hit: places of known shingles."""
        found: dict[int, list[tuple[int, int, float]]] = {}
        every_hit = hit
        for size, table_ in self.by_length.items():
            hit = every_hit[np.isin(x[every_hit], self.of_length[size])]
            if not len(hit):
                continue
            step = max(1, size // STEPS)
            first = np.maximum(0, (hit - size + step) // step)
            starts = np.unique(np.concatenate([first + k for k in range(-(-size // step) + 1)]) * step)
            starts = starts[starts < len(x)]
            at = np.searchsorted(hit, starts)
            starts = starts[(at < len(hit)) & (hit[np.minimum(at, len(hit) - 1)] < starts + size)]
            for a in starts.tolist():
                keys = enumerate(min_hashes(x[a : a + size], self.bands).tolist())
                for i in {i for key in keys for i in table_.get(key, ())}:
                    low, high = max(0, a - size), min(len(x), a + 2 * size)
                    places = np.flatnonzero(np.isin(x[low:high], self.sets[i])) + low
                    best = self._densest(x, places, i)
                    if best:
                        found.setdefault(i, []).append(best)
        every = sorted({(-share, a - b, a, b, self.names[i]) for i, spans in found.items() for a, b, share in spans})
        out: list[tuple[str, int, int, float]] = []
        for less, _, a, b, name in every:  # the best first; what overlaps a better match is no match of its own
            if all(b + WORDS <= m[1] or m[2] <= a for m in out):
                out.append((name, a, b + WORDS, -less))
        return sorted(out, key=lambda m: m[1])

    def _densest(self, x: np.ndarray, places: np.ndarray, i: int) -> tuple[int, int, float] | None:
        """The shortest span of places, of those with most of template i's shingles within SPAN times its length, if enough."""
        size, best = len(self.sets[i]), (0, 0, 0, 0)
        for k, a in enumerate(places.tolist()):
            some = places[k : np.searchsorted(places, a + max(size, int(SPAN * size)))]
            n = len(np.unique(x[some]))
            best = max(best, (n, -int(some[-1] - a), -a, int(some[-1])))
        if best[0] >= CONTAINMENT * size:
            return -best[2], best[3], best[0] / size
        return None


def scan(df: DataFrame, templates: dict[str, list[str]] | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each match: key, license, start_word and end_word (from 0, end excluded), containment."""
    known = Templates(TEMPLATES if templates is None else templates, bands_needed())
    schema = T.StructType([df.schema[key], T.StructField("license", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8_parts(batch.column(1))
            rows_out: list[int] = []
            found: list[tuple[str, int, int, float]] = []
            for a, b in parts(offsets):
                h, _, _, rows = word_hashes(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], separator=_SEPARATOR)
                x, ranges = shingles(h, rows, WORDS, whole=False)
                hit = np.flatnonzero(known.hits(x))
                owner = np.searchsorted(ranges, hit, side="right") - 1
                for i in np.unique(owner).tolist():
                    some = known.matches(x[ranges[i] : ranges[i + 1]], hit[owner == i] - ranges[i])
                    rows_out += [a + i] * len(some)
                    found += some
            names, starts, ends, shares = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_out, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(shares, pa.float64())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
