"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Texts and license templates are sequences of word codes. Hashes of every GRAM words
are winnowed: of each PICK hashes in a row the smallest (the last of equals) is a
fingerprint. An inverted index leads from the templates' fingerprints to templates
and positions; hits near one diagonal are a candidate, and a banded alignment of
the template with that part of the text gives the words that match, the coverage of
the template and the span of the text. A run of GRAM + PICK - 1 equal words always
shares a fingerprint.

The library of templates is the caller's; its index goes to every worker and is
bounded by MAX_TEMPLATE_WORDS (a longer library raises ValueError).

Defined cases: null and empty texts have no license. Templates of fewer than GRAM
words raise ValueError. Of alignments that overlap, for one part of the text, the
one with more matching words stands, then the higher coverage, then the name first
in the alphabet. Repeated rows give repeated results. Spans count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvana.llm.common import WordCodes, keeps, lean, slices, window_hashes, word_codes

GRAM, PICK = 3, 2
#: Cells on either side of a candidate's diagonal that the alignment may use.
BAND = 8
MIN_COVERAGE = 0.8
MAX_TEMPLATE_WORDS = 1_000_000
MATCH, MISS, GAP = 2, -1, -1

# Notices by which works commonly state their license, and whole texts of short licenses (-text).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "BSD-statement": "Released under the BSD License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-statement": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}

_WORDS = WordCodes()
keeps(__name__, _WORDS.clear)


def winnow(hashes: np.ndarray, pick: int = PICK) -> np.ndarray:
    """Positions of the smallest of each `pick` hashes in a row, the last of equals; all of a shorter row's smallest."""
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.intp)
    pick = min(pick, n)
    least, where = hashes[: n - pick + 1].copy(), np.arange(n - pick + 1)
    for k in range(1, pick):
        after = hashes[k : k + n - pick + 1]
        better = after <= least
        least[better] = after[better]
        where[better] = np.flatnonzero(better) + k
    return np.unique(where)


@dataclass
class Library:
    names: list[str] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    #: Fingerprint -> (template, position) of each place that has it.
    index: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    prints: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))

    @classmethod
    def of(cls, templates: dict[str, str]) -> Library:
        found = cls()
        for name in sorted(templates):
            words = word_codes(templates[name], _WORDS)
            if len(words) < GRAM:
                raise ValueError(f"template {name} has fewer than {GRAM} words")
            hashes = window_hashes(words, GRAM)
            for p in winnow(hashes).tolist():
                found.index[int(hashes[p])].append((len(found.names), p))
            found.names.append(name)
            found.words.append(words)
        if sum(map(len, found.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"the templates have more than {MAX_TEMPLATE_WORDS} words")
        found.prints = np.sort(np.fromiter(found.index, dtype=np.uint64, count=len(found.index)))
        return found


def align(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Matching words, and first and one past the last matching word of the text, of the best local alignment.

    Cells within BAND of the diagonal (position in the text less that in the template) count.
    """
    t, x = template.tolist(), text.tolist()
    best, above = (0, 0, 0, 0), {}
    for i, word in enumerate(t):
        row, left = {}, None
        for j in range(max(0, i + diagonal - BAND), min(len(x), i + diagonal + BAND + 1)):
            # score, matches, first matched, one past the last matched
            corner = above.get(j - 1, (0, 0, -1, -1))
            if word == x[j]:
                cell = (corner[0] + MATCH, corner[1] + 1, j if corner[1] == 0 else corner[2], j + 1)
            else:
                cell = (corner[0] + MISS, *corner[1:])
            for other in (above.get(j), left):
                if other is not None and other[0] + GAP > cell[0]:
                    cell = (other[0] + GAP, *other[1:])
            if cell[0] <= 0:
                cell = (0, 0, -1, -1)
            row[j] = left = cell
            if cell[0] > best[0]:
                best = cell
        above = row
    return best[1], best[2], best[3]


def spans(library: Library, text: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """template, matching words, first word and one past the last word, for hits of (position, fingerprint)."""
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, h in hits:
        for template, q in library.index[h]:
            seeds[template].append((p - q, p))
    found = []
    for template, places in seeds.items():
        words, done = library.words[template], 0
        groups: list[int] = []
        # Hits in the order of their diagonals: those within half a band are one candidate.
        for diagonal, _ in sorted(places):
            if not groups or diagonal - groups[-1] > BAND // 2:
                groups.append(diagonal)
        for diagonal in groups:
            low = max(0, diagonal - BAND, done)  # a notice that repeats is found one after another
            part = text[low : diagonal + len(words) + BAND]
            n, first, end = align(words, part, diagonal - low)
            if n >= MIN_COVERAGE * len(words):
                done = low + end
                found.append((template, n, low + first, low + end))
    found.sort(key=lambda s: (-s[1], -s[1] / len(library.words[s[0]]), s[0]))
    kept: list[tuple[int, int, int, int]] = []
    begins: list[int] = []
    for s in found:
        k = bisect_left(begins, s[2])
        if (k == 0 or kept[k - 1][3] <= s[2]) and (k == len(kept) or kept[k][2] >= s[3]):
            begins.insert(k, s[2])
            kept.insert(k, s)
    return kept


_SPACED = re.compile(r"\S+")


def scan_texts(library: Library, texts: list[str | None]) -> list[list[tuple[str, int, float, int, int]]]:
    """For each text: license, matching words, coverage, and span in characters."""
    codes = [word_codes(t or "", _WORDS) for t in texts]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    joined = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum(sizes) - sizes
    hashes = window_hashes(joined, GRAM)
    out: list[list[tuple[str, int, float, int, int]]] = [[] for _ in texts]
    if not len(hashes) or not len(library.prints):
        return out
    at = np.searchsorted(library.prints, hashes)
    known = library.prints[np.minimum(at, len(library.prints) - 1)] == hashes
    known &= owner[: len(hashes)] == owner[GRAM - 1 :]
    # Winnowing looks at most PICK - 1 hashes aside: only texts with a known hash are winnowed whole.
    for k in np.unique(owner[np.flatnonzero(known)]).tolist():
        own = hashes[starts[k] : starts[k] + sizes[k] - GRAM + 1]
        mine = known[starts[k] : starts[k] + sizes[k] - GRAM + 1]
        hits = [(p, int(own[p])) for p in winnow(own).tolist() if mine[p]]
        found = spans(library, codes[k], hits)
        if found:
            places = [m.span() for m in _SPACED.finditer(texts[k]) if _WORDS[m[0]]]
            out[k] = [(library.names[t], n, n / len(library.words[t]), places[a][0], places[b - 1][1]) for t, n, a, b in sorted(found, key=lambda s: s[2])]
    return out


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license notice: id_col, license, matched, coverage, start, end."""
    library_of = templates or TEMPLATES
    Library.of(library_of)  # its bounds hold before any task starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.of(library_of)
        for batch in batches:
            for ids, texts in slices(batch):
                rows = [(i, *r) for i, found in zip(ids, scan_texts(library, texts), strict=True) for r in found]
                if rows:
                    kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [id_col, "license", "matched", "coverage", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"{id_col} {kind}, license string, matched long, coverage double, start long, end long")
