"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports what matches.

Texts and templates are compared as words: letters and digits of each white-space run in lower case, runs without any left
out; 32-bit hashes stand for them. Every template's 3-word hashes are winnowed into an inverted index (hash -> template, place). A text looks all its
3-word hashes up; hits of one template that lie on neighbouring diagonals make a candidate, and a local alignment in
a band around these diagonals finds the matched words. A match counts when it covers at least 0.8 of the template's words; of
matches that overlap, the one with the greatest coverage stays, then the longest.

The index is built from the templates alone, whose number is a parameter and does not grow with the corpus; texts
are scanned where they lie.

Defined cases: a null or empty text has no match; repeated rows match alike; an empty table gives no rows; other
columns are ignored; templates of fewer than three words are found by their whole word sequence.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recallium.llm.common import Memo, utf8, with_id

GRAM, WINDOW, COVERAGE = 3, 2, 0.8
# Notices by which texts name their license, openings of well-known license texts, and short ones in full.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT notice": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0 boilerplate": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_PLAIN = re.compile(r"[^\w]|_")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def plain(token: bytes) -> str:
    return _PLAIN.sub("", token.decode()).lower()


def hash_of(word: str) -> int:
    """32 bits, 0 for a run without letters and digits."""
    return (zlib.crc32(word.encode()) | 1) if word else 0


def grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(h: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least hash of each window, the last among equals."""
    if len(h) <= window:
        return [int(len(h) - 1 - h[::-1].argmin())] if len(h) else []
    return sorted({i + window - 1 - int(h[i : i + window][::-1].argmin()) for i in range(len(h) - window + 1)})


def align(template: list[int], words: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Matched (template place, text place) pairs of the best local alignment on diagonals text - template in low..high; words
    are told apart by numbers.

    A match scores 2, a mismatch or a gap -1. A row of the band is filled at once: text words left out are a running maximum."""
    width, n = high - low + 1, len(template)
    ramp, shown = np.arange(width), np.array(words, np.int64)
    steps = np.zeros((n, width), np.uint8)
    before, best, at = np.zeros(width + 1, np.int64), 0, None
    for i, t in enumerate(template):
        a, b = max(0, -(i + low)), min(width, len(words) - i - low)
        row = np.zeros(width + 1, np.int64)
        if a < b:
            diagonal = before[a:b] + np.where(shown[i + low + a : i + low + b] == t, 2, -1)
            skipped = before[a + 1 : b + 1] - 1  # a template word is left out
            skipped[ramp[a:b] + 1 >= width] = -1
            score = np.maximum(np.maximum(diagonal, skipped), 0)
            run = np.maximum.accumulate(score + ramp[a:b]) - ramp[a:b]
            how = np.where(run > score, 3, np.where(skipped > diagonal, 2, 1))  # 3: a text word is left out
            how[run <= 0] = 0
            row[a:b], steps[i, a:b] = run, how
            if run.max() > best:
                best, at = int(run.max()), (i, a + int(run.argmax()))
        before = row
    out = []
    while at and at[0] >= 0 and steps[at[0], at[1]]:
        i, d = at
        how = steps[i, d]
        if how == 1:
            if words[i + low + d] == template[i]:
                out.append((i, i + low + d))
            at = (i - 1, d)
        else:
            at = (i - 1, d + 1) if how == 2 else (i, d - 1)
    return out[::-1]


class Index:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: [hash_of(w) for w in map(plain, text.encode().split()) if w] for name, text in templates.items()}
        self.places: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.short = {}
        for name, words in self.words.items():
            h = np.array(words, np.uint32)
            if len(words) < GRAM:
                self.short[name] = words
                continue
            g = grams(h)
            for p in winnow(g):
                self.places[int(g[p])].append((name, p))
        self.keys = np.sort(np.array(list(self.places), np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Places of hashes that the index has."""
        near = np.flatnonzero(self.maybe[(g & np.uint64(0xFFFF)).astype(np.int64)])
        return near[np.isin(g[near], self.keys)]

    def matches(self, words: list[int], hits: list[tuple[int, int]], coverage: float) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) for the hits (place, hash) of a text."""
        diagonals: dict[str, list[int]] = defaultdict(list)
        for place, h in hits:
            for name, p in self.places[h]:
                diagonals[name].append(place - p)
        found = []
        for name, all_d in diagonals.items():
            template = self.words[name]
            slack = 2 + len(template) // 8
            all_d.sort()
            start = 0
            for i in range(1, len(all_d) + 1):
                if i == len(all_d) or all_d[i] - all_d[i - 1] > 2 * slack or all_d[i] - all_d[start] > 8 * slack:
                    pairs = align(template, words, all_d[start] - slack, all_d[i - 1] + slack)
                    if pairs and len(pairs) >= coverage * len(template):
                        found.append((name, len(pairs) / len(template), pairs[0][1], pairs[-1][1]))
                    start = i
        for name, template in self.short.items():
            n = len(template)
            found += [(name, 1.0, i, i + n - 1) for i in range(len(words) - n + 1) if words[i : i + n] == template]
        found.sort(key=lambda m: (-m[1], m[2] - m[3], m[2], m[0]))
        kept: list[tuple[str, float, int, int]] = []  # in order of place, none overlaps another
        for m in found:
            i = bisect_left(kept, m[2], key=lambda k: k[2])
            if (i == 0 or kept[i - 1][3] < m[2]) and (i == len(kept) or kept[i][2] > m[3]):
                kept.insert(i, m)
        return kept


SCHEMA = "doc_id long, n_matches long, license string, coverage double, matches array<struct<license:string,coverage:double,start:long,end:long>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per row: the matches with code-point offsets, and the best covered one (the first among equals)."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        word_hash = Memo(lambda t: hash_of(plain(t)))
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = [t.split() for t in utf8(batch.column("text"))]
                sizes = np.array([len(x) for x in texts], np.int64)
                h = np.fromiter((v for x in texts for v in map(word_hash.__getitem__, x)), np.uint32, int(sizes.sum()))
                owner = np.repeat(np.arange(len(texts)), sizes)
                full = h != 0
                h, owner = h[full], owner[full]
                g = grams(h)
                hits = index.hits(g)
                hits = hits[owner[hits] == owner[hits + GRAM - 1]] if len(hits) else hits
                firsts = np.searchsorted(owner, np.arange(len(texts) + 1))
                of: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for p, o in zip(hits.tolist(), owner[hits].tolist(), strict=True):
                    of[o].append((p - int(firsts[o]), int(g[p])))
                found: list[list] = [[] for _ in texts]
                column = batch.column("text")
                for i in range(len(texts)) if index.short else sorted(of):
                    words = [word_hash[t] for t in texts[i]]
                    places = None
                    for name, c, a, b in index.matches([w for w in words if w], of.get(i, []), coverage):
                        places = places or [m.span() for m, w in zip(_TOKEN.finditer(column[i].as_py()), words, strict=True) if w]
                        found[i].append({"license": name, "coverage": c, "start": places[a][0], "end": places[b][1]})
                word_hash.trim()
                best = [max(x, key=lambda m: (m["coverage"], -m["start"])) if x else None for x in found]
                kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([b and b["license"] for b in best], pa.string()),
                        pa.array([b and b["coverage"] for b in best], pa.float64()), pa.array(found, kind),
                    ],
                    ["doc_id", "n_matches", "license", "coverage", "matches"],
                )

    return with_id(docs).mapInArrow(run, SCHEMA)
