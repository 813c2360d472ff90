"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are few and fixed, so their inverted index, from a fingerprint to the templates and positions that have
it, goes to every task. Each template is winnowed: of every run of its word k-grams the one of least hash is kept.
k and the length of the runs follow from the template's number of words m: a text that matches with up to m / 5 breaks,
words that are missing or places where words were put in, has some run of words unbroken, and every such run holds a
fingerprint. All k-grams of a document are looked up. Each hit that no reported match covers is a candidate, which is
aligned with the document's words inside a band around its diagonal; a match's words are used up by it, so a notice
that is repeated is reported as often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces_of, ship, text_bytes
from .decontaminate import words_of

#: Words that an alignment may drift, share of a template's words to report, breaks that a match may have for each word.
BAND, COVERAGE, BREAKS = 12, 0.8, 5

#: Notices that licenses ask to be put on works, and short licenses in full.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}


def grams_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; none of fewer words."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least of each `window` hashes in a row, the rightmost of equals."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    return np.unique([i + window - 1 - int(np.argmin(grams[i : i + window][::-1])) for i in range(len(grams) - window + 1)])


def fingerprint_lengths(m: int) -> tuple[int, int]:
    """(words of a fingerprint, fingerprints in a winnowing window) of a template of m words.

    m // BREAKS breaks leave a run of ceil((m - breaks) / (breaks + 1)) words or more; the window is as many grams as it has.
    """
    breaks = m // BREAKS
    run = -(-(m - breaks) // (breaks + 1))
    gram = min(run, 3 if run > 3 else 2)
    return gram, run - gram + 1


class Index:
    """Fingerprints of templates by their number of words, sorted, with the template and position of each."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [words_of(*text_bytes(pa.array([t])))[4] for t in templates.values()]
        rows: dict[int, list] = {}
        for i, h in enumerate(self.words):
            if len(h) < 2:
                raise ValueError(f"{self.names[i]} has fewer than two words")
            gram, window = fingerprint_lengths(len(h))
            g = grams_of(h, gram)
            rows.setdefault(gram, []).extend((int(g[p]), i, int(p)) for p in winnow(g, window).tolist())
        self.parts = {gram: Fingerprints(sorted(x)) for gram, x in rows.items()}


class Fingerprints:
    def __init__(self, rows: list[tuple[int, int, int]]):
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = (np.array([r[j] for r in rows], np.int64) for j in (1, 2))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the text, entry of the index) of all fingerprints found."""
        at = np.flatnonzero(self.seen[(grams >> np.uint64(48)).astype(np.int64)])
        first, last = np.searchsorted(self.keys, grams[at], "left"), np.searchsorted(self.keys, grams[at], "right")
        n = last - first
        entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), entry


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(words matched, first, one after the last) of the best common subsequence with text[i + shift - band .. + band] for word i."""
    width = 2 * band + 1
    score, back = np.zeros(width, np.int64), []
    for i, w in enumerate(template.tolist()):
        j = i + shift - band + np.arange(width)
        ok = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[ok] = text[j[ok]] == w
        take = score + same  # the diagonal of a band keeps its column
        skip = np.concatenate((score[1:], [-1]))  # the template's word is missing
        now = np.maximum(take, skip)
        step = np.where(take >= skip, np.where(same, 1, 0), 2)
        left = np.maximum.accumulate(now)  # words of the text in between
        step[np.concatenate(([False], now[1:] < left[:-1]))] = 3
        score = left
        back.append((step, j))
    c = int(np.argmax(score))
    matched, i, first, end = int(score[c]), len(template) - 1, -1, -1
    while i >= 0:
        step, j = back[i]
        if step[c] == 3:
            c -= 1
            continue
        if step[c] == 1:
            first = int(j[c])
            end = first + 1 if end < 0 else end
        if step[c] == 2:
            c += 1
        i -= 1
    return matched, first, end


def scan(data: np.ndarray, off: np.ndarray, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple[int, str, int, float, int, int]]:
    """(text, template, words matched, coverage, first byte, byte after the last), whole texts, in order."""
    _, begin, end, doc, h = words_of(data, off)
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for gram, part in index.parts.items():
        grams = grams_of(h, gram)
        if len(grams):
            at, entry = part.hits(grams)
            inside = doc[at] == doc[at + gram - 1]
            at, entry = at[inside], entry[inside]
            for d, t, p, shift in zip(doc[at].tolist(), part.template[entry].tolist(), at.tolist(), (at - part.place[entry]).tolist(), strict=True):
                found.setdefault((d, t), []).append((p, shift))
    out = []
    for (d, t), hits in found.items():
        lo, hi = np.searchsorted(doc, [d, d + 1])
        out += [(d, index.names[t], n, n / len(index.words[t]), int(begin[a] - off[d]), int(end[b - 1] - off[d])) for a, b, n in places(index.words[t], h, int(lo), int(hi), hits, band, coverage)]
    return sorted(out, key=lambda x: (x[0], x[4], x[1]))


def places(words: np.ndarray, h: np.ndarray, lo: int, hi: int, hits: list[tuple[int, int]], band: int, coverage: float) -> list[tuple[int, int, int]]:
    """(first, one after the last, words matched) of the disjoint matches of a template near hits (word, diagonal) in h[lo:hi]."""
    need, used, out, tried = coverage * len(words), np.zeros(0, bool), [], set()
    for p, shift in sorted(hits):
        a, b = max(lo, shift - band), min(hi, shift + len(words) + band)
        if (len(used) and used[p - lo]) or (shift, len(out)) in tried:
            continue
        text = h[a:b]
        if len(used):
            text = np.where(used[a - lo : b - lo], np.uint64(0), text)
        if np.isin(words, text).sum() >= need:
            n, first, last = align(words, text, shift - a, band)
            if n >= need:
                out.append((a + first, a + last, n))
                used = used if len(used) else np.zeros(hi - lo, bool)
                used[a + first - lo : a + last - lo] = True
                continue
        tried.add((shift, len(out)))
    return out


def _scan(templates: dict[str, str]):
    kind = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int32()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in pieces_of(batches, "text", 1 << 20):
            data, off = text_bytes(batch.column("text"))
            rows: list[list] = [[] for _ in range(len(batch))]
            for d, name, n, share, a, b in scan(data, off, index):
                text = data[off[d] : off[d + 1]]
                a, b = (int(((text[:x] & 0xC0) != 0x80).sum()) for x in (a, b))  # bytes to code points
                rows[d].append({"license": name, "matched": n, "coverage": share, "start": a, "end": b})
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "matches": pa.array(rows, kind)})

    return run


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, matches array<struct<license, matched words, coverage, start, end>> (code points), a row for each row of docs.

    Words are compared in lower case (A-Z). A template is reported at every place, apart from the others, where 0.8 of
    its words or more align in order with up to a fifth as many breaks as it has words: words missing, or words put in
    between (up to 12 in all). Such places are all found; one with more breaks is reported too if a fingerprint is left.
    Null, empty and wordless texts have no matches; null ids, repeated rows and other columns are allowed, the latter
    are not returned; texts are read whole. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(templates or TEMPLATES), f"doc_id {kind}, matches array<struct<license: string, matched: int, coverage: double, start: long, end: long>>")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    best = F.array_max(F.transform("matches", lambda m: m["coverage"]))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(name, ",").alias("spans"), F.coalesce(best, F.lit(0.0)).alias("coverage"))
