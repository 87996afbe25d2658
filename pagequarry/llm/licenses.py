"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units are a document's lines, its paragraphs (between empty lines) of more than
one line, and the whole text where it has more than one paragraph.  A unit is
put in lower case (A-Z) and reduced to words of a-z and 0-9; its set of word
bigrams is compared with each template's.  A unit of a bigrams can reach the
threshold t with a template of b only if t / (2 - t) * b <= a <= (2 - t) / t * b,
and only if it holds t / (2 - t) * b of the templates' bigrams: the bigrams'
hashes, looked up among the templates', leave few units, and the size bounds
leave few templates of each.  What is left is compared by the words themselves.

The templates are a parameter (license_id, text); `templates` has common
notices, and full texts as a whole and by paragraph.  They go to the tasks in
groups of at most `GROUP_BIGRAMS` bigrams; with one group, as usual, nothing is
shuffled, and beyond it each group is a scan of its own.

Nulls and edges: very long texts are read whole, in their units.  Null or empty texts, and texts of one word, have no bigrams
and match nothing; a null doc_id is returned as null.  Every row is judged by
its own text, whatever rows share its doc_id.  Equal units of a document count
each.  Ties for the best template go to the first license_id.  Empty tables on
either side are allowed.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import row_key

THRESHOLD = 0.9
GROUP_BIGRAMS = 200_000
NEWLINE = 0x0A
#: what stands between words: all bytes but a-z and 0-9
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

#: fixed values: short notices by which works name their licences
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: fixed values: full texts of short licences, paragraphs parted by an empty line
TEXTS = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
        "http://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\n"
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
}
#: paragraphs of fewer words than this say too little by themselves to name their licence
LEAST_PARAGRAPH = 12


def known_templates() -> list[tuple[str, str]]:
    """(license_id, text) of all notices, full texts and their paragraphs."""
    rows = [(k, t) for k, texts in NOTICES.items() for t in texts]
    for k, t in TEXTS.items():
        rows += [(k, t), *((k, x) for x in t.split("\n\n") if len(x.split()) >= LEAST_PARAGRAPH)]
    return list(dict.fromkeys(rows))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_templates(), "license_id string, text string")


class Templates:
    """A group of templates: their bigrams by word, the hashes of all, and how few of them a unit needs at least."""

    def __init__(self, rows: list[tuple[str, str]], threshold: float):
        self.threshold, self.sets = threshold, []
        hashes = []
        for license_id, text in rows:
            buf, off = tk.buffer_of(pa.array([text]))
            low = tk.LOWER[buf]
            starts, ends, woff = tk.word_spans(low, off, GAPS)
            grams = bigrams(low, starts, ends)
            if grams:
                self.sets.append((license_id, grams))
                hashes.append(tk.windows(tk.word_hashes(low, starts, ends), woff, 2)[0][: len(starts) - 1])
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        sizes = [len(g) for _, g in self.sets]
        self.need = threshold / (2 - threshold) * min(sizes, default=0)
        self.most = (2 - threshold) / threshold * max(sizes, default=0)

    def best(self, grams: frozenset) -> tuple[str, float] | None:
        """The license_id and Dice coefficient of the unit's best template at the threshold or over."""
        a, t, found = len(grams), self.threshold, []
        for license_id, b in self.sets:
            if t / (2 - t) * len(b) - 1e-9 <= a <= (2 - t) / t * len(b) + 1e-9:
                dice = round(2 * len(grams & b) / (a + len(b)), 6)
                if dice >= t:
                    found.append((-dice, license_id))
        return (min(found)[1], -min(found)[0]) if found else None


def bigrams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> frozenset:
    raw = low.tobytes()
    words = [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return frozenset(zip(words, words[1:], strict=False))


def units_of(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and end byte of every unit: lines, paragraphs of several lines, whole texts of several paragraphs."""
    docs = np.arange(len(off) - 1)
    nl = np.flatnonzero(low == NEWLINE)
    edge = np.zeros(len(low) + 2, bool)
    edge[off] = True  # documents meet there
    double = np.zeros(len(nl), bool)  # line feeds next to another of the same document
    if len(nl) > 1:
        close = (nl[1:] == nl[:-1] + 1) & ~edge[nl[1:]]
        double[1:] |= close
        double[:-1] |= close
    line_at = np.sort(np.concatenate([off[:-1], nl + 1]), kind="stable")
    line_end = np.sort(np.concatenate([off[1:], nl]), kind="stable")
    line_doc = np.searchsorted(off, line_at, "right") - 1
    # a line that starts at its document's end belongs to that one, not to the next
    out = [(np.repeat(docs, np.bincount(np.searchsorted(off, nl, "right") - 1, minlength=len(docs)) + 1) if len(docs) else line_doc, line_at, line_end)]
    gaps = nl[double]
    para_at, para_end = np.sort(np.concatenate([off[:-1], gaps + 1]), kind="stable"), np.sort(np.concatenate([off[1:], gaps]), kind="stable")
    per_doc = np.bincount(np.searchsorted(off, gaps, "right") - 1, minlength=len(docs))
    para_doc = np.repeat(docs, per_doc + 1)
    several = np.searchsorted(nl, para_end) > np.searchsorted(nl, para_at)
    out.append((para_doc[several], para_at[several], para_end[several]))
    many = per_doc > 0
    out.append((docs[many], off[:-1][many], off[1:][many]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


MATCHES = "doc_id long, id long, matches array<struct<unit:int,license_id:string,dice:double>>"


def _scan(rows: list[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(rows, threshold)
        kind = pa.list_(pa.struct([("unit", pa.int32()), ("license_id", pa.string()), ("dice", pa.float64())]))
        for b in batches:
            for i, j, buf, off in tk.chunks(b["text"]):
                low = tk.LOWER[buf]
                starts, ends, woff = tk.word_spans(low, off, GAPS)
                h, fits = tk.windows(tk.word_hashes(low, starts, ends), woff, 2)
                at = np.searchsorted(known.hashes, h)
                hit = np.zeros(len(h), bool)
                if len(known.hashes):
                    hit = fits & (known.hashes[np.minimum(at, len(known.hashes) - 1)] == h)
                sums = np.concatenate([[0], np.cumsum(hit)])
                doc, lo, hi = units_of(low, off)
                first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
                inside = sums[np.maximum(last - 1, first)] - sums[first]
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for u in np.flatnonzero((inside > 0) & (inside >= known.need - 1e-9) & (last - first > 1)):
                    f, z = int(first[u]), int(last[u])
                    if z - f > known.most and len(np.unique(h[f : z - 1])) > known.most + 1e-9:
                        continue
                    best = known.best(bigrams(low, starts[f:z], ends[f:z]))
                    if best:
                        found[doc[u]].append({"unit": int(u), "license_id": best[0], "dice": best[1]})
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), b["id"].slice(i, j - i), pa.array(found, kind)], ["doc_id", "id", "matches"])

    return run


def scan(docs: DataFrame, licences: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """MATCHES of each row: the units that match a template, each with its best one; id is the row's key."""
    rows = licences.select("license_id", "text").filter("license_id IS NOT NULL AND text IS NOT NULL").distinct()
    groups = int(rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0) // GROUP_BIGRAMS + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("id"), F.col("text").cast("string").alias("text"))
    out = None
    for g in range(groups):
        group = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).orderBy("license_id", "text").collect()]
        part = texts.mapInArrow(_scan(group, threshold), MATCHES)
        out = part if out is None else out.union(part)
    if groups == 1:
        return out
    # a unit may match templates of several groups; equal rows have equal matches
    unit = out.select("doc_id", "id", F.explode_outer("matches").alias("m")).groupBy("doc_id", "id", "m.unit").agg(F.min(F.struct(-F.col("m.dice"), "m.license_id")).alias("b"))
    match = F.when(F.col("unit").isNotNull(), F.struct("unit", F.col("b.license_id").alias("license_id"), (-F.col("b.col1")).alias("dice")))
    per = unit.groupBy("id").agg(F.collect_list(match).alias("matches"))  # a document's units, which its own lines bound
    return texts.select("doc_id", "id").join(per, "id").select("doc_id", "id", "matches")


def judge(docs: DataFrame, licences: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_matches (units with a licence), licences (sorted, comma-joined), best_license, best_dice."""
    m = scan(docs, licences, threshold)
    best = F.array_min(F.transform("matches", lambda x: F.struct((-x["dice"]).alias("d"), x["license_id"].alias("license_id"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda x: x["license_id"]))), ",")
    return m.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), best["license_id"].alias("best_license"), (-best["d"]).alias("best_dice"))
