"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are runs of ASCII letters and digits or of other characters, lower-cased. Of every template the hashes of
windows of three words are winnowed: of each ``WINDOW`` neighbouring hashes the least stays, so any five words in a
row that text and template share have a fingerprint in common. Templates of fewer than ``SHORT`` words keep all their
hashes, and a text's hashes are all looked up among them, so there three words in a row are enough. The templates'
fingerprints form an inverted index, which travels with the tasks as its size is fixed by the templates, not by the
corpus. Hits of a template on neighbouring diagonals form a candidate, and the text around it is aligned with the
template in a band around those diagonals. An alignment is a match if its matched words cover at least ``least`` of
the template and none of the words that tell licences and their versions apart (``TELLING``) is among the unmatched; of
overlapping matches the one that covers more words stays.

Edge cases: null and empty text have no match; repeated rows keep a row each; equally good matches fall to the earlier
place, then to the earlier template; an empty table gives an empty result; a text may hold any number of matches;
other columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version."
    )


#: Public licences by SPDX identifier, short ones whole, long ones by their standard notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"{_PERMIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT", f"{_PERMIT}, subject to the following conditions:"),
    ("MIT-0", f"{_PERMIT}. {_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_TAIL}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}"),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("LGPL-2.1", _gnu("GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."),
)
#: Words of templates that tell licences or versions apart, beside numbers: a match has all of them.
TELLING = frozenset("mit isc bsd apache gnu lesser affero mozilla eclipse boost cc cc0 by nc sa nd noncommercial sharealike noderivatives neither".split())

GRAM, WINDOW, BAND = 3, 3, 8
#: Templates of fewer words than this keep all their fingerprints.
SHORT = 24
_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _BETWEEN[_c] = False


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word hashes, byte offsets of words' starts and ends."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = common.word_bounds(raw, _BETWEEN)
    return raw, common.word_hashes(raw, between=_BETWEEN), starts, ends


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the hashes that winnowing keeps: the last of the least of each window."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    last = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(len(views)) + last)


def _grams(words: np.ndarray) -> np.ndarray:
    return common.window_hashes(words, GRAM) if len(words) >= GRAM else np.empty(0, np.uint64)


class Index:
    """The inverted index: sorted fingerprints with template and place, of short templates and of the others."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        self.words, self.telling = [], []
        rows: tuple[list, list] = ([], [])
        for t, (_, text) in enumerate(templates):
            raw, words, starts, ends = words_of(text)
            said = [raw[a:b].tobytes().decode().lower() for a, b in zip(starts, ends)]
            self.words.append(words)
            self.telling.append(np.array([i for i, w in enumerate(said) if w.isdigit() or w in TELLING or w[1:].isdigit()], np.int64))
            grams, short = _grams(words), len(words) < SHORT
            rows[short].extend((int(grams[p]), t, int(p)) for p in (range(len(grams)) if short else winnow(grams)))
        self.tables = []
        for part in rows:
            part.sort()
            self.tables.append((np.array([r[0] for r in part], np.uint64), np.array([r[1:] for r in part], np.int64).reshape(-1, 2)))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Template and diagonal (place in the text less place in the template) of common fingerprints, one for each half band."""
        grams, found = _grams(words), []
        for (hashes, places), at in zip(self.tables, (winnow(grams), np.arange(len(grams)))):
            low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            n = high - low
            if not n.any():
                continue
            entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([places[entry, 0], np.repeat(at, n) - places[entry, 1]], 1))
        if not found:
            return []
        out, last = [], (-1, 0)
        for t, shift in np.unique(np.concatenate(found), axis=0).tolist():
            if t != last[0] or shift > last[1] + BAND // 2:
                last = (t, shift)
                out.append(last)
        return out


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(templates)


#: What a matched word counts against a word of the text that is passed over.
MATCH = 1 << 12


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """The template's and the text's places of the words matched in order within the band: the most, in the shortest span.

    Cell (i, j) pairs template word i with text word i + shift + j - band. A row of cells is worked out at once.
    """
    width, n = 2 * band + 1, len(template)
    at = np.arange(n)[:, None] + shift + np.arange(width) - band
    inside = (at >= 0) & (at < len(text))
    same = inside & (text[np.clip(at, 0, max(len(text) - 1, 0))] == template[:, None]) if len(text) else np.zeros((n, width), bool)
    steps = np.arange(width)
    score = np.zeros((n + 1, width), np.int64)
    for i in range(n):
        before = score[i]
        best = np.where(same[i], before + MATCH, np.maximum(before - 1, 0))  # both words go, matched or not
        best[:-1] = np.maximum(best[:-1], before[1:])  # the template's word goes
        score[i + 1] = np.maximum.accumulate(best + steps) - steps  # the text's word goes, at a cost of one
    np.maximum(score, 0, out=score)
    i, j, pairs = n, int(np.argmax(score[n])), []
    while i and score[i, j] > 0:
        here, before = score[i, j], score[i - 1]
        if same[i - 1, j] and here == before[j] + MATCH:
            pairs.append((i - 1, int(at[i - 1, j])))
            i -= 1
        elif j + 1 < width and here == before[j + 1]:
            i, j = i - 1, j + 1
        elif here == before[j] - 1:
            i -= 1
        else:
            j -= 1
    pairs.reverse()
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def find(text: str, index: Index, least: float) -> list[tuple[int, int, str, float]]:
    """Start, end (code points), licence and coverage of every match, by start."""
    raw, words, starts, ends = words_of(text)
    found = []
    for t, shift in index.candidates(words):
        template = index.words[t]
        base = max(0, shift - BAND)
        mine, theirs = align(template, words[base : max(0, shift + len(template) + BAND)], shift - base)
        if len(mine) >= least * len(template) and np.isin(index.telling[t], mine).all():
            found.append((len(mine), base + int(theirs[0]), base + int(theirs[-1]), t, len(mine) / len(template)))
    kept: list[tuple[int, int, int, int, float]] = []
    used = np.zeros(len(words), bool)
    for m in sorted(found, key=lambda m: (-m[0], -m[4], m[1], m[3])):
        if not used[m[1] : m[2] + 1].any():
            used[m[1] : m[2] + 1] = True
            kept.append(m)
    kept.sort(key=lambda m: m[1])
    point = lambda offset: len(raw[:offset].tobytes().decode("utf-8", "surrogatepass"))
    return [(point(starts[m[1]]), point(ends[m[2]]), index.names[m[3]], m[4]) for m in kept]


def scan_licenses(docs: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and matches, an array of (start, end, license, coverage)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(templates)
        for b in batches:
            found = [[dict(zip(("start", "end", "license", "coverage"), m)) for m in find(t.as_py() or "", index, least)] for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    schema = f"doc_id {narrow.schema[0].dataType.simpleString()}, matches array<struct<start: long, end: long, license: string, coverage: double>>"
    return narrow.mapInArrow(run, schema)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(common.documents(spark, sf_dir))
    span = lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])
    return out.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("matches", span), ",").alias("spans"),
    )
