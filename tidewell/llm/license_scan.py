"""License scans: where and how much of each license text a document holds, by patience alignment.

Words of a text and of a notice are aligned on those that occur once in both, of which the longest increasing
subsequence is kept; the gaps between anchors are aligned in the same way. Coverage is the share of the notice's
words that are aligned. An occurrence needs at least ``COVERAGE``, all of the notice's ``keys`` (what tells it from
others: a name, a version, a restriction) among the aligned words, and none of the words that would make it another license
(``unless``) between them.

A text is aligned in windows of three times the notice's length, then twice as long, and so on up to the whole text, each
stepping by a third, so that a passage of any length lies in a window not much longer than itself, and words elsewhere
don't hide it. Of alignments that overlap, the one with more words counts, then the shorter, then the first; all others are
occurrences of their own. A window is aligned only if it holds the keys and enough of the notice's words, which drops no match.

Defined cases: a null text has no words and no rows; rows that repeat an id are scanned each for itself; of equal
alignments the first counts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, namedtuple
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import modest_batches, release, texts_of

COVERAGE = 0.8

#: text: what is looked for; keys: words that must be aligned; unless: words that must not stand in between.
Notice = namedtuple("Notice", "text keys unless", defaults=("", ""))

WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
MIT_GRANT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
             "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_CONDITIONS = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                  "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                  "and/or other materials provided with the distribution.")
BSD_NAMES = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
             "without specific prior written permission.")
BSD_WARRANTY = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
                "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
                "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
                "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
                "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
             "copyright notice and this permission notice appear in all copies.")


def _gnu(name: str, version: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
            f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


OTHER_GNU, OTHER_CC = "lesser library affero", "nc sa nd noncommercial sharealike noderivatives"
# Texts of common licenses, and the notices and headers by which they are referred to.
NOTICES = {
    "apache-2.0-line": Notice("Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    "mit-line": Notice("Released under the MIT License.", "mit"),
    "bsd-line": Notice("Released under the BSD License.", "bsd"),
    "gpl-2.0-line": Notice("This work is licensed under the GNU General Public License, version 2.", "gnu general 2", OTHER_GNU),
    "gpl-3.0-line": Notice("This work is licensed under the GNU General Public License, version 3.", "gnu general 3", OTHER_GNU),
    "lgpl-2.1-line": Notice("This work is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser 2 1"),
    "lgpl-3.0-line": Notice("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    "agpl-3.0-line": Notice("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    "mpl-2.0-header": Notice("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                             "You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2 0"),
    "epl-2.0-header": Notice("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                             "https://www.eclipse.org/legal/epl-2.0/", "eclipse 2 0"),
    "cc-by-4.0-line": Notice("Licensed under CC BY 4.0.", "cc by 4 0", OTHER_CC),
    "cc-by-sa-4.0-line": Notice("Licensed under CC BY-SA 4.0.", "cc by sa 4 0", "nc"),
    "cc-by-nd-4.0-line": Notice("Licensed under CC BY-ND 4.0.", "cc by nd 4 0", "nc"),
    "cc-by-nc-4.0-line": Notice("Licensed under CC BY-NC 4.0.", "cc by nc 4 0", "sa nd"),
    "cc-by-nc-sa-4.0-line": Notice("Licensed under CC BY-NC-SA 4.0.", "cc by nc sa 4 0"),
    "cc-by-4.0-notice": Notice("This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution 4 0", OTHER_CC),
    "cc-by-sa-4.0-notice": Notice("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "commons attribution sharealike 4 0", "noncommercial"),
    "cc-by-nc-4.0-notice": Notice("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "commons attribution noncommercial 4 0",
                                  "sharealike noderivatives"),
    "cc0-1.0-notice": Notice("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
                             "cc0 waived"),
    "mit-grant": Notice(MIT_GRANT, "sublicense furnished"),
    "mit": Notice(f"{MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                  f"of the Software. {WARRANTY}", "sublicense furnished noninfringement"),
    "apache-2.0-header": Notice('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                                "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2 0 compliance"),
    "gpl-2.0-header": Notice(_gnu("General Public License", "2"), "gnu general 2", OTHER_GNU),
    "gpl-3.0-header": Notice(_gnu("General Public License", "3"), "gnu general 3", OTHER_GNU),
    "lgpl-2.1-header": Notice(_gnu("Lesser General Public License", "2.1"), "gnu lesser 2 1"),
    "lgpl-3.0-header": Notice(_gnu("Lesser General Public License", "3"), "gnu lesser 3"),
    "agpl-3.0-header": Notice(_gnu("Affero General Public License", "3"), "gnu affero 3"),
    "bsd-grant": Notice(BSD_GRANT, "redistribution binary permitted"),
    "bsd-2-clause": Notice(f"{BSD_GRANT}: {BSD_CONDITIONS} {BSD_WARRANTY}", "redistribution binary permitted disclaimed", "endorse"),
    "bsd-3-clause": Notice(f"{BSD_GRANT}: {BSD_CONDITIONS} {BSD_NAMES} {BSD_WARRANTY}", "redistribution binary permitted endorse disclaimed"),
    "isc-grant": Notice(ISC_GRANT, "fee"),
    "isc": Notice(f'{ISC_GRANT} THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
                  "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
                  "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
                  "OF THIS SOFTWARE.", "fee disclaims tortious"),
    "zlib": Notice("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
                   "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
                   "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
                   "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
                   "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
                   "misrepresented acknowledgment plainly"),
    "bsl-1.0": Notice("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
                      '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
                      "third-parties to whom the Software is furnished to do so", "reproduce transmit derivative"),
    "unlicense": Notice("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
                        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered domain"),
}

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(last[pile - 1] if pile else -1)
        tops[pile: pile + 1] = [v]
        last[pile: pile + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of equal words, rising in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        # Equal ends are aligned first; a gap without anchors has nothing else.
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        shared = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [shared[k] for k in increasing([y for _, y in shared])]
        if not anchors:
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(found)


class Sought:
    """A notice, ready to be looked for. An occurrence is its aligned positions in a text's words and in the notice's."""

    def __init__(self, name: str, notice: Notice, coverage: float):
        self.name, self.words = name, words_of(notice.text)
        self.keys, self.unless = frozenset(notice.keys.split()), frozenset(notice.unless.split())
        self.counts = Counter(self.words)
        #: Aligned words that suffice, and the places of the keys in the notice.
        self.least = coverage * len(self.words)
        self.key_places = frozenset(k for k, w in enumerate(self.words) if w in self.keys)

    def accepted(self, words: list[str], found: list[tuple[int, int]]) -> bool:
        if not found or len(found) < self.least or not self.key_places <= {y for _, y in found}:
            return False
        return self.unless.isdisjoint(words[found[0][0]: found[-1][0] + 1])

    def occurrences(self, words: list[str], held: set[str]) -> list[list[tuple[int, int]]]:
        """All occurrences, by place. held: the distinct words of the text."""
        # Words the text lacks can't be aligned.
        if not self.keys <= held or sum(n for w, n in self.counts.items() if w in held) < self.least:
            return []
        hits = [k for k, w in enumerate(words) if w in self.counts]
        found, step = [], len(self.words)
        while True:
            for begin in range(0, max(1, len(words) - 2 * step), step):
                low = bisect_left(hits, begin)
                high = bisect_left(hits, begin + 3 * step, low)
                if high - low >= self.least and self._possible(words[k] for k in hits[low:high]):
                    own = [(x + begin, y) for x, y in align(words[begin: begin + 3 * step], self.words)]
                    if self.accepted(words, own):
                        found.append(own)
            if 3 * step >= len(words):
                break
            step *= 2
        chosen: list[list[tuple[int, int]]] = []
        for own in sorted(found, key=lambda x: (-len(x), x[-1][0] - x[0][0], x[0][0])):
            if all(own[-1][0] < x[0][0] or own[0][0] > x[-1][0] for x in chosen):
                chosen.append(own)
        return sorted(chosen)

    def _possible(self, words: Iterable[str]) -> bool:
        """Whether words of the notice that a window holds are enough."""
        inside = Counter(words)
        return all(inside[w] for w in self.keys) and sum(min(n, inside[w]) for w, n in self.counts.items()) >= self.least


class Scanner:
    def __init__(self, notices: dict[str, Notice | str], coverage: float):
        made = ((name, n if isinstance(n, Notice) else Notice(n)) for name, n in notices.items())
        self.sought = [s for s in (Sought(name, n, coverage) for name, n in made) if s.words]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(notice, coverage, aligned words, start, end) in code points, for each occurrence of a notice."""
        words = words_of(text or "")
        held, found, spans = set(words), [], None
        for sought in self.sought:
            for own in sought.occurrences(words, held):
                spans = spans or [m.span() for m in WORD.finditer(text)]
                # Lower-casing may change where words end in rare alphabets; then places aren't known.
                known = len(spans) == len(words)
                start, end = (spans[own[0][0]][0], spans[own[-1][0]][1]) if known else (-1, -1)
                found.append((sought.name, len(own) / len(sought.words), len(own), start, end))
        return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, Notice | str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each occurrence of a notice in a document: id, ``license``, ``coverage``, ``n_aligned``, ``start``, ``end``."""
    modest_batches(docs)
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text" if id_col != "text" else "text_"))
    known = notices or NOTICES
    names = [id_col, "license", "coverage", "n_aligned", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scanner = Scanner(known, coverage)
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            found = [(k, *hit) for k, text in enumerate(texts_of(batch.column(1))) for hit in scanner.scan(text)]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, license string, coverage double, n_aligned long, start long, end long")
