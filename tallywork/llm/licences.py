"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A document is looked at whole, by paragraphs, by lines and by windows of words wherever they start. A template of n bigrams can
match only where n * threshold / (2 - threshold) of them stand, so a text is passed over at once unless it holds one of the rarest
bigrams of a template, as many as it may not miss altogether, and then that many of its bigrams. What is left is searched in full.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import in_pieces, per_process, settings
from tallywork.llm.licence_texts import BODIES

THRESHOLD = 0.8
# The templates of one scan have at most this many characters, as every task holds them.
TEMPLATE_CHARACTERS = 4_000_000
# Windows for a template of fewer bigrams are at least as long as it, since one word of a notice may tell two licences apart.
SHORT = 32
_WORD = re.compile(r"[^\W_]+")
_COPYRIGHT = re.compile(r"^\W*(?:copyright\b|©|\(c\)).*$", re.I | re.M)

# Short licences and the notices that name licences. Notices that differ in a version or a word stand side by side,
# so that the right one is the best.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License v3.0."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License v2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)


def _family(notice: str) -> tuple[tuple[str, str], ...]:
    """The notice of GPL-3.0 as the other GNU licences have it."""
    older = notice.replace("version 3", "version 2")
    return (
        ("GPL-2.0", older),
        ("LGPL-2.1", older.replace("General Public", "Lesser General Public").replace("version 2", "version 2.1")),
        ("LGPL-3.0", notice.replace("General Public", "Lesser General Public")),
        ("AGPL-3.0", notice.replace("General Public", "Affero General Public")),
    )


TEMPLATES = NOTICES + _family(next(text for name, text in NOTICES if name == "GPL-3.0" and len(text) > 400)) + BODIES


def words(text: str) -> list[str]:
    """Normalised words: lower case, letters and digits alone, without lines of copyright."""
    return _WORD.findall(_COPYRIGHT.sub("", text).lower())


def bigrams(of: Sequence[str]) -> set[tuple[str, str]]:
    """The pairs of neighbours."""
    return set(zip(of, of[1:], strict=False))


class Templates:
    """Templates in order of their number of bigrams, with indexes from bigram to template."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float = THRESHOLD):
        if sum(len(text) for _, text in templates) > TEMPLATE_CHARACTERS:
            raise ValueError(f"templates of more than {TEMPLATE_CHARACTERS} characters")
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies above 0 and at most at 1")
        self.threshold, self.reach = threshold, (2 - threshold) / threshold
        texts = sorted(((words(text), name) for name, text in templates), key=lambda t: (len(bigrams(t[0])), t[1]))
        texts = [(of, name) for of, name in texts if len(of) > 1]
        self.sets = [bigrams(of) for of, _ in texts]
        self.sizes, self.names, self.lengths = [len(s) for s in self.sets], [name for _, name in texts], [len(of) - 1 for of, _ in texts]
        self.needs = [max(1, math.ceil(size / self.reach - 1e-9)) for size in self.sizes]
        self.index: dict[tuple[str, str], list[int]] = {}
        for number, pairs in enumerate(self.sets):
            for pair in pairs:
                self.index.setdefault(pair, []).append(number)
        # a match holds at least one of any size - need + 1 bigrams of its template: the ones of longest words among the rarest
        self.anchors: dict[tuple[str, str], list[int]] = {}
        for number, pairs in enumerate(self.sets):
            rare = sorted(pairs, key=lambda p: (-min(len(p[0]), len(p[1])), len(self.index[p]), p))
            for pair in rare[: self.sizes[number] - self.needs[number] + 1]:
                self.anchors.setdefault(pair, []).append(number)

    def bounds(self, size: int) -> tuple[int, int]:
        """The candidates for a part with `size` bigrams, as a range of template numbers."""
        return bisect_left(self.sizes, size / self.reach - 1e-9), bisect_right(self.sizes, size * self.reach + 1e-9)

    def best(self, pairs: set[tuple[str, str]]) -> tuple[float, str] | None:
        """Coefficient and name of the best template of a part, the first name of equals, if it reaches the threshold."""
        low, high = self.bounds(len(pairs))
        if low >= high:
            return None
        shared = Counter(number for pair in pairs & self.index.keys() for number in self.index[pair] if low <= number < high)
        scored = [(2 * n / (len(pairs) + self.sizes[number]), self.names[number]) for number, n in shared.items()]
        top = min(((-score, name) for score, name in scored if score >= self.threshold - 1e-12), default=None)
        return None if top is None else (-top[0], top[1])

    def candidates(self, pairs: set[tuple[str, str]]) -> list[int]:
        """The templates of which a text with these bigrams holds enough for any part of it to match."""
        anchored = {number for pair in pairs & self.anchors.keys() for number in self.anchors[pair]}
        return sorted(number for number in anchored if len(pairs & self.sets[number]) >= self.needs[number])

    def windows(self, of: Sequence[str], numbers: Sequence[int]) -> list[tuple[float, int, int]]:
        """(coefficient, first word, word after the last) of the best window at every start, the longest of equals, of those
        that reach the threshold.

        A window starts with a bigram of the template, or as late as the text allows. It has up to `reach` times the words of the
        template, and as few as a `reach`th of them if the template is not short.
        """
        places: dict[tuple[str, str], int] = {}
        pairs = list(zip(of, of[1:], strict=False))
        # where the same bigram stood last: it is new to a window that starts behind that place
        before = np.empty(len(pairs), np.int64)
        for at, pair in enumerate(pairs):
            before[at] = places.get(pair, -1)
            places[pair] = at
        out = []
        for number in numbers:
            size, length, members = self.sizes[number], self.lengths[number], self.sets[number]
            least = length if size < SHORT else math.ceil(length / self.reach)
            most = max(least, math.floor(length * self.reach))
            if len(pairs) < least:
                continue
            inside = np.fromiter((pair in members for pair in pairs), bool, len(pairs))
            total = np.concatenate(([0], np.cumsum(inside)))
            starts = np.flatnonzero(inside)
            starts = np.union1d(starts[starts <= len(pairs) - least], [len(pairs) - least])
            reached = total[np.minimum(starts + most, len(pairs))] - total[starts]
            for start in starts[reached >= self.needs[number]].tolist():
                new = before[start : start + most] < start
                held = np.cumsum(new & inside[start : start + most])
                if held[-1] < self.needs[number]:
                    continue
                scores = (2 * held / (np.cumsum(new) + size))[least - 1 :]
                end = len(scores) - 1 - int(scores[::-1].argmax())
                if scores[end] >= self.threshold - 1e-12:
                    out.append((float(scores[end]), start, start + least + end + 1))
        return out

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, name, coefficient) of the parts that match, in order: the whole text, its paragraphs (lines up to an empty
        one), its lines, and windows of words. A match inside a longer one is listed too, but of windows only those that hits of
        at least the same coefficient do not cover by more than half."""
        numbers = self.candidates(bigrams(words(text)))
        if not numbers:
            return []
        lines = text.split("\n")
        found = [words(line) for line in lines]
        starts = [0]
        for line in lines:
            starts.append(starts[-1] + len(line) + 1)
        spans = {(0, len(lines)): None} | dict.fromkeys((i, i + 1) for i in range(len(lines)))
        first = None
        for i, line in enumerate([*lines, ""]):
            if line.strip():
                first = i if first is None else first
            elif first is not None:
                spans[first, i] = None
                first = None
        of, places, at = [], [], [0]
        for start, line, kept in zip(starts, lines, found, strict=False):
            for match in _WORD.finditer(line if kept else ""):
                for word in _WORD.findall(match[0].lower()):
                    of.append(word)
                    places.append((start + match.start(), start + match.end()))
            at.append(len(of))
        hits, covers, taken = [], [], np.zeros(len(of), bool)
        for a, b in spans:
            part = found[a] if b == a + 1 else [word for line in found[a:b] for word in line]
            if (hit := self.best(bigrams(part))) is not None:
                hits.append((starts[a], starts[b] - 1, hit[1], hit[0]))
                covers.append((-hit[0], 0, at[a], at[b]))
        covers += ((-score, 1, a, b) for score, a, b in self.windows(of, numbers))
        for _, window, a, b in sorted(covers, key=lambda c: (c[0], c[1], c[2] - c[3], c[2])):
            if window:
                if 2 * int(taken[a:b].sum()) > b - a:
                    continue
                start, end = places[a][0], places[b - 1][1]
                if (hit := self.best(bigrams(words(text[start:end])))) is None:
                    continue
                hits.append((start, end, hit[1], hit[0]))
            taken[a:b] = True
        return sorted(hits)


FOUND = "ARRAY<STRUCT<start: BIGINT, end: BIGINT, licence: STRING, dice: DOUBLE>>"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, `licence`, `dice` and `found` of every row of `docs` (doc_id, text).

    `found` lists the matching parts with their spans in code points; `licence` and `dice` are those of the highest coefficient,
    the first of equals, null if nothing matches. A null or empty text, or one of a single word, has no bigram and no match. Rows
    are scanned one by one; other columns are not read. The templates go to every task, at most `TEMPLATE_CHARACTERS` of them.
    """
    spark = settings(docs.sparkSession)
    Templates(templates, threshold)
    shared = spark.sparkContext.broadcast(list(templates))
    part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())])
    out = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_process(("licences", threshold, *shared.value), lambda: Templates(shared.value, threshold))

        def each() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    yield doc_id, [dict(zip(("start", "end", "licence", "dice"), hit, strict=True)) for hit in known.scan(text or "")]

        return in_pieces(each(), out, lambda row: 64 * len(row[1]))

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id BIGINT, found {FOUND}")
    best = F.try_element_at(F.array_sort("found", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).otherwise(0)), F.lit(1))
    return rows.select("doc_id", best["licence"].alias("licence"), best["dice"].alias("dice"), "found")
