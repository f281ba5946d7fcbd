"""License scans by patience alignment.

A text is compared with license templates word by word (words are runs of letters and digits, A-Z lower-cased). In a window
of the text, words that are unique to both window and template are anchors; the longest increasing subsequence of them is
kept, and the gaps between anchors are aligned in the same way until nothing unique is left, where equal words at the
gap's ends are matched. Coverage is the matched share of the template's words.

Every occurrence is found. A window begins at a word of the template and holds `STRETCH` words for each of the template's;
it is aligned wherever it holds enough of the template's words (counted no more often than in the template), which an
alignment of the wanted coverage needs. From the first window that reaches the coverage on, the best one (most matches,
then the tightest) of those that begin within it is a finding, cut to the run of matches that outweighs the words between them; the words before and after
it are searched again, so notices side by side, edited or not, are findings of their own. Windows are found in one pass over
a text's template words, so the time follows the text's length and the notices in it.

A finding is (license, coverage, first and last character); of findings that overlap, the one with the most matches stays,
then the one with the larger coverage, then the name. `license` is the best one of a text.

Rows: a null or empty text has no finding; repeated rows are scanned each by itself; nulls in other columns don't matter;
an empty table gives no rows; memory follows the longest text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, Words, arrow_limits, batches, utf8

COVERAGE = 0.8
#: Text words that a window may have for each template word.
STRETCH = 1.5
#: What a word between two matches takes off.
GAP = 0.5

#: Usual notices, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, in order of the first, that also increases in the second."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (place in text, place in template), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        once = Counter(text[a:b])
        where = {w: k for k, w in enumerate(template[c:d], c)}
        single = Counter(template[c:d])
        anchors = _increasing([(k, where[w]) for k, w in enumerate(text[a:b], a) if once[w] == 1 and single.get(w) == 1])
        if not anchors:
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def dense(matched: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of matches that is worth most, a match counting one and a word of the text between two matches less GAP."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for k, (place, _) in enumerate(matched):
        here -= GAP * (place - matched[k - 1][0] - 1) if k else 0
        if here < 0:
            here, start = 0.0, k
        here += 1
        if here > best:
            best, found = here, (start, k + 1)
    return matched[found[0] : found[1]]


class Templates:
    def __init__(self, templates: list[tuple[str, str]], coverage: float) -> None:
        words = Words(utf8([t for _, t in templates]), ALNUM)
        self.all = [(name, words.hash[a:b].tolist()) for (name, _), a, b in zip(templates, words.first.tolist(), words.last.tolist(), strict=True)]
        self.least = [max(1, int(np.ceil(coverage * len(w) - 1e-9))) for _, w in self.all]
        self.vocabulary = np.unique(words.hash)
        self.of_word = {int(h): [i for i, (_, w) in enumerate(self.all) if int(h) in set(w)] for h in self.vocabulary}


def _starts(at: np.ndarray, held: list[int], template: list[int], least: int, reach: int) -> list[int]:
    """Places of the hits whose windows hold at least `least` of the template's words; at, held: places and words of the hits."""
    near = np.searchsorted(at, at + reach)
    if not (near - np.arange(len(at)) >= least).any():
        return []
    room, common, out, hi = Counter(template), 0, [], 0
    for lo, end in enumerate(near.tolist()):
        for h in held[hi:end]:
            common += room[h] > 0
            room[h] -= 1
        hi = end
        if common >= least:
            out.append(int(at[lo]))
        room[held[lo]] += 1
        common -= room[held[lo]] > 0
    return out


def occurrences(hashes: np.ndarray, starts: list[int], template: list[int], least: int, end: int) -> list[tuple[int, int, int]]:
    """(matches, first word, word after the last) of the findings of a template; starts: places where windows may begin."""
    reach, out = _reach(template), []

    def best(at: list[int], last: int) -> tuple[int, int, int] | None:
        found = None
        for k in at:
            matched = dense(align(hashes[k : min(k + reach, last)].tolist(), template))
            if len(matched) >= least:
                one = (-len(matched), matched[-1][0] + 1 - matched[0][0], k + matched[0][0], k + matched[-1][0] + 1)
                found = min(found or one, one)
            if found and found[0] == -len(template) and found[1] == len(template):
                break  # nothing can be better
        return found and (-found[0], found[2], found[3])

    todo = [(0, len(starts), end)]
    while todo:
        lo, hi, last = todo.pop()
        while lo < hi:
            one = best(starts[lo : lo + 1], last)
            lo += 1
            if not one:
                continue
            inside = bisect_left(starts, starts[lo - 1] + reach, lo, hi)
            one = best(starts[lo - 1 : inside], last)
            out.append(one)
            todo.append((lo - 1, bisect_left(starts, one[1], lo - 1, hi), one[1]))  # before it
            lo = bisect_left(starts, one[2], lo - 1, hi)
    return out


def _reach(template: list[int]) -> int:
    return int(len(template) * STRETCH) + 1


def scan(words: Words, i: int, known: np.ndarray, templates: Templates) -> list[tuple[str, float, int, int]]:
    """Findings in text i, in bytes of it; known: places of the words that any template has."""
    a, b = np.searchsorted(known, [words.first[i], words.last[i]])
    places = known[a:b]
    if not len(places):
        return []
    held = words.hash[places].tolist()
    by: dict[int, list[int]] = {}
    for k, h in enumerate(held):
        for t in templates.of_word[h]:
            by.setdefault(t, []).append(k)
    found = []
    for t, ks in by.items():
        name, template = templates.all[t]
        if len(ks) < templates.least[t]:
            continue
        starts = _starts(places[ks], [held[k] for k in ks], template, templates.least[t], _reach(template))
        for matches, first, after in occurrences(words.hash, starts, template, templates.least[t], int(words.last[i])):
            found.append((matches, matches / len(template), name, int(words.start[first] - words.text_start[i]), int(words.end[after - 1] - words.text_start[i])))
    kept: list[tuple[int, int, str, float]] = []
    for _, coverage, name, first, last in sorted(set(found), key=lambda f: (-f[0], -f[1], f[2], f[3])):
        at = bisect_left(kept, (first,))
        if (at == 0 or kept[at - 1][1] <= first) and (at == len(kept) or kept[at][0] >= last):
            insort(kept, (first, last, name, coverage))
    return [(name, coverage, first, last) for first, last, name, coverage in kept]


def _points(text: bytes, found: list[tuple[str, float, int, int]]) -> list[dict]:
    """Findings, in order and apart, with code points instead of bytes."""
    out, at, n = [], 0, 0
    for name, coverage, first, last in found:
        ends = []
        for to in (first, last):
            n += len(text[at:to].decode("utf-8", "surrogatepass"))
            at = to
            ends.append(n)
        out.append({"license": name, "coverage": round(coverage, 6), "first": ends[0], "last": ends[1]})
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_licenses and findings (license, coverage, first and last code point, last exclusive)."""
    arrow_limits(docs.sparkSession)
    held = list(templates or TEMPLATES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(held, coverage)
        for batch in it:
            texts, out = utf8(batch.column(1).to_pylist()), []
            for lo, hi in batches(texts):
                words = Words(texts[lo:hi], ALNUM)
                at = np.searchsorted(known.vocabulary, words.hash)
                places = np.flatnonzero(known.vocabulary[np.minimum(at, len(known.vocabulary) - 1)] == words.hash)
                out += [_points(texts[lo + i], scan(words, i, places, known)) for i in range(hi - lo)]
            best = [max(f, key=lambda x: (x["coverage"], x["last"] - x["first"], x["license"])) if f else None for f in out]
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
            columns = [pa.array([b and b["license"] for b in best], pa.string()), pa.array([b["coverage"] if b else 0.0 for b in best], pa.float64()), pa.array([len(f) for f in out], pa.int64()), pa.array(out, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "license", "coverage", "n_licenses", "findings"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, n_licenses long, findings array<struct<license:string,coverage:double,first:long,last:long>>")
