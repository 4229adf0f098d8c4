"""License scans by patience alignment of texts with the wording of known licenses.

Words that stand once in the text and once in the notice are anchors; the longest run of anchors in the same order (patience sorting)
is kept, and the gaps between them are aligned the same way. A gap without anchors aligns its equal beginnings and ends, and the rest
by its longest common subsequence, however long it is. Coverage is the share of the notice's words that were aligned.

A notice is found where at least the coverage asked for is aligned, with at most SLACK foreign words for each of its own between the first
and the last (and two more), and where its name and version stand unbroken. Of notices that overlap, the one with most aligned words
counts, then the one with the highest coverage: a license's whole text beats its first line, and one license is reported for a place.

Where to look follows from these rules. A notice with a name has one of the name's words in it; one without has at least one of
any floor((1 - c) * n) + 1 of its n words, so the longest are looked for. Each such word says where the notice would begin; places are
gathered in cells of a notice's length, and a cell is aligned once with all words that a notice in it could reach. So the work is linear in the text.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COVERAGE = 0.8
#: Foreign words inside a notice at most, for each of its own.
SLACK = 1
#: Runs of letters and of digits: "GPLv3" has the words gplv and 3.
_WORDS = regex.compile(r"[a-z]+|[0-9]+").findall

# Names of licenses, as notices give them. (identifier, name)
NAMES = [
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD", "BSD License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"),
    ("Unlicense", "Unlicense"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-3.0", "Creative Commons Attribution 3.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
]

# The wording of published licenses and of the notices that they ask for. (identifier, form, words that must stand unbroken, wording)
TEXTS = [
    (
        "MIT", "text", "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT", "grant", "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC", "text", "provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "ISC", "grant", "provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD", "text", "with or without fee is hereby granted the software is provided",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause", "text", "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause", "text", "may be used to endorse or promote products",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-2-Clause", "conditions", "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause", "conditions", "may be used to endorse or promote products",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "Zlib", "text", "altered source versions must be plainly marked as such",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0", "text", "machine executable object code generated by a source language processor",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "Unlicense", "text", "released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    (
        "Apache-2.0", "header", "apache license version 2 0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0", "header", "mozilla public license v 2 0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]

# The notice of the GNU licenses, with its program word, name and version, and the versions that it is used with.
GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
GNU_NOTICES = [
    ("GPL-2.0", "program", "GNU General Public License", "2"),
    ("GPL-3.0", "program", "GNU General Public License", "3"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "program", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3"),
]


def tokens(text: str) -> list[str]:
    return _WORDS(text.lower())


def notices() -> list[tuple[str, str, list[str], str]]:
    """(identifier, form, phrases that must stand unbroken, wording) of all known notices."""
    out = [(name, "line", [long], f"Licensed under the {long}") for name, long in NAMES]
    out += [(name, "identifier", [f"SPDX-License-Identifier: {name}"], f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in NAMES)]
    out += [(name, "header", [long, f"version {v} of the license"], GNU.format(what=what, name=long, version=v)) for name, what, long, v in GNU_NOTICES]
    return out + [(name, form, [must] if must else [], text) for name, form, must, text in TEXTS]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs (sorted by the first) whose second increases, by patience sorting."""
    tops, piles, back = [], [], []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence. Row i holds, as bits of one integer, at which words of b the length for a[:i] stays the same."""
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for w in a:
        v = rows[-1]
        u = v & where.get(w, 0)
        rows.append((v + u | v - u) & full)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        ours, theirs = Counter(a[i:m]), Counter(b[j:n])
        where = {w: y for y, w in enumerate(b[j:n], j) if theirs[w] == 1}
        anchors = _increasing([(x, where[w]) for x, w in enumerate(a[i:m], i) if ours[w] == 1 and w in where])
        if anchors:
            out += anchors
            edges = [(i - 1, j - 1), *anchors, (m, n)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
        else:
            out += [(i + x, j + y) for x, y in _subsequence(a[i:m], b[j:n])]
    return sorted(out)


class Notice:
    def __init__(self, name: str, form: str, must: list[str], text: str, coverage: float, common_words: Counter):
        self.name, self.form, self.words, self.must = name, form, tokens(text), [f" {' '.join(tokens(x))} " for x in must]
        self.own = Counter(self.words)
        self.least = max(1, math.ceil(coverage * len(self.words) - 1e-9))
        self.slack = SLACK * len(self.words) + 2
        n = len(self.words)
        if self.must:  # any notice has this word, since its phrase must stand
            wanted = min(self.must[0].split(), key=lambda w: (common_words[w], -len(w)))
            self.picks = [p for p in range(n) if self.words[p] == wanted]
        else:
            self.picks = sorted(range(n), key=lambda p: (-len(self.words[p]), p))[: n - self.least + 1]

    def found(self, text: list[str], lo: int, hi: int) -> tuple[int, int, int] | None:
        """(aligned words, first word, end) of the notice within text[lo:hi]."""
        own = text[lo:hi]
        joined = f" {' '.join(own)} "
        if not all(phrase in joined for phrase in self.must) or (self.own & Counter(own)).total() < self.least:
            return None
        pairs = align(own, self.words)
        best, i = None, 0
        for j in range(len(pairs)):  # the fullest run of pairs with few enough foreign words
            while pairs[j][0] - pairs[i][0] - (j - i) > self.slack:
                i += 1
            if j - i + 1 >= self.least and (best is None or j - i > best[1] - best[0]):
                best = (i, j)
        if best is None:
            return None
        first, end = pairs[best[0]][0], pairs[best[1]][0] + 1
        joined = f" {' '.join(own[first:end])} "
        if not all(phrase in joined for phrase in self.must):
            return None
        return best[1] - best[0] + 1, lo + first, lo + end


class Notices:
    def __init__(self, known: list[tuple[str, str, list[str], str]], coverage: float):
        common_words = Counter(w for x in known for w in set(tokens(x[3])))
        self.notices = [Notice(*x, coverage, common_words) for x in known]
        #: word -> (number of the notice, place)
        self.picks: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for p in notice.picks:
                self.picks.setdefault(notice.words[p], []).append((k, p))

    def find(self, text: str) -> list[tuple[str, str, float, int, int]]:
        """(identifier, form, coverage, first word, end) of the notices in a text, which do not overlap, in the text's order."""
        own = tokens(text)
        picks = self.picks
        cells = {(k, (x - p) // self.notices[k].slack) for x, w in enumerate(own) if w in picks for k, p in picks[w]}
        found = set()
        for k, cell in cells:
            notice = self.notices[k]
            size = notice.slack
            # a notice of the cell begins up to size words before or after, since foreign or missing words shift its own
            todo = [(max(0, (cell - 1) * size), min(len(own), (cell + 3) * size + len(notice.words)))]
            while todo:
                lo, hi = todo.pop()
                if hi - lo >= notice.least and (hit := notice.found(own, lo, hi)):
                    found.add((hit[0], hit[0] / len(notice.words), *hit[1:], notice.name, notice.form))
                    todo += [(lo, hit[1]), (hit[2], hi)]
        out: list[tuple[str, str, float, int, int]] = []
        taken: list[tuple[int, int]] = []
        for _, coverage, first, end, name, form in sorted(found, key=lambda f: (-f[0], -f[1], f[3] - f[2], f[2], f[4])):
            at = bisect_left(taken, (first, end))
            if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (first, end))
                out.append((name, form, coverage, first, end))
        return sorted(out, key=lambda f: f[3])


FOUND = "doc_id long, license string, form string, coverage double, first_word long, end_word long"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str, list[str], str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for every notice found in a row's whole text: doc_id, license, form, coverage, first_word and end_word (words are runs of letters a-z
    in lower case, and runs of digits). Null and empty texts hold none; repeated rows are reported each; a null id stays null. Ids are cast to
    long, as the session casts."""
    known = known or notices()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Notices(known, coverage)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        for b in batches:
            out = [(i, *f) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for f in finder.find(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))
