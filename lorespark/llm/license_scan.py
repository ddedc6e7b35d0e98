"""License scans by patience alignment.

Texts and templates are compared as lower-cased words. A template is looked for
around each place of each word it needs. There, words unique to both sides are
anchors; the longest increasing run of them is kept; the gaps between anchors are
aligned in the same way, and equal words next to anchors are taken too. Coverage is
the share of the template's words matched. Of finds that overlap, the one with the
most words on the least room is the notice. In a notice of at most ``SHORT`` words all
words but the frame's (license, under, the, ...) must match, since they are its name.

Exact bounds, in integers, drop templates and places before that: of words that
make up more than (1 - c) of a template, a notice of coverage c has at least one
(the needed words), and a stretch of text without a share c of the words has none.

Defined results. Null, empty or unmatched text: no license, coverage 0. Of equal
coverage the longer template wins, then the first by name. Repeated notices
count each in ``n_notices``; repeated rows give equal rows. An empty table gives no rows.
A very long text is scanned whole, one window around each needed word. Columns beside
doc_id and text are ignored. No shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_TEXT = (
    "{title} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, "
    "but changing it is not allowed."
)
_GNU_HEADER = (
    "{what} is free software{sep} you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation{sep2} either version {version} of the "
    "License, or (at your option) any later version."
)

#: Notices, headers and short whole texts by license, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _BSD,
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3,
    "BSD-3-Clause-text": _BSD + _BSD_3 + _BSD_END,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "MIT": "Released under the MIT License.",
    "MIT-text": _MIT,
    "MIT-whole": (
        _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}
#: The GNU licenses, of which a whole text is told by its opening; Creative Commons licenses; ids met in SPDX lines.
for _id, _title, _version, _date, _year in (
    ("GPL-2.0", "GNU General Public License", "2", "June 1991", "1989, 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007", "2007"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999", "1991, 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007", "2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007", "2007"),
):
    TEMPLATES[_id + "-text"] = _GNU_TEXT.format(title=_title, version=_version, date=_date, year=_year)
    TEMPLATES[_id + "-header"] = _GNU_HEADER.format(what="This library" if _id[0] == "L" else "This program", sep=":", sep2=",", title=_title, version=_version)
    TEMPLATES.setdefault(_id, f"This work is licensed under the {_title}, version {_version}.")
for _code, _name in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    TEMPLATES[f"CC-{_code}-4.0"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
    TEMPLATES[f"CC-{_code}-4.0-short"] = f"Licensed under CC {_code} 4.0."
for _id in (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 "
    "MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim WTFPL Zlib"
).split():
    TEMPLATES[f"{_id}-spdx"] = f"SPDX-License-Identifier: {_id}"
#: The words that short notices word in different ways; all others of theirs must be there.
FRAME = frozenset("a distributed is license licensed of released terms the this under v version work".split())
SHORT = 14

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first place, whose second place rises too."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
        back.append(piles[p - 1] if p else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal words of a and b, rising in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        where: dict[str, list[int]] = {}
        for k in range(i, m):
            where.setdefault(a[k], []).append(k)
        other: dict[str, list[int]] = {}
        for k in range(j, n):
            other.setdefault(b[k], []).append(k)
        anchors = _increasing([(k[0], other[w][0]) for w, k in where.items() if len(k) == 1 and len(other.get(w, ())) == 1])
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            if anchors and p + 1 < r and q + 1 < s:
                stack.append((p + 1, r, q + 1, s))
        out += anchors
    return sorted(out)


def _apart(finds: list, ends: Callable) -> list:
    """The finds, in the given order of preference, that overlap none taken before; by place."""
    taken: list = []
    lasts: list[int] = []
    for x in finds:
        first, last = ends(x)
        k = bisect_left(lasts, first)
        if k == len(taken) or ends(taken[k])[0] > last:
            taken.insert(k, x)
            lasts.insert(k, last)
    return taken


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = Fraction(str(coverage))
        self.templates = []
        for name, text in sorted(templates.items()):
            words = words_of(text)
            counts = Counter(words)
            distinct = sorted(counts, key=lambda w: (-len(w), w))
            # the names in a short notice must all be there, else it is another license's
            must = {w for w in words if w not in FRAME} if len(words) <= SHORT else set()
            # unless one of these occurs, less than the coverage can match: those missing make up too much
            need, lost = [], 0
            for w in [w for w in distinct if w in must][:1] or distinct:
                need.append(w)
                lost += counts[w]
                if lost > (1 - self.coverage) * len(words):
                    break
            at = {w: [k for k, x in enumerate(words) if x == w] for w in need}
            enough = -(-self.coverage * len(words) // 1)  # words that reach the coverage
            self.templates.append((name, words, counts, at, int(enough), frozenset(must)))
        self.sizes = {t[0]: len(t[1]) for t in self.templates}
        self.wanted = {w for t in self.templates for w in t[2]}
        # by the words that a text needs one of: the templates that may be in it
        self.by_need: dict[str, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t[3]:
                self.by_need.setdefault(w, []).append(k)

    def scan(self, text: str | None) -> tuple[str | None, float, int, int]:
        """Best license, its coverage, the place of its first matched word (-1), and how many notices reach the coverage."""
        low = (text or "").lower()
        if not any(w in low for w in self.by_need):
            return None, 0.0, -1, 0
        words = words_of(low)
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in self.wanted:
                places.setdefault(w, []).append(k)
        finds = []
        for t in sorted({k for w in places if w in self.by_need for k in self.by_need[w]}):
            name, own, counts, at, enough, must = self.templates[t]
            if sum(n for w, n in counts.items() if w in places) < enough or not must <= places.keys():
                continue
            for n, first, last in self._notices(words, places, own, counts, at, enough, must):
                finds.append((-n, -n / len(own), name, first, last))
        # of templates that claim the same words, the one that claims most of them
        own = _apart(sorted(finds), lambda x: x[3:])
        best = min(own, key=lambda x: (x[1], x[0], x[2:]), default=None)
        return (best[2], -best[1], best[3], len(own)) if best else (None, 0.0, -1, 0)

    @staticmethod
    def _notices(words, places, own, counts, at, enough, must) -> list[tuple[int, int, int]]:
        """(words matched, first and last place) of a template's notices in the text, in order."""
        size, slack, whole = len(own), len(own) // 4 + 4, -1
        finds: set[tuple[int, int, int]] = set()
        for p, w, k in sorted((p, w, k) for w in at for k, p in enumerate(places.get(w, ()))):
            if p <= whole:  # inside a find that has every word and nothing else
                continue
            lo, hi = max(0, p - at[w][-1] - slack), p - at[w][0] + size + slack
            held = set(words[lo:hi])
            if sum(n for x, n in counts.items() if x in held) < enough:
                continue
            around = [(p - a, p - a + size) for a in at[w] if p >= a] + [(lo, hi)]
            if len(at[w]) == 1:  # up to where the same word comes again, since another notice may be there
                before, after = places[w][k - 1] + 1 if k else 0, places[w][k + 1] if k + 1 < len(places[w]) else hi
                around += [(max(lo, before), min(hi, after))]
            for i, j in dict.fromkeys(around):
                pairs = patience(own, words[i:j])
                if len(pairs) >= enough and must <= {own[x] for x, _ in pairs}:
                    finds.add((len(pairs), i + pairs[0][1], i + pairs[-1][1]))
                if len(pairs) == size and pairs[-1][1] - pairs[0][1] == size - 1:
                    whole = i + pairs[-1][1]
                    break
        # the most words on the least room first; the rest where they don't overlap
        return _apart(sorted(finds, key=lambda x: (-x[0], x[2] - x[1], x[1])), lambda x: x[1:])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per document: doc_id, license, coverage, first_word, n_notices."""
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64()))],
                names=["doc_id", "license", "coverage", "first_word", "n_notices"],
            )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, n_notices long")
