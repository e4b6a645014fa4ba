"""Licence notices in texts, by a generalised suffix automaton of template tokens.

Texts stream through the automaton word by word, which gives at every word the
longest match with any part of any template (matching statistics).  Matches
that cannot be extended are chained, per template, in the order of both text
and template; a chain that covers enough of its template is a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that name a licence, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Short public licence notices, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
)
# Whole texts of short public licences, with their labels.
WHOLE_TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
        A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
        the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
        domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at http://mozilla.org/MPL/2.0/.""",
    ),
)
MIN_MATCH = 3
MAX_GAP = 8
COVERAGE = 0.7

_TO_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and everything beyond ASCII."""
    return text.translate(_TO_WORDS).split()


class Automaton:
    """Suffix automaton of several token sequences; per state, where its strings end in each sequence."""

    def __init__(self, sequences: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                self.ends[last].add((number, at))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p reaches by c, as one whose longest string is p's and c."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES + WHOLE_TEXTS, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, coverage: float = COVERAGE):
        self.phrases, self.templates = phrases, templates
        self.parts = [words_of(p.encode()) for p, _ in phrases]
        self.sizes = [len(words_of(t.encode())) for _, t in templates]
        self.auto = Automaton([*self.parts, *(words_of(t.encode()) for _, t in templates)])
        self.min_match, self.max_gap, self.coverage = min_match, max_gap, coverage
        # phrases that end wherever a state is reached, if the match is long enough
        self.said: dict[int, list[int]] = {}
        a = self.auto
        for s in range(1, len(a.len)):
            whole = [p for p, part in enumerate(self.parts) if any(number == p and at == len(part) - 1 for number, at in a.ends[s])]
            own = [p for p in whole if a.len[s] >= len(self.parts[p])]
            up = a.link[s]
            while up > 0:  # a suffix of the state's strings
                own += [p for p, part in enumerate(self.parts) if a.len[up] >= len(part) and (p, len(part) - 1) in a.ends[up] and p not in own]
                up = a.link[up]
            if own:
                self.said[s] = own

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrases as (start, phrase), and matches that can't be extended as (end, length, state)."""
        a, found, longest = self.auto, [], []
        follow, link, length, said, least = a.next, a.link, a.len, self.said, self.min_match
        s = n = 0
        for i, c in enumerate(map(a.ids.get, words)):
            if c is None:
                if n >= least:
                    longest.append((i, n, s))
                s = n = 0
                continue
            t = follow[s].get(c)
            if t is None:
                if n >= least:
                    longest.append((i, n, s))
                while s and t is None:
                    s = link[s]
                    t = follow[s].get(c)
                n = length[s]
            if t is None:
                s = n = 0
                continue
            s = t
            n += 1
            if s in said:
                for p in said[s]:
                    if n >= len(self.parts[p]):
                        found.append((i + 1 - len(self.parts[p]), p))
        if n >= least:
            longest.append((len(words), n, s))
        return found, longest

    def chains(self, longest: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, float]]:
        """(template, start, end, share of the template) of each chain; gaps of at most ``max_gap`` words on either side."""
        first = len(self.parts)
        per: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, s in longest:
            for number, at in self.auto.ends[s]:
                if number >= first:
                    per.setdefault(number - first, []).append((end - n, at + 1 - n, n))
        for number, pieces in per.items():
            best: list[tuple[int, int, int, int]] = []  # start in the text, end there, end in the template, words covered
            near = 0
            for start, at, n in sorted(pieces):
                chain = (start, start + n, at + n, n)
                while near < len(best) and start - best[near][1] > self.max_gap:  # neither starts nor ends in the text fall
                    near += 1
                for b in best[near:]:
                    over = max(0, b[1] - start, b[2] - at)
                    if over < n and at - b[2] <= self.max_gap and b[3] + n - over > chain[3]:
                        chain = (b[0], start + n, at + n, b[3] + n - over)
                best.append(chain)
            for start, end, _, covered in best:
                yield number, start, end, covered / self.sizes[number]

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        found, longest = self.matches(words)
        base = sorted({self.phrases[p][1] for _, p in found})
        spans: dict[tuple[str, int], tuple[int, float]] = {}
        score = 0.0
        for number, start, end, share in self.chains(longest):
            score = max(score, share)
            key = (self.templates[number][0], start)
            if share >= self.coverage and share > spans.get(key, (0, 0.0))[1]:
                spans[key] = (end, share)
        return {
            "n_words": len(words), "n_base": len(found), "first_word": min((s for s, _ in found), default=None), "last_word": max((s for s, _ in found), default=None), "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(label for label, _ in spans)})), "score": min(1.0, score), "spans": [{"label": label, "start": s, "end": e, "share": x} for (label, s), (e, x) in sorted(spans.items(), key=lambda y: (y[0][1], y[0][0]))],
        }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Phrases, labels and spans of licence notices, one row per input row.

    ``score`` is the largest share of a template that one chain covers; a label
    is given for a phrase, or for a chain of ``coverage`` or more.  Null is an
    empty text: no words, no labels, score 0.  Ids may be null or repeat; other
    columns are not read.  The automaton holds the templates only, so memory
    does not grow with the input.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**options)
        spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
        for batch in batches:
            rows = [scanner.scan(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True))], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, _SCHEMA)
