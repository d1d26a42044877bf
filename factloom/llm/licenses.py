"""License scans with a generalised suffix automaton of license tokens.

The automaton holds all template texts and base phrases as strings of word ids. A file's words
stream through it and give matching statistics: at each word, the longest run ending there that
some template contains. Long maximal matches, at every place that they have in a template, are
chained in text order and template order with bounded gaps in the text; the chains that cover
most words of a template are its spans, and those that cover enough of it label it.
Notices are short names of licenses; they label where they stand whole.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased.
Defined results: null and empty texts have no words and no labels; rows are independent; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import LOWER, prefix_sums, runs, slices, span_hashes, texts

# Base phrases and their labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Openings and conditions of well-known public license texts: (label, text).
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
_CC = (("by", "attribution"), ("by nc", "attribution noncommercial"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"))
_CC += (("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
#: Names and clauses that tell licenses of alike texts apart: (label, words that stand whole).
NOTICES = (
    *((f"cc-{short.replace(' ', '-')}", f"{name} {version}") for short, long in _CC for version in ("1.0", "2.0", "2.5", "3.0", "4.0") for name in (f"cc {short}", f"creative commons {long}", f"creative commons {long.replace('noncommercial', 'non commercial')}")),
    ("cc0", "CC0 1.0"),
    ("cc0", "creative commons zero"),
    ("lgpl", "Lesser General Public License"),
    ("lgpl", "Library General Public License"),
    ("agpl", "Affero General Public License"),
    ("mpl", "Mozilla Public License"),
    ("isc", "ISC License"),
    ("isc", "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2-clause", "BSD 2-Clause"),
    ("bsd-3-clause", "BSD 3-Clause"),
    ("unlicense", "the Unlicense"),
    # its warranty: with these words it is not the like clause of the Unlicense
    ("mit", "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
)
NOTICES = tuple(dict.fromkeys(NOTICES))

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MEMBER = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class SuffixAutomaton:
    """All substrings of several word-id strings; ends: where in which string each state's substrings end, ascending."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for string in strings:
            last = 0
            for c in string:
                last = self._extend(last, c)
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.next]
        for k, string in enumerate(strings):
            state = 0
            for i, c in enumerate(string):
                state = up = self.next[state][c]
                while up > 0:
                    self.ends[up].setdefault(k, []).append(i + 1)
                    up = self.link[up]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's string followed by c, split off its longer companions where needed."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """Matching statistics one word on."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0


class Scanner:
    """The automaton with its vocabulary; least: words of a long match; gap: words a chain may skip."""

    def __init__(self, base=BASE, templates=TEMPLATES, least: int = 4, gap: int = 12, cover: float = 0.5, notices=NOTICES):
        self.base, self.templates, self.least, self.gap, self.cover = base, templates, least, gap, cover
        self.notices = notices
        strings = [words_of(t) for t, _ in base] + [words_of(t) for _, t in (*templates, *notices)]
        self.first_notice = len(base) + len(templates)
        self.sizes = [len(s) for s in strings]
        vocabulary = sorted({w for s in strings for w in s})
        ids = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = SuffixAutomaton([[ids[w] for w in s] for s in strings])
        raw = [w.encode() for w in vocabulary]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(w) for w in raw])
        hashes = span_hashes(prefix_sums(data), ends - [len(w) for w in raw], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # base phrases and notices that end where a state ends: all of its suffixes' phrases
        self.phrases: list[tuple[tuple[int, int], ...]] = []
        for state in range(len(self.automaton.next)):
            up, found = state, []
            while up > 0:
                found += [(self.sizes[k], k) for k, ends in self.automaton.ends[up].items() if not len(base) <= k < self.first_notice and ends[0] == self.sizes[k] == self.automaton.length[up]]
                up = self.automaton.link[up]
            self.phrases.append(tuple(found))

    def word_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vocabulary ids, -1 for other words."""
        hashes = span_hashes(prefix_sums(data), starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
        lower = LOWER[data]
        starts, ends, row = runs(lower, offsets, _MEMBER)
        counts = np.bincount(row, minlength=len(offsets) - 1)
        out = [{"n_words": int(n), "base": [], "matches": [], "notices": []} for n in counts]
        if len(starts):
            ids = self.word_ids(lower, starts, ends)
            first = np.cumsum(counts) - counts
            known = np.flatnonzero(ids >= 0)
            fresh = np.ones(len(known), bool)
            fresh[1:] = (np.diff(known) > 1) | (row[known[1:]] != row[known[:-1]])
            at = np.flatnonzero(fresh)
            lengths = np.diff(np.append(at, len(known)))
            for k, n in zip(known[at[lengths > 1]].tolist(), lengths[lengths > 1].tolist()):
                self._stream(ids[k : k + n].tolist(), k - int(first[row[k]]), out[row[k]])
        for x in out:
            self._label(x)
        return out

    def _stream(self, ids: list[int], at: int, out: dict) -> None:
        """Matching statistics of a run of known words that begins at word `at`."""
        automaton, state, length = self.automaton, 0, 0
        for i, c in enumerate(ids):
            before = (state, length)
            state, length = automaton.step(state, length, c)
            if length <= before[1] and before[1] >= self.least:
                out["matches"].append((at + i, *before))
            for n, phrase in self.phrases[state]:
                if n <= length:
                    out["base" if phrase < len(self.base) else "notices"].append((at + i + 1 - n, phrase))
        if length >= self.least:
            out["matches"].append((at + len(ids), state, length))

    def _label(self, out: dict) -> None:
        """Spans of each template that chains of matches cover; the share of a template that the best one covers."""
        spans, score = [], 0.0
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for end, state, length in out["matches"]:
            for k, places in self.automaton.ends[state].items():
                if len(self.base) <= k < self.first_notice:
                    found.setdefault(k, []).extend((end, place, end - length, length) for place in places)
        for k, matches in sorted(found.items()):
            for words, start, end in self._chains(sorted(matches)):
                share = words / self.sizes[k]
                score = max(score, share)
                if share < self.cover:
                    break
                spans.append({"label": self.templates[k - len(self.base)][0], "start": start, "end": end, "share": share})
        for at, k in out["notices"]:
            score = 1.0
            spans.append({"label": self.notices[k - self.first_notice][0], "start": at, "end": at + self.sizes[k], "share": 1.0})
        out |= {"spans": spans, "score": score}

    def _chains(self, matches: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """(template words, text start, text end) of chains that share no text, those with most words first.

        matches: (text end, template end, text start, length), ascending. A match carries on the
        chain that gives most words among those that end before it in the text and in the
        template, at most `gap` words back; what overlaps counts once.
        """
        held: list[tuple[int, int]] = []  # (words, text start) of the best chain that ends with each match
        for j, (end, place, start, length) in enumerate(matches):
            best = (length, -start)
            for i in range(j - 1, -1, -1):
                if matches[i][0] < start - self.gap:
                    break
                more = min(length, place - matches[i][1], end - matches[i][0])
                if more > 0:
                    best = max(best, (held[i][0] + more, -held[i][1]))
            held.append((best[0], -best[1]))
        taken: list[tuple[int, int]] = []
        for words, start, end in sorted(((n, at, m[0]) for (n, at), m in zip(held, matches)), key=lambda c: (-c[0], c[1], c[2])):
            k = bisect_left(taken, (start, end))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                insort(taken, (start, end))
                yield words, start, end


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_words, base (label, word) of all places, spans of templates, score of the best cover."""
    scanner = scanner or Scanner()
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scanner.scan(*texts(batch))
            base = [[{"label": scanner.base[k][1], "word": w} for w, k in x["base"]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x["n_words"] for x in found], pa.int64()),
                    pa.array(base, base_type),
                    pa.array([x["spans"] for x in found], span_type),
                    pa.array([x["score"] for x in found], pa.float64()),
                ],
                ["doc_id", "n_words", "base", "spans", "score"],
            )

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(
        run,
        f"doc_id {dict(kept.dtypes)['doc_id']}, n_words long, base array<struct<label:string,word:bigint>>, "
        "spans array<struct<label:string,start:bigint,end:bigint,share:double>>, score double",
    )
