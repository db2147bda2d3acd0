"""Licence scans by a generalised suffix automaton of licence words.

The automaton of all templates' word sequences is built on the driver (it is as large as the templates, a few thousand states).
Each document's words are streamed through it, which gives matching statistics: at every word, the length of the longest run
ending there that occurs in some template. Runs that can't grow further and are long enough are chained, in the order of the
template, into spans; a template of which enough is covered gives its label. Short phrases are templates that must
be matched whole, and are found from the same statistics: a phrase ends where the state has the phrase's state on its suffix path.
"""

from __future__ import annotations

import re

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

#: Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Licence texts, the notices that licences ask to be put into files, and the labels that they give.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software""",
    "mit-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "apache-2.0-short": """Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.
        You may obtain a copy of the License at""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "gpl-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "agpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met""",
    "bsd-2-clause": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission.""",
    "bsd-warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-terms": "provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-text": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "epl-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at""",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Words of a run that counts for a template.
LEAST_RUN = 4
#: Share of a template that its chained runs must cover.
LEAST_COVER = 0.6


def words(text: str | None) -> list[str]:
    """Words after A-Z became a-z: runs of digits, a-z and characters beyond ASCII."""
    return WORD.findall((text or "").translate(_UPPER))


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: For each state, the places (template, end) of its strings.
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    #: For each state, the phrases that are a suffix of its longest string: (phrase, words).
    phrases: list[list[tuple[int, int]]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    def add(self, name: str, sequence: list[str]) -> None:
        number = len(self.names)
        self.names.append(name)
        self.sizes.append(len(sequence))
        last = 0
        for end, word in enumerate(sequence, 1):
            last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
            self.ends[last].append((number, end))

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def finish(self, phrases: list[list[str]]) -> None:
        """Pass places up the suffix links, and note at each state the phrases that end its longest string."""
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            self.ends[self.link[s]].extend(self.ends[s])
        self.ends = [sorted(set(e)) for e in self.ends]
        self.phrases = [[] for _ in self.next]
        own: dict[int, list[tuple[int, int]]] = {}
        for number, phrase in enumerate(phrases):
            s = 0
            for w in phrase:
                s = self.next[s][self.vocabulary[w]]
            own.setdefault(s, []).append((number, len(phrase)))
        for s in reversed(order):
            self.phrases[s] = own.get(s, []) + self.phrases[self.link[s]]

    def held(self, s: int, n: int) -> dict[tuple[int, int], int]:
        """The places (template, end) of the match of ``n`` words that ends in state ``s`` and of its suffixes, with the longest length at each."""
        out: dict[tuple[int, int], int] = {}
        while n >= LEAST_RUN:
            for place in self.ends[s]:
                out.setdefault(place, n)
            s = self.link[s]
            n = self.length[s]
        return out

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: the state and the length of the longest match that ends at each word of a run of known words."""
        follow, link, length = self.next, self.link, self.length
        s = n = 0
        for c in ids:
            t = follow[s].get(c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = follow[s].get(c)
            if t is None:
                s = n = 0
            else:
                s, n = t, n + 1
            yield s, n


def build(templates: dict[str, str], phrases: dict[str, str]) -> Automaton:
    a = Automaton()
    for name, text in templates.items():
        a.add(name, words(text))
    for phrase in phrases:
        a.add("", words(phrase))
    a.finish([words(p) for p in phrases])
    return a


def chains(runs: list[tuple[int, int, int]], size: int) -> list[tuple[float, int, int]]:
    """Disjoint chains of one template's runs, each (share covered of the template's ``size`` words, first, last document word), of ``LEAST_COVER`` or more.

    Runs are (document word, template word, length) in document order. A chain covers words of both in rising order without
    overlap. The best chain comes first (of equal ones the first), then the best of those before and after it, and so on.
    Taking a chain changes no chain that ends before it, as a run that reaches beyond another's end never precedes it; of those
    after it only chains that begin within or before it are worked out again.
    """
    longest = max(n for _, _, n in runs)
    starts = [at for at, _, _ in runs]
    best: list[tuple[int, int, int]] = []
    alive = [True] * len(runs)

    def ending(i: int, floor: int) -> tuple[int, int, int]:
        """The best chain that ends with run ``i`` and begins after document word ``floor``."""
        at, place, n = runs[i]
        top = (n, at, at + n - 1)
        for j in range(i - 1, -1, -1):
            a, p, m = runs[j]
            if a <= floor or at - (a + longest) > 2 * n + 16:
                break
            overlap = max(0, a + m - at, p + m - place)
            if a < at and p < place and overlap < n and at - (a + m) <= 2 * n + 16 and best[j][0] + n - overlap > top[0]:
                top = (best[j][0] + n - overlap, best[j][1], at + n - 1)
        return top

    for i in range(len(runs)):
        best.append(ending(i, -1))
    todo = [(-b[0], b[1], i) for i, b in enumerate(best)]
    heapify(todo)
    out = []
    while todo:
        covered, first, i = heappop(todo)
        if -covered / size < LEAST_COVER:
            break
        if not alive[i] or (-covered, first) != best[i][:2]:
            continue
        last = best[i][2]
        out.append((-covered / size, first, last))
        after = bisect_right(starts, last)
        for j in range(bisect_left(starts, first - longest), after):
            alive[j] = alive[j] and starts[j] + runs[j][2] <= first
        stale = last
        for j in range(after, len(runs)):
            if starts[j] > stale + 3 * longest + 16:  # nothing from here on reaches back to a chain that begins too early
                break
            if best[j][1] <= last:
                stale = starts[j]
                best[j] = ending(j, last)
                heappush(todo, (-best[j][0], best[j][1], j))
    return out


def scan_text(a: Automaton, n_phrases: int, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, float, int, int]]]:
    """Number of words; (phrase, first word) of each phrase's places; (template, covered share, first, last word) of each covered template."""
    found = words(text)
    get = a.vocabulary.get
    ids = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
    known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
    places: list[tuple[int, int]] = []
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for begin, stop in zip(known[::2].tolist(), known[1::2].tolist()):
        if stop - begin < 2:  # a phrase has two words at least
            continue
        states = list(a.stream(ids[begin:stop].tolist()))
        for i, (s, n) in enumerate(states):
            if n >= 2 and a.phrases[s]:
                places += [(p, begin + i + 1 - size) for p, size in a.phrases[s] if size <= n]
            if n >= LEAST_RUN:
                after = a.held(*states[i + 1]) if i + 1 < len(states) else {}
                for (template, end), m in a.held(s, n).items():
                    if (template, end + 1) not in after and template < len(a.names) - n_phrases:  # it grows no further
                        runs.setdefault(template, []).append((begin + i + 1 - m, end - m, m))
    spans = []
    for template, some in sorted(runs.items()):
        spans += [(a.names[template], *x) for x in chains(sorted(some), a.sizes[template])]
    return len(found), places, spans


SCAN = "doc_id long, n_words long, phrases array<struct<label:string,word:long>>, spans array<struct<label:string,covered:double,first:long,last:long>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, n_words, phrases, spans`` of every row: each place of a phrase, and each template's chains of long matches that cover enough of it.

    Null and empty texts have no words and empty lists. Rows that repeat are scanned alike; equal places of several phrases all count;
    other columns are ignored; an empty table gives no rows. Phrases have two words or more.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    labels = list(phrases.values())
    shared = docs.sparkSession.sparkContext.broadcast(build(templates, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = [scan_text(a, len(labels), t) for t in part.column("text").to_pylist()]
                found = [[{"label": labels[p], "word": w} for p, w in places] for _, places, _ in rows]
                spans = [[{"label": t, "covered": c, "first": f, "last": e} for t, c, f, e in s] for _, _, s in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                        pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("covered", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "phrases", "spans"],
                )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and a score (the largest covered share; 1 where a phrase stands) of each scanned row."""
    base = F.array_sort(F.array_distinct(F.col("phrases.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("phrases.label"), F.col("spans.label"))))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"),
    )
