"""Licence scans: matching statistics against a generalised suffix automaton of licence tokens, chained into spans.

The automaton holds every run of words of every template. A text streams through it once: after each word the state
tells the longest run that ends there and occurs in a template, and the states behind it on suffix links tell the
longest run of every other template. Maximal runs of some length are matches; matches of one template that follow each
other in both the text and the template, with small gaps, make a chain. The best chains are found by a dynamic programme
over the matches of a template, and one that covers enough of it is a span.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import id_type, text_batches

# Phrases whose every place counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Passages of well-known licences, with their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words of a text in UTF-8: runs of ASCII letters, digits and whatever isn't ASCII."""
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers; each state knows all ends of its runs in each template that has them."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]  # ends: sorted places by template
        for template, words in enumerate(sequences):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(template, []).append(at)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for template, places in self.ends[s].items():
                places.sort()
                self.ends[self.link[s]].setdefault(template, []).extend(places)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after), self.length.append(length), self.link.append(link), self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the runs that end at q and are one word longer than p's."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, p: int, w: int) -> int:
        if w in self.next[p]:
            return self._split(p, w, self.next[p][w])
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def prepare(self, least: int) -> None:
        """For each state the longest run of at least ``least`` words of every template in the states behind it: (length, ends)."""
        self.behind: list[dict[int, tuple[int, list[int]]]] = [{} for _ in self.link]
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            p = self.link[s]
            if p > 0 and self.length[p] >= least:
                self.behind[s] = self.behind[p] | {t: (self.length[p], ends) for t, ends in self.ends[p].items()}

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int, list[int]]]:
        """(template, start, length, ends in the template) of each template's own maximal runs of ``least`` words or more.

        One pass: a template's longest run is the state's where the state has it, else that of the nearest state behind it
        that does. A run is maximal where it doesn't go on with the next word. ``prepare`` comes first.
        """
        out, state, n = [], 0, 0
        before: dict[int, tuple[int, list[int]]] = {}
        for at, w in enumerate([*words, -1]):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state, n = (self.next[state][w], n + 1) if w in self.next[state] else (0, 0)
            now = self.behind[state] | {t: (n, ends) for t, ends in self.ends[state].items()} if n >= least else {}
            for t, (length, ends) in before.items():
                if t not in now or now[t][0] != length + 1:
                    out.append((t, at - length, length, ends))
            before = now
        return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], least: int, gap: int, share: float) -> None:
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]
        texts = [words_of(x.encode()) for _, x in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(x) for x in texts]
        self.number: dict[bytes, int] = {}
        sequences = [[self.number.setdefault(w, len(self.number)) for w in x] for x in texts]
        self.automaton = Automaton(sequences)
        self.automaton.prepare(least)
        self.least, self.gap, self.share = least, gap, share

    def places(self, words: list[bytes]) -> list[tuple[str, int]]:
        """(label, first word) of every place of a phrase."""
        out, flat = [], b" " + b" ".join(words) + b" "
        for phrase, label in self.phrases:
            at, word, counted = flat.find(phrase), 0, 0
            while at >= 0:
                word += flat.count(b" ", counted, at)
                counted = at
                out.append((label, word))
                at = flat.find(phrase, at + 1)
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, end, words covered, the template's words) of each span."""
        numbers = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.concatenate(([False], numbers >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        own: dict[int, list[tuple[int, int, list[int]]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                for t, start, n, ends in self.automaton.matches(numbers[a:b].tolist(), self.least):
                    own.setdefault(t, []).append((start + a, n, ends))
        out = []
        for t, runs in own.items():
            size = self.sizes[t]
            out += [(self.labels[t], start, end, min(covered, size), size) for start, end, covered in best_chains(runs, self.gap) if covered >= self.share * size]
        return sorted(out, key=lambda x: (x[1], x[2], x[0], x[4]))


def best_chains(runs: list[tuple[int, int, list[int]]], gap: int) -> list[tuple[int, int, int]]:
    """(first word, end, words covered) of the best chains of one template's runs (start, length, ends in the template), in order.

    A run may follow another where at most ``gap`` words stand between them in the text and in the template, and where it
    ends later in both; what it covers anew counts. For each run and each of its places in the template the best chain
    that ends there is kept, the later start of equal ones, until ``gap`` has passed. Of all chains the one that covers most is taken (the
    shorter, then the earlier of equal ones), then the next that doesn't overlap one that was taken, and so on.
    """
    alive: list[tuple[int, int, int, int]] = []  # end in the text, place, covered, start
    chains: list[tuple[int, int, int]] = []
    for start, n, ends in sorted(runs, key=lambda r: (r[0] + r[1], r[0])):
        end = start + n
        alive = [x for x in alive if start - x[0] <= gap]  # starts and ends of maximal runs grow together
        new = []
        for place in ends:
            best = (n, start)
            for stop, before, covered, first in alive:
                fresh = min(n, end - max(start, stop), place - before)
                if fresh > 0 and place - before <= gap + n:
                    best = max(best, (covered + fresh, first))
            new.append((end, place, *best))
        alive += new
        chains.append((max((c, s) for _, _, c, s in new)[1], end, max(c for _, _, c, _ in new)))
    taken: list[tuple[int, int, int]] = []
    for start, end, covered in sorted(chains, key=lambda c: (-c[2], c[1] - c[0], c[0])):
        if all(end <= s or e <= start for s, e, _ in taken):
            taken.append((start, end, covered))
    return sorted(taken)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, least: int = 5, gap: int = 6, share: float = 0.6) -> DataFrame:
    """(``id_col``, n_words, places array<label, start>, spans array<label, start, end, covered, template_words>).

    ``least``: words of a match; ``gap``: words that may stand between two matches of a span; ``share``: of a template
    that a span covers. One row for each row of ``docs``; a null or empty text has no words, places or spans. Null ids
    and repeated rows stay as they are, further columns aren't read, an empty table gives an empty result. Overlapping
    spans of several templates are all returned, in the order of start, end, label and size.
    """
    text_batches(docs.sparkSession)
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("template_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, least, gap, share)
        for b in batches:
            n, places, spans = [], [], []
            for x in b.column(1):
                words = words_of(x.as_py())
                n.append(len(words))
                places.append([{"label": label, "start": at} for label, at in scanner.places(words)])
                spans.append([dict(zip(("label", "start", "end", "covered", "template_words"), s, strict=True)) for s in scanner.spans(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(spans, span)], ["id", "n_words", "places", "spans"])

    fields = T.StructType([T.StructField("id", id_type(docs, id_col))])
    rest = "n_words long, places array<struct<label string, start long>>, spans array<struct<label string, start long, end long, covered long, template_words long>>"
    schema = T.StructType([*fields, *T._parse_datatype_string(rest)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def brute_force(text: str | None, phrases: dict[str, str] | None = None) -> tuple[int, list[tuple[str, int]]]:
    """Words and places by comparing every position; for tests."""
    words = words_of((text or "").encode())
    found = Counter()
    for phrase, label in (phrases or PHRASES).items():
        p = words_of(phrase.encode())
        found.update((label, k) for k in range(len(words)) if words[k : k + len(p)] == p)
    return len(words), sorted(found)
