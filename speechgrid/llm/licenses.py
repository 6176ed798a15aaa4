"""Licence scans by matching statistics on a generalised suffix automaton.

All licence templates, as words, are read into one suffix automaton. A text streams through it once: at each of its words the
automaton knows the longest run of words ending there that occurs in some template (the matching statistics). Runs of at least
``least`` words that cannot grow are placed in the templates that hold them, chained in order within each template, and a chain
that covers enough of a template gives its label, with the covered span of the text. Words that no template has reset the
automaton, so only stretches of known words are walked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, id_and_text, utf8

#: Phrases that give a label wherever their words stand together.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public licence notices, by label. A label may have several.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
               "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
            "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
            "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
            "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
            "this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
            "http://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
)

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label: string, first: long, last: long, covered: double>>")

#: a-z, 0-9 and every byte of a longer character stay; A-Z is lowered; the rest parts words.
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """A suffix automaton of several word sequences. State 0 is the start; ``ends`` lists, for states of at least ``least``
    words, where they end: (template, position of the last word)."""

    def __init__(self, templates: Sequence[Sequence[int]], least: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, own = [-1], [0], [[]]
        for t, ids in enumerate(templates):
            last = 0
            for pos, c in enumerate(ids):
                last = self._add(last, c, own)
                own[last].append((t, pos))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                own[self.link[s]].extend(own[s])
        self.ends = [sorted(set(e)) if n >= least else [] for e, n in zip(own, self.length, strict=True)]

    def _copy(self, p: int, q: int, c: int, own: list) -> int:
        """Split off the part of state q that is p's word run with c."""
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        own.append([])
        new = len(self.next) - 1
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _add(self, last: int, c: int, own: list) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._copy(last, known, c, own)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        own.append([])
        new, p = len(self.next) - 1, last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, c, own)
        return new

    def runs(self, ids: Sequence[int]) -> list[tuple[int, int, int]]:
        """Matching statistics of ``ids``, reduced to the runs that cannot grow to the right: (state, last position, words)."""
        out, state, n = [], 0, 0
        for pos, c in enumerate(ids):
            before = (state, n)
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            if pos and n != before[1] + 1 and before[1]:
                out.append((before[0], pos - 1, before[1]))
        if n:
            out.append((state, len(ids) - 1, n))
        return out


def chain(matches: list[tuple[int, int, int]], gap: int) -> tuple[int, int, int]:
    """The best chain of matches (text start, template start, words), both sides moving on by at most ``gap`` words between two:
    (template words covered, first text word, last text word)."""
    matches = sorted(matches)
    longest = max(m[2] for m in matches)
    best: list[tuple[int, int, int]] = []
    for k, (x, y, n) in enumerate(matches):
        mine = (n, x, x + n - 1)
        for j in range(k - 1, -1, -1):
            x2, y2, n2 = matches[j]
            if x - x2 > gap + longest:
                break
            over = max(0, x2 + n2 - x, y2 + n2 - y)
            if y > y2 and x > x2 and over < n and x - x2 - n2 <= gap and y - y2 - n2 <= gap and best[j][0] + n - over > mine[0]:
                mine = (best[j][0] + n - over, best[j][1], x + n - 1)
        best.append(mine)
    return max(best, key=lambda b: (b[0], -b[1]))


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, least: int = 4, cover: float = 0.6, gap: int = 8):
        self.ids: dict[bytes, int] = {}
        texts = [[self.ids.setdefault(w, len(self.ids)) for w in words_of(t.encode())] for _, t in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(t) for t in texts]
        self.automaton = Automaton(texts, least)
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases]
        self.least, self.cover, self.gap = least, cover, gap

    def base(self, words: list[bytes], text: bytes) -> tuple[list[int], set[str]]:
        places, labels, low = [], set(), None
        for phrase, label in self.phrases:
            rare = max(phrase, key=len)
            low = text.lower() if low is None else low
            if rare not in low:
                continue
            k, at = phrase.index(rare), -1
            while True:
                try:
                    at = words.index(rare, at + 1)
                except ValueError:
                    break
                if at >= k and words[at - k:at - k + len(phrase)] == phrase:
                    places.append(at - k)
                    labels.add(label)
        return places, labels

    def templates_in(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for s, e in known.reshape(-1, 2).tolist():
            if e - s < self.least:
                continue
            for state, last, n in self.automaton.runs(ids[s:e].tolist()):
                if n >= self.least:
                    for t, end in self.automaton.ends[state]:
                        found.setdefault(t, []).append((s + last - n + 1, end - n + 1, n))
        out = []
        for t, matches in found.items():
            # stretches far apart are chained on their own, so each occurrence has its own span
            matches.sort()
            group, reach = [matches[0]], matches[0][0] + matches[0][2]
            for m in [*matches[1:], None]:
                if m is None or m[0] > reach + self.gap:
                    covered, first, last = chain(group, self.gap)
                    if covered >= self.cover * self.sizes[t]:
                        out.append((self.labels[t], first, last, min(1.0, covered / self.sizes[t])))
                    group = []
                if m is not None:
                    group.append(m)
                    reach = max(reach, m[0] + m[2])
        return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


@lru_cache(maxsize=4)
def _scanner(*args) -> Scanner:
    return Scanner(*args)


def _scan(*args):
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()),
                        ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())])))])
    scanner = _scanner(*args)

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in utf8(b.column(1)):
            words = words_of(text)
            places, labels = scanner.base(words, text)
            spans = scanner.templates_in(words)
            rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})),
                         1.0 if labels else max((s[3] for s in spans), default=0.0), [dict(zip(("label", "first", "last", "covered"), s, strict=True)) for s in spans]))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True))], schema=schema)
    return each


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least: int = 4, cover: float = 0.6, gap: int = 8,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its words, the places of ``phrases`` (``n_base``, ``first_word``, ``last_word``, ``base_labels``), all
    ``labels`` (a template's too, when a chain of matches of at least ``least`` words, at most ``gap`` words apart, covers the part
    ``cover`` of it), a ``score`` from 0 to 1 (1 with a phrase, else the best covered part) and the covered ``spans``, in words.

    A null or wordless text has no words, empty labels, score 0 and null first and last words. A null id is kept. Repeated rows
    each get a row. Other columns are ignored. No rows give no rows."""
    args = (tuple(map(tuple, templates)), tuple(map(tuple, phrases)), least, cover, gap)
    return id_and_text(docs, id_col, text_col).mapInArrow(by_batch(_scan, *args), SCHEMA)

