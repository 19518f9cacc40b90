"""Licence scans by matching statistics over a suffix automaton of licence tokens.

The templates' word ids, one string per template, make one generalised suffix
automaton. A text is streamed through it: after each word the automaton holds
the longest suffix of the words read that occurs in some template. Where that
length ends growing, a long match is reported with the places it has in the
templates; matches in one order in both, with gaps of at most ``gap`` words, are
chained into spans of the template. Every span that covers ``least`` of its
template gives its label: a notice that stands three times gives three spans.
Base phrases are substrings of the automaton too: a phrase ends where its state
is on the suffix-link path of the state at hand.

Words outside the templates bring the automaton to its root, so only runs of
word pairs that some template has, and phrases of one word, are streamed; they
are found for a whole text at once.

Defined cases: null or empty text has no words, null positions, empty labels
and score 0; repeated rows are scanned alike; an empty table gives an empty
result; very long texts are streamed whole; of spans of one template that
overlap the one of greatest cover stays, of equal ones the one that ends first;
a column ``_l`` is replaced.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, text_batches

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that licences ask for, and short licences whole, as publicly stated by their stewards.
TEMPLATES = {
    "mit": [
        "released under the MIT License",
        "licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ],
    "apache-2.0": [
        "licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl": [
        "licensed under the GNU General Public License, version 3",
        "licensed under the GNU General Public License, version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "agpl": [
        "licensed under the GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "gfdl": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "released under the BSD License",
    ],
    "bsd-3-clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "boost-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "licensed under CC0 1.0 Universal"],
    "cc-by": ["licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nd": ["licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "reserved": ["copyright all rights reserved"],
}


def read_templates(folder: str) -> dict[str, list[str]]:
    """The driver's folder of whole licence texts, such as a Linux distribution's, as templates: a file's name is its label."""
    return {f.name.lower(): [f.read_text(errors="replace")] for f in sorted(Path(folder).iterdir()) if f.is_file() and not f.is_symlink()}


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """A generalised suffix automaton over word ids from 1; for each state the template places where its strings end."""

    def __init__(self, strings: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, s in enumerate(strings):
            last = 0
            for i, c in enumerate(s):
                last = self._extend(last, c)
                self.ends[last].add((t, i))
        # a state's strings also end where those of the states that link to it do
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length), self.link.append(link), self.next.append(edges), self.ends.append(set())
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier string has this much
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def stream(self, ids: list[int]) -> list[tuple[int, int]]:
        """Matching statistics: after each id, (state, length of the longest match that ends there)."""
        out, v, n = [], 0, 0
        for c in ids:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            else:
                v, n = 0, 0
            out.append((v, n))
        return out


class Scanner:
    """Finds base phrases and template labels in the words of texts."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], *, shortest: int = 3, gap: int = 6, least: float = 0.75) -> None:
        self.shortest, self.gap, self.least = shortest, gap, least
        self.labels, strings = [], []
        for label, texts in templates.items():
            for text in texts:
                strings.append(words_of(text.encode()))
                self.labels.append(label)
        self.sizes = [len(s) for s in strings]
        phrase_words = [words_of(p.encode()) for p in phrases]
        self.vocab: dict[bytes, int] = {}
        for w in (w for s in strings + phrase_words for w in s):
            self.vocab.setdefault(w, len(self.vocab) + 1)
        coded = [[self.vocab[w] for w in s] for s in strings + phrase_words]
        self.automaton = Automaton(coded)
        #: The pairs of words that some template or phrase has, and the phrases of one word.
        self.pairs = np.array(sorted({a * (len(self.vocab) + 1) + b for s in coded for a, b in zip(s, s[1:])}) or [0], dtype=np.int64)
        self.alone = np.zeros(len(self.vocab) + 1, dtype=bool)
        self.alone[[s[0] for s in coded[len(strings) :] if len(s) == 1]] = True
        self.phrases = list(zip(phrases.values(), (len(p) for p in phrase_words)))
        # per state the phrases that its strings end with: (phrase, least match length)
        own: dict[int, list[int]] = {}
        for k, s in enumerate(coded[len(strings) :]):
            own.setdefault(self.automaton.stream(s)[-1][0], []).append(k)
        self.at: list[list[tuple[int, int]]] = []
        for v in range(len(self.automaton.length)):
            found, u = [], v
            while u > 0:
                found += [(k, self.phrases[k][1]) for k in own.get(u, [])]
                u = self.automaton.link[u]
            self.at.append(found)

    def scan(self, ids: list[int], offset: int, bases: list[tuple[int, int]], matches: list[tuple[int, int, int]]) -> None:
        """Stream one run that begins at word ``offset``; add (phrase, start) and (start, length, state)."""
        stats = self.automaton.stream(ids)
        for j, (v, n) in enumerate(stats):
            bases += [(k, offset + j - size + 1) for k, size in self.at[v] if n >= size]
            if n >= self.shortest and (j + 1 == len(stats) or stats[j + 1][1] <= n):
                matches.append((offset + j - n + 1, n, v))

    def chain(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[float, int, int]]]:
        """For each template touched its chains that don't overlap, from the greatest: (share of its words covered, first and last word in the text)."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, v in matches:
            for t, end in self.automaton.ends[v]:
                if t < len(self.sizes):
                    by.setdefault(t, []).append((start, n, end - n + 1))
        best: dict[int, list[tuple[float, int, int]]] = {}
        steps = range(self.gap + 1)
        for t, mine in by.items():
            # the greatest chain that ends at a place of the text and of the template: words covered, where it begins
            ends: dict[tuple[int, int], tuple[int, int]] = {}
            for start, n, place in sorted(mine):
                cover, begin = max((ends[start - a, place - b] for a in steps for b in steps if (start - a, place - b) in ends), default=(0, start), key=lambda c: (c[0], c[1]))
                at = start + n, place + n
                ends[at] = max(ends.get(at, (0, 0)), (cover + n, begin))
            taken: list[tuple[float, int, int]] = []
            for cover, begin, stop in sorted(((c, b, e) for (e, _), (c, b) in ends.items()), key=lambda c: (-c[0], c[2], -c[1])):
                if not taken or (cover >= self.least * self.sizes[t] and all(stop <= a or z < begin for _, a, z in taken)):
                    taken.append((cover / self.sizes[t], begin, stop - 1))
            best[t] = taken
        return best

    def texts(self, texts: list[bytes]) -> list[dict]:
        """For each text its words' number, base places, and template matches."""
        get, out = self.vocab.get, []
        for text in texts:
            words = words_of(text)
            one = {"n_words": len(words), "bases": [], "found": {}}
            out.append(one)
            ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
            both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            pair = ids[both] * (len(self.vocab) + 1) + ids[both + 1]
            both = both[self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair]
            on = self.alone[ids]
            on[both] = on[both + 1] = True
            if not on.any():
                continue
            edge = np.diff(np.concatenate([[0], on.view(np.int8), [0]]))
            matches: list[tuple[int, int, int]] = []
            for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                self.scan(ids[a:z].tolist(), int(a), one["bases"], matches)
            if matches:
                one["found"] = self.chain(matches)
        return out


SPAN = "array<struct<label:string,share:double,first_word:bigint,last_word:bigint>>"


def scan(docs: DataFrame, *, text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: float = 0.75) -> DataFrame:
    """``docs`` with a struct _l: n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    text_batches(docs.sparkSession)
    held: dict[int, Scanner] = {}

    @F.arrow_udf(f"struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,spans:{SPAN}>")
    def run(text: pa.Array) -> pa.Array:
        if 0 not in held:
            held[0] = Scanner(templates, phrases, least=least)
        scanner, rows = held[0], []
        for x in scanner.texts(as_bytes(text)):
            places = [p for _, p in x["bases"]]
            base = {scanner.phrases[k][0] for k, _ in x["bases"]}
            spans = [{"label": scanner.labels[t], "share": s, "first_word": a, "last_word": z} for t, own in sorted(x["found"].items()) for s, a, z in sorted(own, key=lambda c: c[1]) if s >= scanner.least]
            rows.append({
                "n_words": x["n_words"], "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})),
                "score": 1.0 if base else min(1.0, max((own[0][0] for own in x["found"].values()), default=0.0)), "spans": spans,
            })
        span = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
        kind = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)])
        return pa.array(rows, kind)

    return docs.withColumn("_l", run(text_col))


def op4_licences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "_l.n_words", "_l.n_base", "_l.first_word", "_l.last_word", "_l.base_labels", "_l.labels", "_l.score", "_l.spans")
