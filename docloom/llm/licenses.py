"""Licence scans with a generalised suffix automaton.

The automaton holds the word sequences of all templates. A text runs through it
word by word; the state and length at each word are its matching statistics.
Maximal long matches are located in their templates and chained, in order and
with bounded gaps, into spans; the share of a template's words that a chain
covers is its score. The base phrases are templates too: a phrase stands where
the running match is at least as long and its state lies below the phrase's.

Defined cases: a null or empty text has no words, labels or spans and score 0;
texts of any length are scanned whole; of pieces that could follow one chain or
another the last begun takes them; rows with a null id and repeated rows are
scanned like any other; an empty table gives an empty result; only the id and the
text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import map_arrow
from docloom.llm.arrowtext import column

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The usual notices of public licences.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


@dataclass
class SuffixAutomaton:
    """States hold transitions, the longest length, the suffix link and the templates they occur in."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    owners: list[set[int]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.step) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, token: int) -> int:
        """The state of the text so far plus token; a state that exists already is used again."""
        q = self.step[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
        return new

    def add(self, tokens: list[int]) -> None:
        last = 0
        for t in tokens:
            last = self.extend(last, t)

    def own(self, tokens: list[int], owner: int) -> None:
        """Marks every state that holds a substring of the sequence (call when all are added)."""
        state = 0
        for t in tokens:
            state = self.step[state][t]
            up = state
            while up > 0 and owner not in self.owners[up]:
                self.owners[up].add(owner)
                up = self.link[up]

    def walk(self, state: int, length: int, token: int) -> tuple[int, int]:
        """One step of the matching statistics."""
        while state and token not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.step[state].get(token)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = 4, gap: int = 12, cover: float = 0.6):
        self.least, self.gap, self.cover = least, gap, cover
        self.vocab: dict[str, int] = {}
        self.labels = [*phrases.values(), *templates]
        self.n_phrases = len(phrases)
        self.sequences = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)] for t in [*phrases, *templates.values()]]
        self.graph = SuffixAutomaton()
        for tokens in self.sequences:
            self.graph.add(tokens)
        for k, tokens in enumerate(self.sequences):
            self.graph.own(tokens, k)
        ends: dict[int, list[int]] = defaultdict(list)
        for k in range(self.n_phrases):
            state = 0
            for t in self.sequences[k]:
                state = self.graph.step[state][t]
            ends[state].append(k)
        self.phrases_at: list[tuple[int, ...]] = []
        for state in range(len(self.graph.step)):
            found, up = [], state
            while up > 0:
                found += ends.get(up, [])
                up = self.graph.link[up]
            self.phrases_at.append(tuple(found))

    def statistics(self, tokens: list[int], begin: int, end: int):
        """(place, state, length) for the words of a run that the vocabulary knows."""
        state = length = 0
        for at in range(begin, end):
            state, length = self.graph.walk(state, length, tokens[at])
            yield at, state, length

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        get = self.vocab.get
        tokens = [get(w, 0) for w in words]
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        n = len(tokens)
        known = [k for k, t in enumerate(tokens) if t]
        k = 0
        while k < len(known):
            at = end = known[k]
            while k < len(known) and known[k] == end:
                end += 1
                k += 1
            if end - at < 2:
                continue
            before = (0, 0, 0)
            for place, state, length in self.statistics(tokens, at, end):
                for p in self.phrases_at[state]:
                    if len(self.sequences[p]) <= length:
                        places.append((place - len(self.sequences[p]) + 1, p))
                if before[2] >= self.least and length <= before[2]:
                    matches.append(before)
                before = (place, state, length)
            if before[2] >= self.least:
                matches.append(before)
        spans = self._spans(tokens, matches)
        base = sorted({self.labels[p] for _, p in places})
        starts = [s for s, _ in places]
        score = 1.0 if places else 0.0
        score = max([score, *(s[3] for s in spans)])
        return {
            "n_words": n,
            "n_base": len(places),
            "first_word": min(starts) if starts else None,
            "last_word": max(starts) if starts else None,
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(s[0] for s in spans)})),
            "score": float(score),
            "spans": spans,
        }

    def _spans(self, tokens: list[int], matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share) of each chain that covers enough of its template."""
        pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for place, state, length in matches:
            for owner in self.graph.owners[state]:
                if owner >= self.n_phrases:
                    part = tokens[place - length + 1 : place + 1]
                    pieces[owner] += [(place - length + 1, s, length) for s in _find(self.sequences[owner], part)]
        out = []
        for owner, own in pieces.items():
            total = len(self.sequences[owner])
            chains: list[list[tuple[int, int, int]]] = []
            for piece in sorted(own):
                for chain in reversed(chains):
                    text_at, own_at, size = chain[-1]
                    skipped = piece[0] - text_at - size
                    if 0 <= skipped <= self.gap and piece[1] >= own_at + size:
                        chain.append(piece)
                        break
                    if skipped > self.gap:
                        chains.append([piece])
                        break
                else:
                    chains.append([piece])
            for chain in chains:
                share = sum(p[2] for p in chain) / total
                if share >= self.cover:
                    out.append((self.labels[owner], chain[0][0], chain[-1][0] + chain[-1][2] - 1, min(1.0, share)))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def _find(sequence: list[int], part: list[int]) -> list[int]:
    return [s for s in range(len(sequence) - len(part) + 1) if sequence[s : s + len(part)] == part]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,share:double>>"
)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, **limits) -> DataFrame:
    """One row per document with its counts, labels, score and spans (see SCHEMA)."""
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
    types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}

    def run(batches):
        scanner = Scanner(templates, phrases, **limits)
        for batch in batches:
            found = [scanner.scan(x) for x in column(batch, "text").to_pylist()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            cells = [[dict(zip(("label", "first_word", "last_word", "share"), s, strict=True)) for s in f["spans"]] for f in found]
            columns = [pa.array([f[c] for f in found] if c != "spans" else cells, types.get(c, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
