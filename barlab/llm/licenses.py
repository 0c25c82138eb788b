"""License scans: matching statistics on a generalised suffix automaton of license texts, chained into covered spans."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.shared import ship

# Phrases that name a license, and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Public notices and license texts, and their labels.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
        be included in all copies or substantial portions of the Software."""),
    ("mit", """The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
        warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright
        holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from,
        out of or in connection with the Software or the use or other dealings in the Software."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program."""),
    ("lgpl", """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"""),
    ("agpl", """under the terms of the GNU Affero General Public License as published by the Free Software Foundation"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("boost", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
        http://www.boost.org/LICENSE_1_0.txt)"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License"""),
    ("cc-by-sa", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"""),
)

#: A-Z lower-cased, every ASCII byte that is no letter or digit a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` of the text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if isinstance(text, str) else []


class Automaton:
    """The generalised suffix automaton of several token sequences: every contiguous part of each is a path from state 0."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for n, sequence in enumerate(sequences):
            last = 0
            for i, x in enumerate(sequence):
                last = self._extended(last, x)
                self.ends[last].append((n, i))
        # ends of a state are those of the states below it, too
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _extended(self, p: int, x: int) -> int:
        known = self.next[p].get(x)
        if known is not None:
            return known if self.length[known] == self.length[p] + 1 else self._split(p, x, known)
        own = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = own
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return own

    def _split(self, p: int, x: int, q: int) -> int:
        """A state for the strings of q that are no longer than p and x."""
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = own
            p = self.link[p]
        return own

    def statistics(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest part of any sequence that ends at each token."""
        v, n = 0, 0
        for x in tokens:
            while v and x not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if x in self.next[v]:
                v, n = self.next[v][x], n + 1
            yield v, n


def chained(matches: Iterable[tuple[int, int, list[tuple[int, int]]]], sizes: Sequence[int], gap: int, enough: float) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, template words covered) of the best chain of each cluster of matches.

    matches: (last word, length, [(template, last place in it)]) in text order. Matches of one template chain where both their text
    and template places go on and at most gap words of text lie between; a chain's cover counts no word twice. A cluster ends
    after gap words without a match, or when a chain that covers enough has come to the template's end."""
    found, open_nodes, best = [], defaultdict(deque), {}

    def close(t: int) -> None:
        cover, first, last = best.pop(t)
        found.append((t, first, last, cover))
        open_nodes[t].clear()

    for last, n, places in matches:
        first = last - n + 1
        for t in sorted({t for t, _ in places}):
            nodes = open_nodes[t]
            while nodes and first - nodes[0][1] > gap + 1:
                nodes.popleft()
            if not nodes and t in best:
                close(t)
            new = []
            for end in sorted(e for own, e in places if own == t):
                cover, start = n, first
                for e, at, c, s in nodes:
                    if e < end and at < last and first - at <= gap + 1:
                        more = c + min(n, end - e, last - at)
                        if more > cover:
                            cover, start = more, s
                new.append((end, last, cover, start))
            nodes.extend(new)
            end, _, cover, start = max(new, key=lambda x: (x[2], -x[3]))
            if t not in best or cover > best[t][0]:
                best[t] = (cover, start, last)
            if best[t][0] >= enough * sizes[t] and best[t][2] == last and any(x[0] == sizes[t] - 1 and x[2] == best[t][0] for x in new):
                close(t)
    for t in list(best):
        close(t)
    return sorted(found, key=lambda x: (x[1], x[0]))


class Scanner:
    """Phrases and templates in one automaton."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], long_match: int, gap: int, enough: float):
        texts = [words(p) for p, _ in phrases] + [words(t) for _, t in templates]
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        self.n_phrases, self.long_match, self.gap, self.enough = len(phrases), long_match, gap, enough
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        sequences = [[self.number[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in texts]
        self.automaton = Automaton(sequences)
        self.follow = np.zeros((len(self.number) + 1, len(self.number) + 1), bool)
        for s in sequences:
            self.follow[s[:-1], s[1:]] = True
        # phrases that end at a state: those that are suffixes of its strings
        self.phrase_ends = [sorted({p for p, e in ends if p < self.n_phrases and e == self.sizes[p] - 1}) for ends in self.automaton.ends]
        own = {}
        for p in range(self.n_phrases):
            v = 0
            for x in sequences[p]:
                v = self.automaton.next[v][x]
            own.setdefault(v, []).append(p)
        for v in sorted(range(len(self.phrase_ends)), key=self.automaton.length.__getitem__):
            self.phrase_ends[v] = own.get(v, []) + (self.phrase_ends[self.automaton.link[v]] if v else [])
        self.template_ends = [[(t, e) for t, e in ends if t >= self.n_phrases] for ends in self.automaton.ends]

    def scan(self, text: str | None) -> tuple[int, list[tuple]]:
        """(words, spans): a span is (label, named by a phrase, first word, last word, covered share of phrase or template)."""
        get = self.number.get
        tokens = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
        pairs = np.flatnonzero(self.follow[tokens[:-1], tokens[1:]]) if len(tokens) > 1 else []
        if not len(pairs):
            return len(tokens), []
        spans, matches = [], []
        cuts = np.flatnonzero(np.diff(pairs) > 1) + 1
        # a match of two words or more lies in a run of pairs that follow each other in some sequence
        for a, b in zip(pairs[np.r_[0, cuts]], pairs[np.r_[cuts - 1, len(pairs) - 1]] + 2, strict=True):
            before = (0, 0)
            for i, (v, n) in enumerate(self.automaton.statistics(tokens[a:b].tolist()), int(a)):
                for p in self.phrase_ends[v]:
                    if self.sizes[p] <= n:
                        spans.append((self.labels[p], True, i - self.sizes[p] + 1, i, 1.0))
                if before[1] >= max(n, self.long_match):
                    matches.append((i - 1, before[1], self.template_ends[before[0]]))
                before = (v, n)
            if before[1] >= self.long_match:
                matches.append((int(b) - 1, before[1], self.template_ends[before[0]]))
        spans.extend((self.labels[t], False, first, last, cover / self.sizes[t]) for t, first, last, cover in chained(matches, self.sizes, self.gap, self.enough))
        return len(tokens), spans


SPANS = "doc_id long, n_words long, spans array<struct<label:string,named:boolean,first:long,last:long,coverage:double>>"


def license_spans(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, long_match: int = 4, gap: int = 8, enough: float = 0.5) -> DataFrame:
    """(doc_id, n_words, spans) of each row of docs (doc_id long, text string).

    Phrases are (text, label), templates (label, text). Phrases and templates are one generalised suffix automaton over words, built
    by each worker. Each text is streamed through it, which gives for each word the longest part of any template that ends there.
    A span of a phrase is every place where all its words stand consecutively (named, coverage 1). Matches of long_match words or more
    that can't go on are chained, template by template, over gaps of at most gap words; a span is a chain from its first to its last
    word, its coverage the share of the template's words.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have no words and no
    spans; a null doc_id stays null; repeated rows stand each; whole texts are read whatever their length; other columns play no part.
    Empty input gives an empty result."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, long_match, gap, enough)
        names = ("label", "named", "first", "last", "coverage")
        span = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()), strict=True))))
        for batch in batches:
            found = [scanner.scan(text) for text in batch.column("text").to_pylist()]
            spans = pa.array([[dict(zip(names, s, strict=True)) for s in spans] for _, spans in found], span)
            yield pa.record_batch([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), spans], names=["doc_id", "n_words", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def op12_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses of all documents; see license_spans for nulls, repeats, long texts and empty tables.

    labels: those of phrases, and those of templates of which a span covers at least half. score: the largest coverage of any span, 0 without."""
    spans = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    named = F.expr("filter(spans, s -> s.named)")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    return spans.select(
        "doc_id", "n_words", F.size(named).cast("long").alias("n_base"), F.array_min(F.transform(named, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(named, lambda s: s["first"])).alias("last_word"), joined(named).alias("base_labels"),
        joined(F.expr("filter(spans, s -> s.coverage >= 0.5)")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"), F.size("spans").cast("long").alias("n_spans"))


SQL: dict[str, str] = {}
