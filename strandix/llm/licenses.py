"""License scan by matching statistics over a generalised suffix automaton of template words.

Texts are streamed word by word through one automaton built over all templates. Where the automaton's
match length peaks at ``min_match`` words or more, the peak is a maximal match; matches are placed in every
template that contains them and chained in text order and template order. A template's label is given when
one chain covers at least ``min_cover`` of its words. Exact phrases are reported beside that.

Defined results: a null text is treated as empty; a text without words has no places, no labels and score 0;
repeated rows are scanned each on its own; a null id is passed through; other columns are never read; an
empty table gives an empty result. Words are runs of bytes that are ASCII letters or digits, lower-cased, or
not ASCII at all.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening notices of well-known licences, as published.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
}

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable symbols.

    Each state keeps the length of its longest string, its suffix link, and (sequence, end) of its occurrences.
    """

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].append((k, i + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state reached from ``p`` by ``symbol`` whose longest string is just one longer than that of ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, symbol, self.next[p][symbol])
        return new

    def matches(self, symbols: list, least: int):
        """Maximal matches (end in ``symbols``, length, state) of at least ``least`` symbols, as they are passed."""
        state, n, moves = 0, 0, self.next
        for i, symbol in enumerate(symbols):
            if symbol in moves[state]:
                state, n = moves[state][symbol], n + 1
                continue
            if n >= least:
                yield i, n, state
            while state > 0 and symbol not in moves[state]:
                state = self.link[state]
                n = self.length[state]
            if symbol in moves[state]:
                state, n = moves[state][symbol], n + 1
            else:
                n = 0
        if n >= least:
            yield len(symbols), n, state


class LicenseScanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_match: int = 5, min_cover: float = 0.5, gap: int = 20):
        self.labels = list(templates)
        sequences = [words_of(x.encode()) for x in templates.values()]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.known = {w for s in sequences for w in s}
        self.phrases = [([w for w in words_of(p.encode())], label) for p, label in phrases.items()]
        self.min_match, self.min_cover, self.gap = min_match, min_cover, gap

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of each place where a phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            last, k, at = phrase[-1], len(phrase) - 1, 0
            try:
                while True:
                    at = words.index(last, at)
                    if at >= k and words[at - k : at + 1] == phrase:
                        out.append((at - k, label))
                    at += 1
            except ValueError:
                pass
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share) of the chains of each template, the best first, that do not overlap."""
        held = defaultdict(list)
        for at, run in self._known_runs(words):
            for end, n, state in self.automaton.matches(run, self.min_match):
                for k, stop in set(self.automaton.ends[state]):
                    held[k].append((at + end - n, stop - n, n))
        out = []
        for k, matches in sorted(held.items()):
            todo = [sorted(matches)]
            while todo:
                some = todo.pop()
                ends = self._chains(some)
                best = max(x[0] for x in ends)
                if best / self.sizes[k] < self.min_cover:
                    continue
                # all copies of the best cover that do not overlap, from left to right; what stands between them is looked at again, for less
                taken, free = [], 0
                for _, first, last in sorted(x for x in ends if x[0] == best):
                    if first >= free:
                        taken.append((first, last))
                        free = last
                out += [(self.labels[k], first, last, best / self.sizes[k]) for first, last in taken]
                at, before = 0, 0
                for first, last in [*taken, (some[-1][0] + some[-1][2] + 1,) * 2]:
                    part = []
                    while at < len(some) and some[at][0] < first:
                        if some[at][0] >= before and some[at][0] + some[at][2] <= first:
                            part.append(some[at])
                        at += 1
                    if part:
                        todo.append(part)
                    before = last
        return sorted(out, key=lambda x: (self.labels.index(x[0]), x[1]))

    def _known_runs(self, words: list[bytes]):
        """Runs of template words, at least ``min_match`` long: no match crosses another word."""
        known, least, at = self.known, self.min_match, 0
        n = len(words)
        probe = least - 1  # every run of ``least`` words holds a multiple-of-``least`` position
        while probe < n:
            if words[probe] not in known:
                probe += least
                continue
            a = probe
            while a > at and words[a - 1] in known:
                a -= 1
            b = probe + 1
            while b < n and words[b] in known:
                b += 1
            if b - a >= least:
                yield a, words[a:b]
            at, probe = b, b + least - 1 if b - a >= least else max(b, probe + least)

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """For each match the most template words that matches up to it cover in both orders, gaps bounded; with the chain's words in the text."""
        best: list[tuple[int, int, int]] = []
        low = 0
        for i, (x, y, n) in enumerate(matches):
            score, first = n, x
            while low < i and matches[low][0] + matches[low][2] + self.gap + max(self.sizes) < x:
                low += 1
            for j in range(low, i):
                a, b, m = matches[j]
                if a < x and b < y and x <= a + m + self.gap and y <= b + m + self.gap:
                    gain = n - max(0, a + m - x, b + m - y)
                    if gain > 0 and best[j][0] + gain > score:
                        score, first = best[j][0] + gain, best[j][1]
            best.append((score, first, x + n))
        return best

    def scan(self, text: bytes | None) -> tuple:
        words = words_of(text)
        return len(words), sorted(self.places(words)), self.spans(words)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """id, n_words, ``places`` (start, label) of phrases and ``spans`` (label, start, end, cover) of template text, in words."""
    held: list[LicenseScanner] = []

    def kernel(ids, texts):
        scanner = held[0] if held else held.append(LicenseScanner(**settings)) or held[0]
        for i, x in zip(ids, texts, strict=True):
            n, places, spans = scanner.scan(x)
            yield i, n, [{"start": a, "label": b} for a, b in places], [{"label": k, "start": a, "end": b, "cover": c} for k, a, b, c in spans]

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, kernel, f"{id_col} {kind}, n_words long, places array<struct<start:long,label:string>>, spans array<struct<label:string,start:long,end:long,cover:double>>", binary=True)


def op10_license_scan(spark, sf_dir):
    """Counts and labels from ``scan_licenses``: score is 1 with a phrase, else the best covered share of a template."""
    found = scan_licenses(documents(spark, sf_dir))
    labels = lambda c: F.transform(c, lambda s: s["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda s: s["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels("places"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels("places"), labels("spans")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)))).alias("score"),
    )
