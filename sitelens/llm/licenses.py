"""License scanning with matching statistics over a generalised suffix automaton.

The automaton holds the word sequences of all templates and phrases. A text is streamed
through it once; after each word the automaton's state and match length say how much of
the text ending there occurs in some template. The state and those its suffix links lead
to give, for every place of every template, the longest match that ends there; matches
that the next word doesn't lengthen are pieces. Pieces of one template that follow each
other in both the text and the template are chained, the best chain first, and a template
whose words a chain covers well enough is a label.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, table
from .license_texts import LICENSE_TEXTS

#: Phrases whose every place counts, by label.
BASE_PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Short notices by label, beside the licences' own texts.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2",),
    "lgpl": ("licensed under the gnu lesser general public license",),
    "cc-by-nc": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "cc-by-4.0": ("licensed under cc by 4 0", "creative commons attribution 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0",),
}
#: Further templates are passed to the operator.
TEMPLATES = {label: NOTICES.get(label, ()) + LICENSE_TEXTS.get(label, ()) for label in sorted(NOTICES.keys() | LICENSE_TEXTS.keys())}
#: Shortest match, in words, that can start or extend a chain; a shorter template is matched whole.
LEAST_MATCH = 3
#: States whose pieces a worker remembers.
MOST_REMEMBERED = 50_000
#: Most words between two pieces of a chain.
MOST_GAP = 8
#: Share of a template's words a chain must cover to be a label.
COVERED = 0.8


class SuffixAutomaton:
    """Of several word sequences; states know the places where their strings end, in memory
    that grows with the words alone: each place is held once, by subtrees of suffix links."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        self.whole: list[int] = []  # the state of each sequence as a whole
        for number, words in enumerate(sequences):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word, own)
                own[last].append((number, k + 1))
            self.whole.append(last)
        below: list[list[int]] = [[] for _ in own]
        for state in range(1, len(own)):
            below[self.link[state]].append(state)
        self.places: list[tuple[int, int]] = []
        self.first, self.last = [0] * len(own), [0] * len(own)
        stack = [(0, False)]
        while stack:
            state, done = stack.pop()
            if done:
                self.last[state] = len(self.places)
                continue
            self.first[state] = len(self.places)
            self.places += own[state]
            stack.append((state, True))
            stack += [(k, False) for k in below[state]]

    def ends(self, state: int, but: int | None = None) -> list[tuple[int, int]]:
        """(sequence, end) of the state's strings, without those of the state ``but`` linked to it."""
        if but is None:
            return self.places[self.first[state] : self.last[state]]
        return self.places[self.first[state] : self.first[but]] + self.places[self.last[but] : self.last[state]]

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, to: int, ends: list) -> int:
        """A state for the strings of ``to`` that are one word longer than ``state``'s."""
        clone = self._new(self.length[state] + 1, ends)
        self.next[clone], self.link[clone] = dict(self.next[to]), self.link[to]
        self.link[to] = clone
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes, ends: list) -> int:
        to = self.next[last].get(word)
        if to is not None:  # the string is there from an earlier sequence
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to, ends)
        new, state = self._new(self.length[last] + 1, ends), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            to = self.next[state][word]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to, ends)
        return new


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, tuple[str, ...]]):
        self.base = [(label, words) for label, p in base.items() if (words := byte_words(p))]
        self.templates = [(label, words) for label, ts in templates.items() for t in ts if (words := byte_words(t))]
        sequences = [words for _, words in self.base + self.templates]
        self.automaton = SuffixAutomaton(sequences)
        self.n_base = len(self.base)
        self.vocabulary = {w for words in sequences for w in words}
        self.least = [min(LEAST_MATCH, len(words)) for _, words in self.templates]
        self.least_of_all = min(self.least, default=LEAST_MATCH)
        #: Base phrases by the state that they end in, and for each state the nearest over suffix links that has some.
        self.phrases: dict[int, list[int]] = {}
        for n, state in enumerate(self.automaton.whole[: self.n_base]):
            self.phrases.setdefault(state, []).append(n)
        self.nearest = [0] * len(self.automaton.next)
        for state in sorted(range(1, len(self.nearest)), key=self.automaton.length.__getitem__):
            self.nearest[state] = state if state in self.phrases else self.nearest[self.automaton.link[state]]
        self.remembered: dict[int, list[tuple[int, int, bytes | None, int]]] = {}

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) after each word that matches at all; the end is exclusive."""
        steps, link, size = self.automaton.next, self.automaton.link, self.automaton.length
        vocabulary, state, length, before = self.vocabulary, 0, 0, -1
        for k in [k for k, w in enumerate(words) if w in vocabulary]:
            if k != before + 1:
                state = length = 0
            before, word = k, words[k]
            to = steps[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = steps[state].get(word)
            state, length = (to, length + 1) if to is not None else (0, 0)
            if length:
                yield k + 1, length, state

    def _phrases(self, state: int, length: int) -> Iterator[int]:
        """The base phrases that a match ends with."""
        state = self.nearest[state]
        while state:
            yield from (n for n in self.phrases[state] if len(self.base[n][1]) <= length)
            state = self.nearest[self.automaton.link[state]]

    def _pieces(self, state: int) -> list[tuple[int, int, bytes | None, int]]:
        """(template, end, its next word, length) of all matches that end with a state; length 0 stands for the whole match."""
        if state not in self.remembered:
            if len(self.remembered) >= MOST_REMEMBERED:
                self.remembered.clear()
            found, at, but = [], state, None
            while at > 0 and self.automaton.length[at] >= self.least_of_all:
                length = 0 if but is None else self.automaton.length[at]
                for n, end in self.automaton.ends(at, but):
                    if n >= self.n_base and (not length or length >= self.least[n - self.n_base]):
                        words = self.templates[n - self.n_base][1]
                        found.append((n - self.n_base, end, words[end] if end < len(words) else None, length))
                at, but = self.automaton.link[at], at
            self.remembered[state] = found
        return self.remembered[state]

    def pieces(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int, int]]]]:
        """Places (start, phrase) of base phrases, and by template the pieces (start, end, end in the template)."""
        places: list[tuple[int, int]] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in self.statistics(words):
            if self.nearest[state]:
                places += [(end - len(self.base[n][1]), n) for n in self._phrases(state, length)]
            if length >= self.least_of_all:
                following = words[end] if end < len(words) else None
                for n, at, word, shorter in self._pieces(state):
                    size = shorter or length
                    if (word is None or word != following) and size >= self.least[n]:
                        pieces.setdefault(n, []).append((end - size, end, at))
        return places, pieces

    def scan(self, text: str | None) -> dict:
        """Word count, base places, labelled spans (start, end, label, coverage) and score of a text."""
        words = byte_words(text)
        places, pieces = self.pieces(words)
        spans = sorted({s for n, parts in pieces.items() for s in self._chains(n, parts)})
        return {
            "n_words": len(words),
            "base": sorted((at, self.base[n][0]) for at, n in places),
            "spans": spans,
            "score": max([s[3] for s in spans] + [1.0] * bool(places), default=0.0),
        }

    def _chains(self, n: int, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
        """Chains that cover enough of a template, the best first; no two share a piece."""
        label, words = self.templates[n]
        need = COVERED * len(words)
        if sum(end - start for start, end, _ in parts) < need:
            return []
        parts = sorted(parts, key=lambda p: (p[1], p[0], p[2]))
        covered, before, low = [0] * len(parts), [-1] * len(parts), 0
        longest = max(end - start for start, end, _ in parts)
        for j, (start, end, at) in enumerate(parts):
            covered[j] = end - start
            # Pieces that end too early for this one end too early for those that follow as well, by the longest's length.
            while parts[low][1] < end - longest - MOST_GAP:
                low += 1
            for i in range(low, j):
                _, their_end, their_at = parts[i]
                if start - their_end <= MOST_GAP:
                    # Words that are new both in the text and in the template.
                    new = min(end - max(start, their_end), at - max(at - (end - start), their_at))
                    if new > 0 and covered[i] + new > covered[j]:
                        covered[j], before[j] = covered[i] + new, i
        spans, used = [], set()
        for j in sorted(range(len(parts)), key=lambda j: (-covered[j], j)):
            if covered[j] < need:
                break
            chain, k = [], j
            while k >= 0 and k not in used:
                chain.append(k)
                k = before[k]
            if k < 0:
                used.update(chain)
                spans.append((parts[chain[-1]][0], parts[j][1], label, round(min(1.0, covered[j] / len(words)), 6)))
        return spans


@functools.lru_cache(maxsize=4)
def _scanner(base: tuple, templates: tuple) -> Scanner:
    """One scanner for each worker process, so that the automaton is built once."""
    return Scanner(dict(base), dict(templates))


SCAN = T.StructType().add("n_words", T.LongType()).add("n_base", T.LongType()).add("first_word", T.LongType()).add("last_word", T.LongType())
SCAN = SCAN.add("base_labels", T.StringType()).add("labels", T.StringType()).add("score", T.DoubleType())
SCAN = SCAN.add("spans", T.ArrayType(T.StructType().add("first", T.LongType()).add("end", T.LongType()).add("label", T.StringType()).add("coverage", T.DoubleType())))


def with_licenses(
    docs: DataFrame,
    text: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    into: str = "license",
) -> DataFrame:
    """Add a struct with the fields of SCAN for whole texts.

    spans are half-open word ranges. Null and empty texts have no words: counts of zero,
    null positions, empty labels and a score of 0. The score is 1 if a base phrase occurs,
    else the best coverage of a labelled span. All rows and other columns stay, but for one
    named ``into``, which is replaced; equal texts have equal results.
    """
    given = tuple(base.items()), tuple((label, tuple(ts)) for label, ts in templates.items())

    @F.pandas_udf(SCAN)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(*given)
        for texts in parts:
            rows = []
            for x in map(scanner.scan, texts):
                mine = sorted({label for _, label in x["base"]})
                places = [at for at, _ in x["base"]]
                rows.append((
                    x["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(mine),
                    ",".join(sorted({*mine, *(s[2] for s in x["spans"])})), min(1.0, x["score"]),
                    [dict(zip(("first", "end", "label", "coverage"), s)) for s in x["spans"]],
                ))
            out = pd.DataFrame(rows, columns=SCAN.fieldNames())
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(into, scan(F.col(text)))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; see with_licenses."""
    seen = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return seen.select("doc_id", *[F.col(f"license.{c}").alias(c) for c in SCAN.fieldNames() if c != "spans"])
