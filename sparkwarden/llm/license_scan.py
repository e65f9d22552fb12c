"""Licence scan with a generalised suffix automaton of licence words.

The automaton holds every run of words of all templates in one structure whose size is linear in theirs.  A text is streamed
through it once; after each word the state tells the longest run of template words that ends there (matching
statistics).  Short phrases are found where a state has the whole phrase as its suffix.  Maximal runs of at least
``LEAST`` words are chained, in text order and template order with bounded gaps, into spans of a template, and a span that covers
at least ``COVER`` of its template labels the text.

A word is a run of lower-case letters, digits and non-ASCII characters of the A-Z-lowered text.  Words outside the templates end every run,
so only stretches of at least two template words reach the automaton; the rest is array work.  There is no shuffle.  Null and
empty texts have no words and no labels.  Repeated rows get equal results; columns named as the results are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkwarden.llm.common import chunks, span_hashes, widened

LEAST = 4
GAP = 8
COVER = 0.6
# The phrases of the base with their labels, and notices of public licences.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's bounds in them."""
    raw = [(t or "").encode().lower() for t in texts]
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _WORD_BYTE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(b) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return span_hashes(b, starts, ends), np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # first end of the state's runs, by sequence
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, at + 1)
        for state in sorted(range(1, len(self.step)), key=self.size.__getitem__, reverse=True):
            for number, end in self.ends[state].items():
                above = self.ends[self.link[state]]
                above[number] = min(end, above.get(number, end))

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.ends.append({})
        return len(self.step) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            to = self.step[last][word]
            return to if self.size[to] == self.size[last] + 1 else self._split(last, word, to)
        state = self._new(self.size[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = state
            at = self.link[at]
        if at >= 0:
            to = self.step[at][word]
            self.link[state] = to if self.size[to] == self.size[at] + 1 else self._split(at, word, to)
        return state

    def _split(self, at: int, word: int, to: int) -> int:
        """The runs of ``to`` that are no longer than the way over ``at`` become a state of their own."""
        part = self._new(self.size[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = part
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = part
            at = self.link[at]
        return part

    def find(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.step[state][word]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        texts = [*phrases, *(t for _, t in templates)]
        hashes, bounds = words_of(texts)
        self.known = np.unique(hashes)
        ids = np.searchsorted(self.known, hashes).tolist()
        runs = [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.length = [len(r) for r in runs]
        self.first_template = len(phrases)
        self.automaton = a = Automaton(runs)
        # phrases that are a suffix of a state's runs: (words, number)
        self.suffixes: list[list[tuple[int, int]]] = [[] for _ in a.step]
        own: dict[int, list[tuple[int, int]]] = {}
        for number in range(len(phrases)):
            own.setdefault(a.find(runs[number]), []).append((self.length[number], number))
        for state in range(len(a.step)):
            up = state
            while up > 0:
                self.suffixes[state] += own.get(up, [])
                up = a.link[up]

    def stream(self, words: list[int], at: int, places: list, runs: list) -> None:
        """Phrase places (number, start) and maximal runs (end, words, state) of a stretch of template words from word ``at`` on."""
        step, link, size, suffixes = self.automaton.step, self.automaton.link, self.automaton.size, self.suffixes
        state = length = 0
        for i, word in enumerate(words):
            if word not in step[state]:
                if length >= LEAST:
                    runs.append((at + i, length, state))
                while state and word not in step[state]:
                    state = link[state]
                    length = size[state]
            state = step[state].get(word, 0)
            length = length + 1 if state else 0
            for n, number in suffixes[state]:
                if n <= length:
                    places.append((number, at + i + 1 - n))
        if length >= LEAST:
            runs.append((at + len(words), length, state))

    def chains(self, runs: list) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share) of each chain of runs that covers enough of a template."""
        out, open_chains = [], {}

        def close(number: int) -> None:
            first, last, _, covered = open_chains.pop(number)
            share = covered / self.length[number]
            if share >= COVER:
                out.append((self.labels[number], first, last, min(1.0, share)))

        for end, n, state in runs:
            for number, stop in self.automaton.ends[state].items():
                if number < self.first_template:
                    continue
                chain = open_chains.get(number)
                if chain and end - n - chain[1] - 1 <= GAP and stop - n >= chain[2] - (LEAST - 1):
                    fresh = stop - max(stop - n, chain[2])
                    open_chains[number] = (chain[0], end - 1, stop, chain[3] + fresh)
                else:
                    if chain:
                        close(number)
                    open_chains[number] = (end - n, end - 1, stop, n)
        for number in list(open_chains):
            close(number)
        return sorted(out, key=lambda c: (c[1], c[0]))

    def scan(self, texts: list[str | None]) -> list[tuple[int, list, list]]:
        """(number of words, phrase places, chains) of each text."""
        hashes, bounds = words_of(texts)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[place] == hashes
        before = np.zeros(len(hit) + 1, bool)
        before[1:] = hit
        cut = np.zeros(len(hit) + 1, bool)
        cut[bounds] = True
        start = np.flatnonzero(hit & (~before[:-1] | cut[:-1]))
        after = np.zeros(len(hit) + 1, bool)
        after[:-1] = hit
        end = np.flatnonzero(hit & (~after[1:] | cut[1:])) + 1
        long = end - start >= 2
        start, end = start[long], end[long]
        owner = np.searchsorted(bounds, start, side="right") - 1
        found: dict[int, tuple[list, list]] = {}
        for a, b, text in zip(start.tolist(), end.tolist(), owner.tolist(), strict=True):
            places, runs = found.setdefault(text, ([], []))
            self.stream(place[a:b].tolist(), a - int(bounds[text]), places, runs)
        counts = np.diff(bounds).tolist()
        empty: tuple[list, list] = ([], [])
        return [(n, [(self.labels[k], at, at + self.length[k] - 1) for k, at in found.get(i, empty)[0]], self.chains(found.get(i, empty)[1])) for i, n in enumerate(counts)]


@functools.cache
def scanner() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``n_words``, ``places`` (each phrase place) and ``spans`` (each covered template span)."""
    out = df.drop("n_words", "places", "spans")
    fields = out.columns
    place = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    span = pa.struct([*place, ("covered", pa.float64())])

    def run(batches):
        s = scanner()
        for whole in batches:
            for b in chunks(whole, text):
                got = s.scan(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    *(b.column(c) for c in fields), pa.array([n for n, _, _ in got], pa.int64()),
                    pa.array([[dict(zip(("label", "first_word", "last_word"), x, strict=True)) for x in p] for _, p, _ in got], pa.list_(place)),
                    pa.array([[dict(zip(("label", "first_word", "last_word", "covered"), x, strict=True)) for x in c] for _, _, c in got], pa.list_(span))],
                    [*fields, "n_words", "places", "spans"])

    return out.mapInArrow(run, widened(out, n_words="long", places="array<struct<label:string,first_word:bigint,last_word:bigint>>", spans="array<struct<label:string,first_word:bigint,last_word:bigint,covered:double>>"))
