"""License scans with a generalised suffix automaton.

All license templates go into one suffix automaton over words. A text is streamed through it once, which gives for
every word the longest run of words ending there that occurs in some template (matching statistics). Runs that cannot
be made longer are chained, in order and with small gaps, into spans of a template, and a template whose chained span
covers enough of its words gives its label. A base phrase is a template too: the automaton knows at every state which
whole phrases end there.

Defined results: a NULL or empty text has no words, no labels and score 0; every row is judged alone, so ties, repeated
rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base phrases and their labels.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Public license notices, as words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

MIN_MATCH = 3
MAX_GAP = 6
MIN_COVERED = 0.75

# Words are runs of digits, a-z and everything beyond ASCII; all other bytes separate them.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_AS_WORDS).split()


@dataclass
class Automaton:
    """Generalised suffix automaton: transitions, suffix links, longest lengths, and where each state ends in templates."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    ends: list[set] = field(default_factory=lambda: [set()])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for exactly ``state`` followed by ``word``, cut off from a longer one if need be."""
        target = self.step[state][word]
        if self.longest[target] == self.longest[state] + 1:
            return target
        clone = self._state(self.longest[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = clone
            state = self.link[state]
        return clone

    def extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new, state = self._state(self.longest[last] + 1, {}, 0), last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        self.link[new] = self._split(state, word) if state >= 0 else 0
        return new

    def add(self, number: int, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self.extend(last, word)
        state = 0
        for at, word in enumerate(words):
            state = self.step[state][word]
            self.ends[state].add((number, at + 1))

    def close(self) -> None:
        """Hand the template places of every state up its suffix links."""
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.longest[s]):
            self.ends[self.link[state]] |= self.ends[state]


class Matcher:
    """The automaton of base phrases and templates with what is needed at each state."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        split = lambda rows: [(label, text.encode().split()) for label, text in rows]
        self.phrases = split([(label, phrase) for phrase, label in phrases])
        self.templates = split(templates)
        every = self.phrases + self.templates
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in every for w in words))}
        self.lengths = [len(words) for _, words in every]
        self.automaton = a = Automaton()
        for number, (_, words) in enumerate(every):
            a.add(number, [self.vocabulary[w] for w in words])
        a.close()
        # Whole phrases among the suffixes of a state: (length, phrase).
        self.whole: list[list[tuple[int, int]]] = [[] for _ in a.step]
        for state in sorted(range(1, len(a.link)), key=lambda s: a.longest[s]):
            least = a.longest[a.link[state]]
            own = [(at, n) for n, at in a.ends[state] if n < len(self.phrases) and at == self.lengths[n] and least < at <= a.longest[state]]
            self.whole[state] = self.whole[a.link[state]] + own

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """State and match length after every word."""
        step, link, longest = self.automaton.step, self.automaton.link, self.automaton.longest
        state = length = 0
        for word in ids:
            while state and word not in step[state]:
                state = link[state]
                length = longest[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            yield state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Places of base phrases (start, phrase), and spans (start, end, template, covered share)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        # A match cannot cross an unknown word, so only runs of two and more known words are streamed.
        breaks = np.flatnonzero(np.diff(known) > 1)
        starts, stops = np.r_[0, breaks + 1], np.r_[breaks, len(known) - 1]
        places, matches = [], []
        for a, b in zip(known[starts[stops > starts]], known[stops[stops > starts]], strict=True) if len(known) else ():
            rows = list(self.statistics(ids[a : b + 1].tolist()))
            for i, (state, length) in enumerate(rows):
                for size, phrase in self.whole[state]:
                    if size <= length:
                        places.append((int(a) + i + 1 - size, phrase))
                if length >= MIN_MATCH and (i + 1 == len(rows) or rows[i + 1][1] <= length):
                    matches.append((int(a) + i + 1, length, state))
        return places, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Best chains of matches (end, length, state) by template; only near predecessors are asked."""
        base = len(self.phrases)
        links: dict[int, list[list[int]]] = {}
        for end, length, state in matches:
            for number, at in sorted(self.automaton.ends[state]):
                if number >= base:
                    links.setdefault(number, []).append([end - length, end, at - length, at])
        spans = []
        for number, pieces in links.items():
            reach = MAX_GAP + self.lengths[number]
            best: list[tuple[int, int]] = []  # words covered, start of the chain
            for i, (start, end, low, high) in enumerate(pieces):
                top = (end - start, start)
                for j in range(i - 1, -1, -1):
                    s, e, lo, hi = pieces[j]
                    if e < start - reach:
                        break
                    shared = max(0, e - start, hi - low)
                    if s < start and lo < low and e < end and hi < high and start - e <= MAX_GAP and low - hi <= MAX_GAP and shared < end - start:
                        top = max(top, (best[j][0] + end - start - shared, best[j][1]))
                best.append(top)
                covered = min(1.0, top[0] / self.lengths[number])
                spans.append((top[1], end, number - base, covered))
        return spans


@cache
def matcher() -> Matcher:
    return Matcher(BASE_PHRASES, TEMPLATES)


_FOUND = pa.struct([("start", pa.int64()), ("label", pa.string())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())])


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, places, spans`` of every text: base phrases and template spans with their covered share."""

    def run(batches):
        m = matcher()
        for batch in batches:
            counts, places, spans = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                words = words_of(value.as_py() or b"")
                found, covered = m.scan(words)
                counts.append(len(words))
                places.append([{"start": s, "label": m.phrases[p][0]} for s, p in found])
                spans.append([{"start": s, "end": e, "label": m.templates[n][0], "covered": c} for s, e, n, c in covered])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_FOUND)), pa.array(spans, pa.list_(_SPAN))],
                ["key", "n_words", "places", "spans"],
            )

    kind = dict(docs.dtypes)[key]
    schema = (
        f"key {kind}, n_words bigint, places array<struct<start: bigint, label: string>>, "
        "spans array<struct<start: bigint, end: bigint, label: string, covered: double>>"
    )
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def license_digest(docs: DataFrame, min_covered: float = MIN_COVERED) -> DataFrame:
    """One row per document: counts and extremes of the base phrases, labels of both kinds, best share covered."""
    found = scan_licenses(docs)
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    enough = F.transform(F.filter("spans", lambda s: s["covered"] >= min_covered), lambda s: s["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, enough)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.covered"), F.lit(0.0))).alias("score"),
        F.size(F.filter("spans", lambda s: s["covered"] >= min_covered)).cast("bigint").alias("n_spans"),
    )
