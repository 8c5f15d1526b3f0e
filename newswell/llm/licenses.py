"""Licence scans by matching statistics over a generalised suffix automaton.

All templates, phrases included, are put into one suffix automaton over their
words. Streaming a text through it gives, at each word, the longest match that
ends there and the templates' places where it stands. Matches that can't be
extended are chained, in the order of text and template alike, into covered spans;
a template counts as found when its chain covers enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.llm.decontam import words_of
from newswell.llm.shared import clean_names, steps

#: Phrases that are labels wherever their words stand together.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wordings of licence notices and of the permission texts themselves; a parameter of the scan.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Words of the shortest match that is chained, words between chained matches at most, and the share of a template to cover.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 2, 8, 0.8


class Automaton:
    """Generalised suffix automaton of sequences of word numbers."""

    def __init__(self, sequences: list[list[int]], phrases: int):
        """The first ``phrases`` sequences are phrases, which are reported wherever they stand."""
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.where: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.where[last].append((k, at + 1))
        # A state's places are also places of the shorter matches that it links to.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0:
                self.where[up] = sorted({*self.where[up], *self.where[state]})
        self.phrase_at: dict[int, list[tuple[int, int]]] = {}
        for k in range(phrases):
            state = 0
            for word in sequences[k]:
                state = self.next[state][word]
            self.phrase_at.setdefault(state, []).append((k, len(sequences[k])))
        # Phrases that end wherever a state's match ends: its own, if the match is long enough, and those it links to.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.ends[state] = self.phrase_at.get(state, []) + self.ends[self.link[state]]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.where.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of ``q`` that holds only the matches reached through ``p``."""
        copy = self._new(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        state = self._new(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return state

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.n_phrases = len(phrases)
        texts = [*phrases, *(text for _, text in templates)]
        sequences = []
        for _, step in steps(pa.array(texts, pa.large_string())):
            words, counts = words_of(step)
            sequences += np.split(words, np.cumsum(counts)[:-1])
        self.sizes = [len(s) for s in sequences]
        self.vocabulary = np.unique(np.concatenate(sequences))
        numbered = [np.searchsorted(self.vocabulary, s).tolist() for s in sequences]
        self.automaton = Automaton(numbered, self.n_phrases)
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[self.vocabulary & np.uint64(len(self.sieve) - 1)] = True
        n = len(self.vocabulary)
        self.pairs, self.alone = np.zeros((n + 1, n + 1), bool), np.zeros(n + 1, bool)
        for s in numbered:
            self.pairs[s[:-1], s[1:]] = True
            if len(s) == 1:
                self.alone[s] = True

    def number(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words that templates use, else one more than the largest."""
        out = np.full(len(words), len(self.vocabulary), np.int64)
        some = np.flatnonzero(self.sieve[words & np.uint64(len(self.sieve) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
        right = self.vocabulary[at] == words[some]
        out[some[right]] = at[right]
        return out

    def runs(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Stretches in which each two neighbours stand together in a template, and words that are a template or phrase alone.

        No match of two words or more leaves a stretch.
        """
        ids = self.number(words)
        if not len(ids):
            return
        joined = np.zeros(len(ids) + 1, bool)  # whether a word stands together with the one before it
        joined[1:-1] = self.pairs[ids[:-1], ids[1:]]
        joined[np.cumsum(counts)[:-1]] = False  # pairs of two documents
        inside = joined[:-1] | joined[1:] | self.alone[ids]
        first, last = np.flatnonzero(inside & ~joined[:-1]), np.flatnonzero(inside & ~joined[1:])
        for a, b in zip(first, last):
            yield int(a), ids[a : b + 1].tolist()

    def scan(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, list, list]]:
        """For each document with any: its phrases as (phrase, first word), its spans as (template, first, end, share covered)."""
        ends = np.cumsum(counts)
        found: dict[int, tuple[list, list]] = {}
        auto = self.automaton
        for start, ids in self.runs(words, counts):
            doc = int(np.searchsorted(ends, start, "right"))
            base, matches = found.setdefault(doc, ([], []))
            first = start - int(ends[doc] - counts[doc])
            before = (0, 0)
            for at, (state, length) in enumerate(auto.stream(ids), first):
                base += [(k, at + 1 - n) for k, n in auto.ends[state] if n <= length]
                if length <= before[1] and before[1]:
                    matches.append((at, *before))
                before = (state, length)
            if before[1]:
                matches.append((first + len(ids), *before))
        for doc, (base, matches) in found.items():
            spans = self.chain(matches)
            if base or spans:
                yield doc, base, spans

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains of matches (end, state, length) that cover enough of a template: the best first, then those that overlap none before."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, length in matches:
            for k, at in self.automaton.where[state]:
                if k >= self.n_phrases and length >= min(LEAST_MATCH, self.sizes[k]):
                    by.setdefault(k, []).append((end, at, min(length, at)))
        out = []
        for k, rows in by.items():
            if sum(r[2] for r in rows) < LEAST_COVER * self.sizes[k]:
                continue
            rows.sort()
            best: list[tuple[int, int]] = []  # words covered, first word of the text
            for i, (end, at, n) in enumerate(rows):
                own = (n, end - n)
                for j in range(i - 1, -1, -1):
                    e, a, m = rows[j]
                    if end - n - e > MOST_GAP + self.sizes[k]:
                        break
                    over = max(0, e - (end - n), a - (at - n))
                    if e < end and a < at and over < n and end - n - e <= MOST_GAP:
                        own = max(own, (best[j][0] + n - over, best[j][1]), key=lambda x: x[0])
                best.append(own)
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(rows)), key=lambda i: (-best[i][0], rows[i][0])):
                (covered, first), end = best[i], rows[i][0]
                if covered < LEAST_COVER * self.sizes[k]:
                    break
                if all(end <= a or first >= z for a, z in taken):
                    out.append((k, first, end, min(1.0, covered / self.sizes[k])))
                    taken.append((first, end))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


SPANS = "array<struct<label:string,first_word:long,end_word:long,cover:double>>"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``doc_id, n_words, phrases, spans`` of each row of ``docs``.

    ``phrases`` lists (label, first_word) of each place of a phrase; ``spans`` lists the covered
    template spans with the share of the template that they cover; spans of one template do not
    overlap, those of different ones may. Null and empty texts have no words; a text is scanned to
    its end, however long; repeated rows each give a row; ids may be of any type; an empty table
    stays empty.
    """
    source = clean_names(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    phrase_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for row, step in steps(batch.column(1)):
                words, counts = words_of(step)
                base, spans = [[] for _ in range(step.docs)], [[] for _ in range(step.docs)]
                for doc, b, s in scanner.scan(words, counts):
                    base[doc] = [{"label": scanner.labels[k], "first_word": at} for k, at in b]
                    spans[doc] = [{"label": scanner.labels[k], "first_word": a, "end_word": z, "cover": c} for k, a, z, c in s]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, step.docs), pa.array(counts.astype(np.int64)), pa.array(base, phrase_type), pa.array(spans, span_type)], names=["doc_id", "n_words", "phrases", "spans"])

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, phrases array<struct<label:string,first_word:long>>, spans {SPANS}")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_sort(F.array_distinct("phrases.label"))
    both = F.array_sort(F.array_distinct(F.concat("phrases.label", "spans.label")))
    score = F.greatest(F.when(F.size("phrases") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("spans.cover"), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"), F.array_min("phrases.first_word").alias("first_word"), F.array_max("phrases.first_word").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))
