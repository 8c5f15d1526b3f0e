"""Terms of many lists found in one pass over each text.

All terms of all lists make one Aho-Corasick automaton, so the time for a text depends on its
length and on what is found in it, not on how many terms are looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newswell.session import ship

#: What is told of each list: entries that occur, occurrences of all entries, entries that occur as words, and the weights of entries that occur.
FIELDS = ("hits", "total", "words", "weight")
_KIND = pa.struct([("hits", pa.int32()), ("total", pa.int32()), ("words", pa.int32()), ("weight", pa.float64())])
#: Texts of a batch that are Python strings at once.
TEXTS = 256
_HANGUL = re.compile("[가-힣]")


class TermIndex:
    """The lists as an automaton, made where it is first needed."""

    def __init__(self, lists: Mapping[str, Iterable[str]], totals: Iterable[str] = (), words: Iterable[str] = (), weights: Mapping[str, Mapping[str, float]] | None = None):
        self.names = list(lists)
        self.lists = {k: tuple(v) for k, v in lists.items()}
        self.totals, self.words, self.weights = set(totals), set(words), dict(weights or {})
        self.made = None

    def __getstate__(self):
        return {**self.__dict__, "made": None}

    def _make(self):
        import ahocorasick

        auto, terms, where = ahocorasick.Automaton(), [], {}
        for k, name in enumerate(self.names):
            for term in self.lists[name]:
                if term not in where:
                    where[term] = len(terms)
                    terms.append((term, {}))
                own = terms[where[term]][1]
                n, weight = own.get(k, (0, 0.0))
                own[k] = n + 1, float(self.weights.get(name, {}).get(term, 0.0))
        for i, (term, _) in enumerate(terms):
            if term:
                auto.add_word(term, i)
        if len(auto):
            auto.make_automaton()
        # Each term with its lists: number of the list, times it is listed, weight, whether its occurrences count, whether words count.
        rows = [(t, [(k, n, w, self.names[k] in self.totals, self.names[k] in self.words) for k, (n, w) in own.items()]) for t, own in terms]
        patterns = {}
        self.made = auto, rows, patterns
        return self.made

    def _as_word(self, term: str, text: str, patterns: dict) -> bool:
        """Whether a term occurs between word boundaries; one in Hangul, where endings adjoin, may stand anywhere."""
        found = patterns.get(term)
        if found is None:
            found = patterns[term] = re.compile(r"\b" + re.escape(term) + r"\b") if not _HANGUL.search(term) else re.compile(re.escape(term))
        return found.search(text) is not None

    def count(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Hits, occurrences, words and weights: a row a text, a column a list."""
        auto, rows, patterns = self.made or self._make()
        texts = list(texts)
        out = [np.zeros((len(texts), len(self.names)), np.int32) for _ in range(3)] + [np.zeros((len(texts), len(self.names)))]
        hits, total, words, weight = out
        if not len(auto):
            return out
        for r, text in enumerate(texts):
            if not text:
                continue
            for i in {i for _, i in auto.iter(text)}:
                term, lists = rows[i]
                n = word = None
                for k, listed, w, counts, whole in lists:
                    hits[r, k] += listed
                    weight[r, k] += w
                    if counts:
                        n = text.count(term) if n is None else n
                        total[r, k] += listed * n
                    if whole:
                        word = self._as_word(term, text, patterns) if word is None else word
                        words[r, k] += listed * word
        return out

    def struct(self, texts: pa.Array) -> pa.Array:
        parts = [self.count(texts.slice(k, TEXTS).to_pylist()) for k in range(0, max(1, len(texts)), TEXTS)]
        hits, total, words, weight = (np.concatenate(x) for x in zip(*parts))
        cells = [pa.StructArray.from_arrays([pa.array(x[:, k]) for x in (hits, total, words, weight)], fields=list(_KIND)) for k in range(len(self.names))]
        return pa.StructArray.from_arrays(cells, names=self.names)

    def schema(self) -> str:
        one = "struct<hits:int,total:int,words:int,weight:double>"
        return "struct<" + ",".join(f"`{n}`:{one}" for n in self.names) + ">"

    def __call__(self, text: Column) -> Column:
        """``struct(list: struct(hits, total, words, weight), ...)`` of a text. A null or empty text has none of any list.

        A list that names an entry twice counts it twice. ``total`` is counted for the lists named in ``totals``
        (each entry without overlaps of its own; entries may share characters), ``words`` for those in ``words``.
        Terms are looked for as they are: texts are lower-cased by the caller.
        """
        ship()
        if not hasattr(self, "udf"):
            self.udf = _udf_of(self)
        return self.udf(text)


def _udf_of(index: TermIndex):
    plain = TermIndex(index.lists, index.totals, index.words, index.weights)

    def found(texts: pa.Array) -> pa.Array:
        return plain.struct(texts)

    return F.arrow_udf(found, index.schema())


def term_hits(text: Column, lists: Mapping[str, Iterable[str]], **more) -> Column:
    """:class:`TermIndex` of some lists applied to a text."""
    return TermIndex(lists, **more)(text)
