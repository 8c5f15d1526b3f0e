"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

An item of w words may be found with up to k = w * ERROR_PERCENT / 100 word
errors (inserted, lost or changed words). Cut into k + 1 pieces, at least one
piece then stands in the text unchanged. All windows of a text that equal a
piece are found by hash; around each, Myers' algorithm (1999), one bit an item
word, gives the least distance between the item and any part of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newswell.llm.shared import Step, clean_names, steps, windows

ERROR_PERCENT = 20
#: Items with fewer words have no whole word of errors and must be found exactly; items with fewer than the second value hold nothing to look for.
EXACT_BELOW, LEAST_WORDS = 5, 1
#: Benchmark text, at most, that one scan of the documents looks for; larger benchmarks are looked for in blocks.
BLOCK_BYTES = 16 << 20

#: Bytes that end a word: all ASCII but letters and digits.
GAP = np.ones(256, bool)
GAP[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
GAP[128:] = False


def words_of(step: Step) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and their number by document."""
    starts, ends, counts = step.spans(GAP)
    return (step.hashes(starts, ends, lower=True) if len(starts) else np.zeros(0, np.uint64)), counts


def budget(n: int) -> int:
    return 0 if n < EXACT_BELOW else n * ERROR_PERCENT // 100


def myers(pattern_bits: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where that part ends (first such end)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, word in enumerate(text, 1):
        eq = pattern_bits.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


def bits_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


@dataclass
class Item:
    """An item's words; the bit masks of Myers' algorithm are made when it is first looked at closely."""

    item_id: object
    words: np.ndarray

    @property
    def errors(self) -> int:
        return budget(len(self.words))

    @cached_property
    def forward(self) -> dict[int, int]:
        return bits_of(self.words.tolist())

    @cached_property
    def backward(self) -> dict[int, int]:
        return bits_of(self.words[::-1].tolist())


class Index:
    """Pieces of some items by length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, found = [], {}
        column = pa.array([t for _, t in items], pa.large_string())
        for row, step in steps(column):
            words, counts = words_of(step)
            at = np.concatenate([[0], np.cumsum(counts)])
            for k in range(step.docs):
                if counts[k] >= LEAST_WORDS:
                    own = words[at[k] : at[k + 1]]
                    item = Item(items[row + k][0], own.copy())
                    cuts = np.linspace(0, len(own), item.errors + 2).astype(int)
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        key = int(windows(own[a:b], np.array([b - a]), b - a)[0][0])
                        found.setdefault(b - a, []).append((key, len(self.items), int(a)))
                    self.items.append(item)
        self.pieces = {}
        for n, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            sieve = np.zeros(1 << 20, bool)
            sieve[keys & np.uint64((1 << 20) - 1)] = True
            self.pieces[n] = (keys, np.array([r[1:] for r in rows], np.int64).reshape(-1, 2), sieve)

    def hits(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of (item, word at which the item would start), sorted, each once."""
        out = [np.zeros((0, 2), np.int64)]
        for n, (keys, where, sieve) in self.pieces.items():
            grams, at = windows(words, counts, n)
            some = np.flatnonzero(sieve[grams & np.uint64(len(sieve) - 1)])
            grams, at = grams[some], at[some]
            low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
            many = high - low
            rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append(np.stack([where[rows, 0], np.repeat(at, many) - where[rows, 1]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item position, distance, first word, end word) of each place where an item is found."""
        hits = self.hits(words, counts)
        if not len(hits):
            return
        at = np.concatenate([[0], np.cumsum(counts)])
        anchor = np.array([len(self.items[i].words) for i in hits[:, 0]])
        # A piece lies within the item, so some word of the item's stretch lies in the document of the piece; starts before it belong to it too.
        doc_low = np.searchsorted(at, np.maximum(hits[:, 1], 0), "right") - 1
        doc_high = np.searchsorted(at, np.minimum(hits[:, 1] + anchor - 1, at[-1] - 1), "right") - 1
        todo = sorted({(int(i), d, int(s)) for (i, s), a, b in zip(hits, doc_low, doc_high) for d in range(int(a), int(b) + 1) if counts[d]})
        k = 0
        while k < len(todo):
            i, d, first = todo[k]
            item = self.items[i]
            last = first
            while k < len(todo) and todo[k][:2] == (i, d) and todo[k][2] <= last + item.errors + 1:
                last = todo[k][2]
                k += 1
            low = max(int(at[d]), first - item.errors)
            high = min(int(at[d + 1]), last + len(item.words) + item.errors)
            text = words[low:high].tolist()
            if len(text) < len(item.words) - item.errors:
                continue
            best, end = myers(item.forward, len(item.words), text)
            if best <= item.errors:
                _, length = myers(item.backward, len(item.words), text[:end][::-1])
                yield d, i, best, low + end - length - int(at[d]), low + end - int(at[d])


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size. Each block is one scan of the documents, of which the plan holds the items; a benchmark is small against a corpus."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in own.orderBy("item_id", "text").collect()]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance, start_word, end_word``: the best place of each item in each row of ``docs`` that holds it.

    Words are runs of ASCII letters and digits and of other than ASCII characters, lower-cased.
    Null texts on either side hold nothing; repeated rows, and items with equal texts, are each
    reported. Of several places the one with least distance, then the first, is given. Ids on either
    side may be of any type; texts are read to their ends. An empty table on either side gives an
    empty result.
    """
    source, out = clean_names(docs, "doc_id", "text"), None
    kind = source.schema["doc_id"].dataType.simpleString()
    item_kind, item_type = benchmark.schema["item_id"].dataType.simpleString(), to_arrow_type(benchmark.schema["item_id"].dataType)
    for items in _blocks(benchmark):
        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                rows, cells = [], []
                for row, step in steps(batch.column(1)):
                    words, counts = words_of(step)
                    best: dict[tuple[int, int], tuple] = {}
                    for d, i, *rest in index.matches(words, counts):
                        best[d, i] = min(best.get((d, i), tuple(rest)), tuple(rest))
                    for (d, i), rest in sorted(best.items()):
                        rows.append(row + d)
                        cells.append((index.items[i].item_id, *rest))
                if rows:
                    columns = list(zip(*cells))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(columns[0], item_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "item_id", "distance", "start_word", "end_word"])

        found = source.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, distance long, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns. Null texts hold nothing and stay, as do repeated rows; an empty benchmark rejects nothing."""
    for items in _blocks(benchmark):
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], items=items, at=at) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, step in steps(batch.column(at)):
                    for d, *_ in index.matches(*words_of(step)):
                        clean[row + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
