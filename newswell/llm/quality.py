"""Quality rules as a short-circuit cascade.

Every rule may reject a document. A bounded sample gives each rule's cost and
the share that it rejects; rules then run in the order of rejections per cost,
and a document that one rule rejects is not shown to the rules after it. A
verdict is the conjunction of all rules, so the order never changes it. Costs are
measured, so the order, and with it the rule that is named as the first to reject,
may differ between runs; ``kept`` does not.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.llm.shared import SPACE, Step, clean_names, mix, steps, windows

#: Documents, at most, on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
MAX_UPPER_PERCENT = 60
MAX_SHOUT_PERCENT = 20
MAX_TOP_WORD_PERCENT = 30
MAX_MEAN_WORD = 20

_SYMBOL, _UPPER, _ALPHA, _SHOUT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_SHOUT[list(b"!?")] = True


class Features:
    """Measures of the documents of one step, each computed when first asked for."""

    def __init__(self, step: Step):
        self.step, self._kept = step, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._kept:
            self._kept[name] = getattr(self, f"_{name}")()
        return self._kept[name]

    def pick(self, rows: np.ndarray) -> Features:
        """The same for some of the documents only; what is known already is kept."""
        at = self.step.offsets
        edges = np.flatnonzero(np.diff(rows) > 1) + 1  # runs of documents that stand together are copied as one
        first, last = np.append(rows[:1], rows[edges]), np.append(rows[edges - 1], rows[-1:])
        data = [self.step.data[at[a] : at[b + 1]] for a, b in zip(first, last)]
        new = Features(Step(np.concatenate(data) if data else self.step.data[:0], np.concatenate([[0], np.cumsum(np.diff(at)[rows])])))
        new._kept = {k: v[rows] if isinstance(v, np.ndarray) else v.pick(rows) for k, v in self._kept.items()}
        return new

    def _words(self):
        return Words(self.step)

    def _n_words(self):
        return self["words"].counts

    def _word_chars(self):
        return self.step.per_doc(~SPACE[self.step.data] & ((self.step.data & 0xC0) != 0x80))

    def _n_symbols(self):
        return self.step.per_doc(_SYMBOL[self.step.data])

    def _n_upper(self):
        return self.step.per_doc(_UPPER[self.step.data])

    def _n_alpha(self):
        return self.step.per_doc(_ALPHA[self.step.data])

    def _n_shout(self):
        return self.step.per_doc(_SHOUT[self.step.data])

    def _lines(self):
        return Lines(self.step)

    def _n_lines(self):
        return self["lines"].counts

    def _n_dup_lines(self):
        return self["lines"].repeated

    def _n_repeat_words(self):
        w = self["words"]
        grams, at = windows(w.hashes, w.counts, 3)
        twice = _found_twice(grams, w.doc[at], first=True)
        covered = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 3, -1)
        return np.bincount(w.doc[np.cumsum(covered[:-1]) > 0], minlength=self.step.docs)

    def _top_word(self):
        """Occurrences of the most frequent word."""
        w = self["words"]
        keys = np.sort(w.hashes ^ mix(w.doc.astype(np.uint64) + np.uint64(1)))
        if not len(keys):
            return np.zeros(self.step.docs, np.int64)
        order = np.argsort(w.hashes ^ mix(w.doc.astype(np.uint64) + np.uint64(1)))
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        runs, doc = np.diff(np.append(cut, len(keys))), w.doc[order[cut]]
        top = np.zeros(self.step.docs, np.int64)
        np.maximum.at(top, doc, runs)
        return top


class Words:
    def __init__(self, step: Step):
        starts, ends, self.counts = step.spans(SPACE)
        self.hashes = step.hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(step.docs), self.counts)

    def pick(self, rows: np.ndarray) -> Words:
        new = object.__new__(Words)
        keep = np.zeros(len(self.counts), bool)
        keep[rows] = True
        new.counts, new.hashes = self.counts[rows], self.hashes[keep[self.doc]]
        new.doc = np.repeat(np.arange(len(rows)), new.counts)
        return new


class Lines:
    """Lines that hold a word, by document; ``repeated`` counts those equal to an earlier one."""

    def __init__(self, step: Step):
        newline = np.zeros(256, bool)
        newline[10] = True
        starts, ends, counts = step.spans(newline)
        doc = np.repeat(np.arange(step.docs), counts)
        solid = np.concatenate([[0], np.cumsum(~SPACE[step.data])])
        worded = solid[ends] > solid[starts]
        starts, ends, doc = starts[worded], ends[worded], doc[worded]
        self.counts = np.bincount(doc, minlength=step.docs)
        hashes = step.hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.repeated = np.bincount(doc[_found_twice(hashes, doc, first=False)], minlength=step.docs)

    def pick(self, rows: np.ndarray) -> Lines:
        new = object.__new__(Lines)
        new.counts, new.repeated = self.counts[rows], self.repeated[rows]
        return new


def _found_twice(hashes: np.ndarray, doc: np.ndarray, first: bool) -> np.ndarray:
    """Marks values that occur again in their document: all of them, or all but one of each."""
    keys = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


@dataclass(frozen=True)
class Rule:
    """``rejects(features)`` marks the documents to reject."""

    name: str
    rejects: Callable[[Features], np.ndarray]


BASE_RULES = (
    Rule("few_words", lambda f: f["n_words"] < MIN_WORDS),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]),
)
#: Rules beyond the base ones. Each needs strong evidence, so that clean texts pass.
MORE_RULES = (
    Rule("symbols", lambda f: 100 * f["n_symbols"] > MAX_SYMBOL_PERCENT * f["word_chars"]),
    Rule("repeated_lines", lambda f: 100 * f["n_dup_lines"] > MAX_DUP_LINE_PERCENT * f["n_lines"]),
    Rule("capitals", lambda f: 100 * f["n_upper"] > MAX_UPPER_PERCENT * f["n_alpha"]),
    Rule("shouting", lambda f: 100 * f["n_shout"] > MAX_SHOUT_PERCENT * f["n_words"]),
    Rule("long_words", lambda f: f["word_chars"] > MAX_MEAN_WORD * f["n_words"]),
    Rule("one_word", lambda f: 100 * f["top_word"] > MAX_TOP_WORD_PERCENT * f["n_words"]),
)
RULES = BASE_RULES + MORE_RULES


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Each rule's nanoseconds and rejections on at most about ``sample_rows`` documents, measured in the executors."""
    text = clean_names(docs, "text")
    total = text.count()
    if not total:
        return [{"rule": r.name, "ns": 0, "seen": 0, "rejected": 0} for r in rules]
    sample = text if total <= sample_rows else text.sample(sample_rows / total, seed=17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, step in steps(batch.column(0)):
                rows = []
                for r in rules:
                    began = time.perf_counter_ns()
                    bad = r.rejects(Features(step))
                    rows.append({"rule": r.name, "ns": time.perf_counter_ns() - began, "seen": step.docs, "rejected": int(bad.sum())})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("rule", pa.string()), ("ns", pa.int64()), ("seen", pa.int64()), ("rejected", pa.int64())]))

    found = sample.mapInArrow(run, "rule string, ns long, seen long, rejected long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("ns", "seen", "rejected")))
    by_name = {r["rule"]: r.asDict() for r in found.collect()}  # one row per rule
    return [by_name.get(r.name, {"rule": r.name, "ns": 0, "seen": 0, "rejected": 0}) for r in rules]


def ordered(rules: tuple[Rule, ...], figures: list[dict]) -> tuple[Rule, ...]:
    """Most rejections per cost first; ties keep the given order."""
    worth = {x["rule"]: (x["rejected"] + 0.5) / (x["seen"] + 1) / max(1.0, x["ns"] / max(1, x["seen"])) for x in figures}
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def cascade(features: Features, rules: tuple[Rule, ...]) -> np.ndarray:
    """Position of the rule that rejects each document, -1 where none does. A rule is only shown what those before it left."""
    out = np.full(features.step.docs, -1, np.int32)
    left = np.arange(features.step.docs)
    for k, r in enumerate(rules):
        if not len(left):
            break
        bad = r.rejects(features)
        if bad.any():
            out[left[bad]] = k
            keep = np.flatnonzero(~bad)
            left, features = left[keep], features.pick(keep)
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: bool = False, sample_rows: int = SAMPLE_ROWS, keep_columns: bool = True) -> DataFrame:
    """Adds ``kept`` and ``rejected_by`` (the first rule of the cascade that rejects; null if none does).

    ``measures`` adds the base measures of every document too. ``docs`` needs
    ``text``; the other columns stay (``keep_columns``), except that those
    named like an added one are replaced. A null text counts as an empty one,
    which has too few words. A text of any length is measured whole. Repeated rows
    each get their own verdict. An empty table stays empty.
    """
    order = ordered(rules, estimate(docs, rules, sample_rows))
    names = [r.name for r in order]
    added = [("kept", "boolean"), ("rejected_by", "string"), *((m, "long") for m in MEASURES if measures)]
    rest = [c for c in docs.columns if c not in dict(added)] if keep_columns else ["doc_id"]
    source = docs.select(*(F.col(f"`{c}`") for c in rest), *([F.col("text").alias("__text")] if "text" not in rest else []))
    at = source.columns.index("text" if "text" in rest else "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, more = [np.zeros(0, np.int32)], {m: [np.zeros(0, np.int64)] for m in MEASURES}
            for _, step in steps(batch.column(at)):
                f = Features(step)
                if measures:
                    for m in MEASURES:
                        more[m].append(f[m])
                by.append(cascade(f, order))
            by = np.concatenate(by)
            new = [pa.array(by < 0), pa.array([names[k] if k >= 0 else None for k in by], pa.string())]
            new += [pa.array(np.concatenate(more[m]).astype(np.int64)) for m in MEASURES if measures]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], names=[*rest, *(c for c, _ in added)])

    kinds = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {t}" for c, t in added)])
    return source.mapInArrow(run, kinds)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = clean_names(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = quality_rules(docs, measures=True, keep_columns=False)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.select("doc_id", *MEASURES, failed.alias("base_failed"), "kept")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM n),
g AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
tops AS (SELECT doc_id, max(n) AS top, sum(n)::BIGINT AS n_words, sum(n * length(word))::BIGINT AS word_chars FROM (SELECT doc_id, word, count(*) AS n FROM u GROUP BY ALL) GROUP BY ALL),
f AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(top, 0) AS top, coalesce(cover.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_alpha, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_shout
  FROM n LEFT JOIN cover USING (doc_id) LEFT JOIN tops USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 60 * n_alpha OR 100 * n_shout > 20 * n_words OR word_chars > 20 * n_words OR 100 * top > 30 * n_words) AS kept
FROM f
"""
