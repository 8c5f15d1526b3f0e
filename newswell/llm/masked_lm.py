"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Each word of a text is predicted from the two words before and the two after it, as
if it were masked. A document's score is the sum of the logarithms of these
conditional probabilities.

What is gathered grows with the corpus: a stored table counts every different word,
and the number of *leaves*, the units that the network knows, grows with the square
root of the words read. The most frequent words are leaves of their own; the others
share leaves, dealt by hash. The leaves stand in a Huffman tree of their frequencies,
and the network (position-weighted embeddings, tanh, a vector at each inner node)
decides left or right at each node on a word's path, so that

    log P(word | window) = log P(leaf | window) + log P(word | leaf)

is normalised over all words without a sum over the vocabulary. ``P(word | leaf)``
comes from the counts of whole words, which are joined to the words of each document;
there a document's own occurrences are left out, so that a word which the rest of the
corpus does not have is a rare one, however often its document repeats it.

In training each partition takes steps of its own from common weights, on every
second word in the first round and on the others in the second; after each round the
weights are averaged, weighted by words. Averages are sums of whole numbers, so they
don't depend on the order of tasks, though they do on the partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.llm.decontam import words_of
from newswell.llm.shared import Step, clean_names, steps, stored

#: Leaves of one word for each square root of the corpus' words, and bounds of their number; leaves that rare words share, for each of them.
OWN_PER_ROOT, LEAST_OWN, MOST_OWN, SHARED_PART = 2.0, 64, 1 << 16, 8
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
ROUNDS = 2
BATCH = 8192
#: Levels of the tree whose few nodes are summed by products of matrices; bound of a node's log-odds, so that products of probabilities don't vanish.
TOP_LEVELS, MOST_ODDS = 6, 27.0
RATE = 0.05
#: Weights are averaged as whole numbers of this unit, so many of them in a row.
UNIT, CHUNK = 1 << 20, 1 << 12
#: Different words that a task counts before it hands them on.
COUNTED = 1 << 20


@dataclass
class Tree:
    """Huffman tree of leaves. The path of leaf k is ``nodes[first[k]:first[k] + size[k]]``, with 1 in ``right`` where it turns right."""

    first: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    right: np.ndarray
    odds: np.ndarray  # log-odds of turning right at each node by frequency alone
    at_depth: list[np.ndarray]  # nodes of each of the top levels
    place: np.ndarray  # each node's place among those of its level
    short: np.ndarray  # less for a longer path

    @classmethod
    def of(cls, counts: np.ndarray) -> Tree:
        n = len(counts)
        heap = [(int(c) + 1, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        weight = np.zeros(2 * n - 1)
        weight[:n] = counts + 1
        for node in range(n, 2 * n - 1):
            (a, left), (b, right_) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left], parent[right_], side[right_], weight[node] = node, node, 1, a + b
            heapq.heappush(heap, (a + b, node))
        # Paths from the root down: a node's path is its parent's, its parent and its side.
        depth = np.zeros(2 * n - 1, np.int64)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        size = depth[:n]
        first = np.cumsum(size) - size
        nodes, right = np.zeros(size.sum(), np.int64), np.zeros(size.sum(), np.float32)
        at, here = first + size - 1, np.arange(n)
        live = np.flatnonzero(size)
        while len(live):  # all leaves climb one step at a time
            nodes[at[live]], right[at[live]] = parent[here[live]] - n, side[here[live]]
            here[live], at[live] = parent[here[live]], at[live] - 1
            live = live[here[live] != 2 * n - 2]
        turned = side.astype(bool)
        to_right, to_left = np.zeros(n - 1), np.zeros(n - 1)
        inner = parent[:-1] - n
        np.add.at(to_right, inner[turned[:-1]], weight[:-1][turned[:-1]])
        np.add.at(to_left, inner[~turned[:-1]], weight[:-1][~turned[:-1]])
        deep, place = depth[n:], np.zeros(n - 1, np.int64)
        at_depth = [np.flatnonzero(deep == d) for d in range(min(TOP_LEVELS, int(deep.max()) + 1))]
        for some in at_depth:
            place[some] = np.arange(len(some))
        return cls(first, size, nodes, right, (np.log(to_right) - np.log(to_left)).astype(np.float32), at_depth, place, (size.max() - size).astype(np.uint16))

    def levels(self, leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """An order of the leaves, longest paths first, and for each depth the nodes and sides of those in it that are so deep: a head of the order."""
        order = np.argsort(self.short.take(leaves), kind="stable")  # of two bytes: a radix sort
        leaves = leaves.take(order)
        first, size = self.first.take(leaves), self.size.take(leaves)
        heads = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else []
        out = []
        for n in heads:
            out.append((self.nodes.take(first[:n]), self.right.take(first[:n])))
            first[:n] += 1
        return order, out


class Model:
    """Leaves, tree and network. ``weights`` is one flat vector; ``words`` the stored counts of all words (``word, n``)."""

    def __init__(self, own: np.ndarray, counts: np.ndarray, kinds: np.ndarray, words: DataFrame | None = None):
        """``own`` lists the words with a leaf of their own; ``counts`` has the occurrences of these and of the shared leaves, ``kinds`` the different words of each shared leaf."""
        order = np.argsort(own)
        self.own, self.own_leaf, self.n_own = own[order], order, len(own)
        self.counts, self.shared, self.kinds, self.words = counts, len(counts) - len(own), kinds, words
        self.tree = Tree.of(counts)
        n, rng = len(counts), np.random.default_rng(0)
        # Embeddings of the leaves and of "no word", position weights, bias, vectors and biases of the inner nodes.
        self.shapes = ((n + 1, HIDDEN), (len(OFFSETS), HIDDEN), (HIDDEN,), (n - 1, HIDDEN), (n - 1,))
        parts = [rng.normal(0, 0.3, self.shapes[0]), np.ones(self.shapes[1]), np.zeros(HIDDEN), np.zeros(self.shapes[3]), self.tree.odds]
        self.weights = np.concatenate([p.ravel() for p in parts]).astype(np.float32)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": None}  # tasks don't need the table

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([0, *(int(np.prod(s)) for s in self.shapes)])
        return [flat[a:b].reshape(s) for a, b, s in zip(cuts[:-1], cuts[1:], self.shapes)]

    def leaves(self, words: np.ndarray) -> np.ndarray:
        """Leaf of each word: its own, or one of the shared ones by its hash."""
        at = np.minimum(np.searchsorted(self.own, words), max(0, self.n_own - 1))
        shared = self.n_own + ((words >> np.uint64(20)) % np.uint64(self.shared)).astype(np.int64)
        return np.where(self.own[at] == words, self.own_leaf[at], shared) if self.n_own else shared

    def windows(self, leaves: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Leaves around each word; one more than the last leaf where the document has none."""
        doc = np.repeat(np.arange(len(counts)), counts)
        out = np.full((len(OFFSETS), len(leaves)), len(self.counts), np.int64)
        for k, o in enumerate(OFFSETS):
            here, there = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
            if abs(o) < len(leaves):
                out[k, here] = np.where(doc[here] == doc[there], leaves[there], len(self.counts))
        return out

    @staticmethod
    def hidden(parts: list[np.ndarray], window: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hidden units, and the embeddings of the windows' words that they come from."""
        embed, place, bias = parts[:3]
        taken = [embed.take(leaves, axis=0) for leaves in window]
        out = taken[0] * place[0]
        out += bias
        for k in range(1, len(OFFSETS)):
            out += taken[k] * place[k]
        return np.tanh(out, out=out), taken

    def forward(self, parts: list[np.ndarray], window: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each target."""
        order, levels = self.tree.levels(target)
        (h, _), p = self.hidden(parts, window[:, order]), np.ones(len(target))
        for nodes, right in levels:
            x = np.einsum("ij,ij->i", parts[3].take(nodes, axis=0), h[: len(nodes)])
            x += parts[4].take(nodes)
            x *= 1 - 2 * right
            p[: len(nodes)] /= 1 + np.exp(np.minimum(x, MOST_ODDS, out=x))
        out = np.empty(len(target))
        out[order] = np.log(p)
        return out

    def log_probabilities(self, leaves: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log P(leaf | window) of each word."""
        window, parts, out = self.windows(leaves, counts), self.views(self.weights), np.empty(len(leaves))
        for a in range(0, len(leaves), BATCH):
            out[a : a + BATCH] = self.forward(parts, window[:, a : a + BATCH], leaves[a : a + BATCH])
        return out

    def gradient(self, weights: np.ndarray, window: np.ndarray, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and their gradients of the mean loss for each part of the weights."""
        parts, n = self.views(weights), len(target)
        order, levels = self.tree.levels(target)
        window = window[:, order]
        h, taken = self.hidden(parts, window)
        back, rows, sums = np.zeros_like(h), [], []
        # Of the other levels, vectors and biases of the nodes are summed together, with a column to be even.
        deep = np.empty((sum(len(nodes) for nodes, _ in levels[TOP_LEVELS:]), HIDDEN + 2), h.dtype)
        filled = 0
        for depth, (nodes, right) in enumerate(levels):
            vectors, own = parts[3].take(nodes, axis=0), h[: len(nodes)]
            x = np.einsum("ij,ij->i", vectors, own)
            x += parts[4].take(nodes)
            error = (1 / (1 + np.exp(-x)) - right) / h.dtype.type(n)
            vectors *= error[:, None]
            back[: len(nodes)] += vectors
            if depth < TOP_LEVELS:  # few nodes that all targets pass: a product of matrices
                some = self.tree.at_depth[depth]
                place = self.tree.place[nodes]
                spread = np.zeros((len(some), len(nodes)), h.dtype)
                spread[place, np.arange(len(nodes))] = error
                rows.append(some)
                sums.append(np.column_stack([spread @ own, spread.sum(axis=1)]))
            else:
                joint = deep[filled : filled + len(nodes)]
                np.multiply(error[:, None], own, out=joint[:, :HIDDEN])
                joint[:, HIDDEN:] = error[:, None]
                filled += len(nodes)
        if filled:
            some, joint = _by_row(np.concatenate([nodes for nodes, _ in levels[TOP_LEVELS:]]), deep, len(parts[4]))
            rows.append(some)
            sums.append(joint[:, : HIDDEN + 1])
        v_rows, joint = np.concatenate(rows), np.concatenate(sums)
        back *= 1 - h * h
        around = np.empty((len(OFFSETS), *back.shape), h.dtype)
        np.multiply(back[None], parts[1][:, None], out=around)
        e_rows, e = _by_row(window.ravel(), around.reshape(-1, HIDDEN), len(parts[0]))
        place = np.stack([np.einsum("ij,ij->j", back, x) for x in taken])
        return [(e_rows, e), (np.arange(len(OFFSETS)), place), (np.arange(HIDDEN), back.sum(axis=0)), (v_rows, joint[:, :HIDDEN]), (v_rows, joint[:, HIDDEN])]


def _by_row(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values of equal rows; an even number of columns."""
    # Numbers of two bytes take a radix sort; two columns at a time are added as parts of complex numbers.
    order = np.argsort(rows.astype(np.uint16), kind="stable") if n_rows <= 1 << 16 else np.argsort(rows)
    sorted_ = rows.take(order)
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    pairs = np.complex64 if values.dtype == np.float32 else np.complex128
    return sorted_[cut], np.add.reduceat(values.take(order, axis=0).view(pairs), cut, axis=0).view(values.dtype)


class Trainer:
    """Adagrad steps of one partition."""

    def __init__(self, model: Model):
        self.model, self.weights, self.squares, self.words = model, model.weights.copy(), np.full_like(model.weights, 1e-8), 0

    def learn(self, leaves: np.ndarray, counts: np.ndarray, phase: int) -> None:
        window, targets = self.model.windows(leaves, counts)[:, phase::ROUNDS], leaves[phase::ROUNDS]
        for a in range(0, len(targets), BATCH):
            self._step(window[:, a : a + BATCH], targets[a : a + BATCH])

    def _step(self, window: np.ndarray, target: np.ndarray) -> None:
        grads = self.model.gradient(self.weights, window, target)
        for part, squares, (rows, grad) in zip(self.model.views(self.weights), self.model.views(self.squares), grads):
            sums = squares.take(rows, axis=0) + grad * grad
            squares[rows] = sums
            part[rows] -= RATE * grad / np.sqrt(sums)
        self.words += len(target)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: the occurrences of each different word (by its 64-bit hash) in all texts. Stored; it grows with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            words, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c for _, c in held]), len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, step in steps(batch.column(0)):
                words, counts = np.unique(words_of(step)[0], return_counts=True)
                held.append((words, counts))
                size += len(words)
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return stored(clean_names(docs, "text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def new_model(docs: DataFrame) -> Model:
    """Counts, leaves and a network that knows frequencies only. What reaches the driver is as large as the model."""
    words = count_words(docs)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_own = min(MOST_OWN, max(LEAST_OWN, int(OWN_PER_ROOT * total**0.5)))
    top = words.orderBy(F.desc("n"), "word").limit(n_own).collect()
    own = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    shared = max(2, n_own // SHARED_PART)
    # Of the other words: occurrences and different ones of each shared leaf.
    leaf = F.pmod(F.shiftrightunsigned("word", 20), F.lit(shared))
    last = (top[-1]["n"], top[-1]["word"]) if top else (0, 0)
    rest = words.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    counts, kinds = np.zeros(len(own) + shared, np.int64), np.zeros(shared, np.int64)
    counts[: len(own)] = [r["n"] for r in top]
    for r in rest.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        counts[len(own) + r["leaf"]], kinds[r["leaf"]] = r["n"], r["kinds"]
    return Model(own, counts, kinds, words)


def train(docs: DataFrame) -> Model:
    """Counts and network of a corpus."""
    model = new_model(docs)
    for phase in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], model=model, phase=phase) -> Iterator[pa.RecordBatch]:
            own = Trainer(model)
            for batch in batches:
                for _, step in steps(batch.column(0)):
                    words, counts = words_of(step)
                    own.learn(model.leaves(words), counts, phase)
            if own.words:
                n = -(-len(own.weights) // CHUNK)
                data = [own.weights[k * CHUNK : (k + 1) * CHUNK].astype(np.float64) * UNIT for k in range(n)]
                share = -(-own.words // 1024)
                salt = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, salt, np.int32)), pa.array(np.full(n, share)), pa.array([(np.rint(d).astype(np.int64) * share).tobytes() for d in data], pa.binary())], names=["chunk", "salt", "share", "sums"])

        def total(table: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sums"))
            return pa.table({"chunk": table.column("chunk")[:1], "salt": pa.array([0], pa.int32()), "share": [sum(table.column("share").to_pylist())], "sums": pa.array([sums.tobytes()], pa.binary())})

        kind = "chunk int, salt int, share long, sums binary"
        own = clean_names(docs, "text").mapInArrow(run, kind)
        rows = own.groupBy("chunk", "salt").applyInArrow(total, kind).groupBy("chunk").applyInArrow(total, kind).collect()
        for r in rows:
            model.weights[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["sums"], np.int64) / (r["share"] * UNIT)
    return model


def pseudo_likelihood(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, score, score_per_token`` of each row.

    ``score`` is the sum of the words' conditional log-probabilities. Texts without words, null
    ones included, have 0 words, score 0 and no score a word. Repeated rows score alike up to
    single-precision rounding. Ids may be of any type; a text of any length is scored whole. An
    empty table stays empty; a model of an empty corpus takes every word for one never seen.
    """
    source = clean_names(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, step in steps(batch.column(1)):
                words, counts = words_of(step)
                leaves = model.leaves(words)
                doc = np.repeat(np.arange(step.docs), counts)
                sums = np.bincount(doc, model.log_probabilities(leaves, counts), step.docs).astype(np.float64)
                # Different words of shared leaves, with their occurrences, by document.
                rare = np.flatnonzero(leaves >= model.n_own)
                order = rare[np.lexsort((words[rare], doc[rare]))]
                w, d = words[order], doc[order]
                cut = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])) if len(w) else np.zeros(0, np.int64)
                bounds = pa.array(np.searchsorted(d[cut], np.arange(step.docs + 1)).astype(np.int32))
                times = np.diff(np.append(cut, len(w))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, step.docs), pa.array(number + np.arange(step.docs)), pa.array(counts.astype(np.int64)), pa.array(sums, pa.float64()), pa.ListArray.from_arrays(bounds, pa.array(w[cut].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times))],
                    names=["doc_id", "number", "n_tokens", "sum", "words", "times"],
                )
                number += step.docs

    base = stored(source.mapInArrow(run, f"doc_id {kind}, number long, n_tokens long, sum double, words array<long>, times array<int>"), "lm-base")
    rare = base.select("number", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word")
    # log P(word | leaf): a word's occurrences elsewhere and one more, of those of its leaf's words and of one word never seen.
    room = F.array(*(F.lit(float(np.log(n + k + 1))) for n, k in zip(model.counts[model.n_own :], model.kinds))) if model.shared <= 256 else None
    leaf = F.pmod(F.shiftrightunsigned("word", 20), F.lit(model.shared))
    known = model.words.where("n > 0").select(F.col("word").alias("w"), F.col("n"))
    found = rare.join(known, F.col("word") == F.col("w"), "left")
    log_n = F.log(F.greatest(F.coalesce("n", F.lit(0)) - F.col("times"), F.lit(0)) + 1.0)
    if room is not None:
        log_room = F.get(room, leaf.cast("int"))
    else:  # one row a shared leaf, at most MOST_OWN / SHARED_PART of them
        spark = docs.sparkSession
        rooms = spark.createDataFrame([(k, float(np.log(n + m + 1))) for k, (n, m) in enumerate(zip(model.counts[model.n_own :], model.kinds))], "leaf long, room double")
        found = found.withColumn("leaf", leaf).join(F.broadcast(rooms), "leaf")
        log_room = F.col("room")
    within = found.select("number", (F.col("times") * (log_n - log_room)).alias("x")).groupBy("number").agg(F.sum("x").alias("within"))
    score = F.col("sum") + F.coalesce("within", F.lit(0.0))
    out = base.select("doc_id", "number", "n_tokens", "sum").join(within, "number", "left")
    return out.select("doc_id", "n_tokens", score.alias("score"), F.when(F.col("n_tokens") > 0, score / F.col("n_tokens")).alias("score_per_token"))


def op2_masked_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudo_likelihood(docs, train(docs))
