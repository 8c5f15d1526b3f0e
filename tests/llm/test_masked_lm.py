import math
import random

import numpy as np
import pyarrow as pa

from newswell.llm import masked_lm
from newswell.llm.decontam import words_of
from newswell.llm.shared import steps


def model_of(texts, n_own=4, shared=3, seed=None):
    """A small model without Spark; with a seed its weights are random."""
    words = np.concatenate([words_of(step)[0] for _, step in steps(pa.array(texts))])
    own, n = np.unique(words, return_counts=True)
    top = np.lexsort((own, -n))[:n_own]
    model = masked_lm.Model(own[top], np.concatenate([n[top], np.zeros(shared, np.int64)]), np.zeros(shared, np.int64))
    for w, c in zip(np.delete(own, top), np.delete(n, top)):
        leaf = int(model.leaves(np.array([w]))[0])
        model.counts[leaf] += c
        model.kinds[leaf - n_own] += 1
    model = masked_lm.Model(own[top], model.counts, model.kinds)
    if seed is not None:
        model.weights = np.random.default_rng(seed).normal(0, 0.5, len(model.weights)).astype(np.float32)
    return model, dict(zip(own.tolist(), n.tolist()))


def plain(model, words):
    """log P(leaf | window) by loops over words, positions and nodes."""
    embed, place, bias, vectors, offsets = (p.astype(float) for p in model.views(model.weights))
    leaves, out = model.leaves(words), []
    for k, leaf in enumerate(leaves):
        h = bias.copy()
        for j, o in enumerate(masked_lm.OFFSETS):
            h += place[j] * embed[leaves[k + o] if 0 <= k + o < len(leaves) else len(model.counts)]
        h, log = np.tanh(h), 0.0
        t = model.tree
        for at in range(t.first[leaf], t.first[leaf] + t.size[leaf]):
            p = 1 / (1 + math.exp(-(vectors[t.nodes[at]] @ h + offsets[t.nodes[at]])))
            log += math.log(p if t.right[at] else 1 - p)
        out.append(log)
    return np.array(out)


TEXTS = ["a b c a b d a e f a b", "g a b c", "a", "h i j a b c d e"]


def test_scorer_equals_plain_loops():
    model, _ = model_of(TEXTS, seed=1)
    for _, step in steps(pa.array(TEXTS)):
        words, counts = words_of(step)
        got = model.log_probabilities(model.leaves(words), counts)
        want = np.concatenate([plain(model, w) for w in np.split(words, np.cumsum(counts)[:-1])])
        assert np.abs(got - want).max() < 1e-4


def test_probabilities_of_all_leaves_sum_to_one_and_start_as_frequencies():
    for n_own in (2, 5):
        model, _ = model_of(TEXTS, n_own=n_own, seed=2)
        n = len(model.counts)
        window = np.tile(np.array([[0], [1], [n], [2]]), n)
        logs = model.forward(model.views(model.weights), window, np.arange(n))
        assert abs(np.exp(logs).sum() - 1) < 1e-5
        model, _ = model_of(TEXTS, n_own=n_own)
        logs = model.forward(model.views(model.weights), window, np.arange(n))
        assert np.abs(np.exp(logs) - (model.counts + 1) / (model.counts + 1).sum()).max() < 1e-5


def test_gradient_by_differences():
    model, _ = model_of(TEXTS, seed=3)
    model.weights = model.weights.astype(np.float64)
    (_, step), = steps(pa.array(TEXTS))
    words, counts = words_of(step)
    leaves = model.leaves(words)
    window = model.windows(leaves, counts)
    loss = lambda w: -model.forward(model.views(w), window, leaves).mean()
    dense = np.zeros_like(model.weights)
    for part, (rows, grad) in zip(model.views(dense), model.gradient(model.weights, window, leaves)):
        part[rows] += grad
    rng = np.random.default_rng(4)
    for k in rng.choice(len(dense), 120, replace=False):
        w = model.weights.copy()
        w[k] += 1e-5
        up = loss(w)
        w[k] -= 2e-5
        assert abs((up - loss(w)) / 2e-5 - dense[k]) < 1e-6


def patterned(rng, n):
    """Texts in which the neighbours of a word tell it."""
    return [" ".join(x for _ in range(60) for x in rng.choice((("red", "big", "fox"), ("old", "sad", "dog"), ("new", "hot", "pie")))) for _ in range(n)]


def mean(model, texts):
    total = n = 0
    for _, step in steps(pa.array(texts, pa.large_string())):
        words, counts = words_of(step)
        logs = model.log_probabilities(model.leaves(words), counts)
        total, n = total + logs.sum(), n + len(logs)
    return total / n


def test_held_out_text_scores_better_in_order(documents):
    rng = random.Random(3)
    model = masked_lm.train(documents(list(enumerate(patterned(rng, 400)))))
    held = patterned(rng, 30)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    unigram = float((model.counts * np.log((model.counts + 1) / (model.counts + 1).sum())).sum() / model.counts.sum())
    assert mean(model, held) > mean(model, shuffled) + 0.2
    assert mean(model, held) > unigram + 0.2


def test_scores_equal_a_plain_sum_and_rows_are_defined(documents, corpus, clashing, monkeypatch):
    monkeypatch.setattr(masked_lm, "LEAST_OWN", 8)
    monkeypatch.setattr(masked_lm, "OWN_PER_ROOT", 0.3)
    df = documents()
    model = masked_lm.train(df)
    counts = {r["word"]: r["n"] for r in model.words.collect()}
    total = {}
    for _, t in corpus:
        for _, step in steps(pa.array([t], pa.large_string())):
            for w in words_of(step)[0].view(np.int64).tolist():
                total[w] = total.get(w, 0) + 1
    assert counts == total and model.counts.sum() == sum(total.values())
    rows = masked_lm.pseudo_likelihood(clashing, model).collect()
    assert len(rows) == len(corpus)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        assert r["score"] <= 0 and np.isfinite(r["score"])
    assert by[32][0]["n_tokens"] == 0 and by[32][0]["score"] == 0 and by[32][0]["score_per_token"] is None
    for i in (0, 3, 37, 38, 52, 35):
        for _, step in steps(pa.array([dict(corpus)[i]], pa.large_string())):
            words, _ = words_of(step)
            want = plain(model, words).sum()
            for w, leaf in zip(words.view(np.int64).tolist(), model.leaves(words)):
                if leaf >= model.n_own:
                    k = int((words.view(np.int64) == w).sum())
                    want += math.log((total[w] - k + 1) / (model.counts[leaf] + model.kinds[leaf - model.n_own] + 1))
            assert abs(want - by[i][0]["score"]) < 1e-3 * max(1, abs(want)) and by[i][0]["n_tokens"] == len(words)


def test_documents_that_occur_twice_score_apart(documents, monkeypatch):
    monkeypatch.setattr(masked_lm, "OWN_PER_ROOT", 0.4)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common = [word() for _ in range(40)]
    text = lambda: " ".join(word() if k % 3 == 0 else rng.choice(common) for k in range(120))
    twice, once = [text() for _ in range(30)], [text() for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(twice + twice + once)]
    model = masked_lm.train(documents(rows))
    got = {r["doc_id"]: r["score_per_token"] for r in masked_lm.pseudo_likelihood(documents(rows), model).collect()}
    low = sorted(got[k] for k in range(60))[6]
    assert sum(got[k] < low for k in range(60, 120)) >= 54
    assert all(abs(got[k] - got[k + 30]) < 1e-3 for k in range(30))


def test_what_is_gathered_grows(documents):
    small = masked_lm.new_model(documents([(1, "a b c")]))
    large = masked_lm.new_model(documents([(k, " ".join(f"w{k}x{j}" for j in range(100))) for k in range(60)]))
    assert small.words.count() == 3 and large.words.count() == 6000 and len(large.counts) > len(small.counts)


def test_empty_and_query(spark, documents, tmp_path):
    model = masked_lm.train(documents([]))
    assert masked_lm.pseudo_likelihood(documents([]), model).count() == 0
    (r,) = masked_lm.pseudo_likelihood(documents([(1, "never seen")]), model).collect()
    assert r["n_tokens"] == 2 and np.isfinite(r["score"]) and r["score"] < 0
    documents([(1, "one two three two"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(masked_lm.op2_masked_lm_score(spark, str(tmp_path)).collect())
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(1, 4), (2, 0)]
