import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from newswell.llm import alignment
from newswell.llm.queries import queries
from newswell.llm.token_counts import byte_alphabet
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(texts):
    """Measures of each text, by offsets and pairwise overlaps."""
    one, two, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    one.encode_special_tokens = True

    def tokens(t):
        ids = one.encode(" " + t, add_special_tokens=False).ids
        own = [(i, bytes(alphabet[c] for c in one.id_to_token(i))) for i in ids]
        other = [(i, bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(t)]
        whole = (" " + t).encode()
        return (own, other) if b"".join(x for _, x in own) == whole == b"".join(x for _, x in other) else None

    cells, counts = [], Counter()
    for t in texts:
        found = tokens(t) if t else None
        if not found:
            cells.append(None)
            continue
        spans = []
        for side in found:
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, a, b in s if low <= a < high) for s in spans))
            low = high
        links = [(i, j) for i, a, b in spans[0] for j, c, d in spans[1] if a < d and c < b]
        counts.update(links)
        cells.append((len(found[0]), len(found[1]), groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if c is None else (c[0], c[1], len(c[2]), len(c[3]), sum(counts[x] == most[x[1]] for x in c[3]), sum(counts[x] for x in c[3]), hashlib.sha256(";".join(c[2]).encode()).hexdigest()) for c in cells
    ], counts


TEXTS = ["a b", "a  b", " a", "a ", "a\nb\tc", "", None, "  ", "<|endoftext|><s>x</s>", "<0x41>", "é ½ ﬁ", "a▁b", "\x00a", "don't stop", "🙂 漢字", "▁ ▁", "x" * 300, "ab " * 50]


@pytest.fixture
def rows(corpus):
    return [r for r in corpus if r[1] is None or len(r[1]) < 5000] + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(200 + k, "a copy of one text") for k in range(150)]


@pytest.mark.parametrize("small", [False, True])
def test_measures_equal_brute_force(documents, rows, monkeypatch, small):
    if small:  # very small blocks, caches and steps
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 100)
        monkeypatch.setattr(alignment, "CACHE_WORDS", 5)
    got = alignment.align_tokens(documents(rows, rank=1, pair="x"), A, B).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r[c] for c in ("doc_id", *MEASURES)) for r in got), key=key) == sorted(((i, *m) for (i, _), m in zip(rows, brute([t for _, t in rows])[0])), key=key)


def test_pair_table_and_empty_tables(documents, rows):
    got = {(r["a"], r["b"]): r["count"] for r in alignment.align_tokens(documents(rows), A, B, pair_table=True).collect()}
    assert got == dict(brute([t for _, t in rows])[1])
    assert alignment.align_tokens(documents([]), A, B).count() == 0
    assert [tuple(r) for r in alignment.align_tokens(documents([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_long_text_is_aligned_in_parts(documents, rows, monkeypatch):
    """Parts are a megabyte, so the text is a word list long enough for three; both ways must agree."""
    import numpy as np
    from newswell.llm.shared import Step
    from newswell.llm.token_counts import parts

    rng = np.random.default_rng(3)
    data = np.frombuffer((" " + " ".join(f"w{k} x'{k % 7}\n" for k in rng.integers(0, 9999, 4000))).encode(), np.uint8)
    step, mine = Step(data, np.array([0, len(data)])), alignment.aligner(A, B)
    whole = mine.align(mine.tokens(step)[0])
    cut = [mine.align(mine.tokens(p)[0]) for p in parts(step, 5000)]
    assert len(cut) > 3 and all(sum(int(c[0][m][0]) for c in cut) == int(whole[0][m][0]) for m in whole[0])
    assert b"".join(c[1][0] for c in cut) == whole[1][0] and np.concatenate([c[2] for c in cut]).tolist() == whole[2].tolist()


def test_query(spark):
    got = queries()["op13_token_alignment"](spark, "/root/testdata/sf0.001").toPandas()
    assert list(got.columns) == ["doc_id", *MEASURES[:-1], "groups_sha256"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    short = docs[docs["text"].fillna("").str.len() < 3000]
    assert len(got) == len(docs) and (got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"]).all()
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    spelt = got.set_index("doc_id").loc[short["doc_id"]]
    assert all(n in (0, len(two.encode(t or ""))) for n, t in zip(spelt["n_b"], short["text"]))
