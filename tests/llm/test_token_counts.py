import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from newswell.llm import token_counts as tc
from newswell.llm.queries import queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|>a <|endoftext|>  b<|endoftext|><|endoftext", "a'sb''re'rx'v 've'l'll'd 'S", "a" * 1200, "-" * 5000, " " * 700 + "x", "\n" * 300, None, "", "ab" * 4000 + "c", "=-" * 1000, "\x00\x1c\x85", "🙂漢字́a"]


def want(texts):
    return [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def fuzz(n, seed=1):
    rng = np.random.default_rng(seed)
    alphabet = list("abcdrevlstmREA''  \n\t.,!?-12éÉßµªΣ漢́\xa0 🙂\x85\x1c½Ⅷ")
    return ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(n)]


def test_counts_equal_the_library():
    rng = np.random.default_rng(2)
    texts = fuzz(2000) + ODD + ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(200, 3000))) for _ in range(10)]
    assert tc.counter(PATH).count(pa.array(texts)).tolist() == want(texts)


def test_splitter_is_the_same_for_all_chunk_sizes():
    kinds = np.random.default_rng(3).integers(0, 12, 5000).astype(np.uint8)
    s = tc.Splitter()
    whole = s.starts(kinds, 8192)
    assert all((s.starts(kinds, n) == whole).all() for n in (1, 7, 256))
    assert not len(s.starts(kinds[:0]))


def test_small_tables_and_parts_change_nothing(monkeypatch):
    monkeypatch.setattr(tc, "SLICE_BYTES", 512)
    monkeypatch.setattr(tc, "MOST_STATES", 1 << 11)
    c = tc.TokenCounter(PATH)
    texts = fuzz(300, 4) + ODD + [" ".join(fuzz(200, 5))]
    assert c.count(pa.array(texts)).tolist() == want(texts)
    data = np.frombuffer(" ".join(fuzz(400, 6) + ["x y"] * 50).encode(), np.uint8)
    cut = list(tc.parts(tc.Step(data, np.array([0, len(data)])), 1000))
    assert len(cut) > 3 and b"".join(p.data.tobytes() for p in cut) == data.tobytes()
    assert sum(int(c._count(p)[0]) for p in cut) == want([data.tobytes().decode()])[0]


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        tc.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark, documents, corpus):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.count_tokens(documents(kept="a", n_bytes=3), PATH, 100).collect())
    n = want([t for _, t in corpus])
    assert got == sorted((i is None, i or 0, len((t or "").encode()), k, k > 100) for (i, t), k in zip(corpus, n))
    assert tc.count_tokens(documents([]), PATH).count() == 0
    named = tc.count_tokens(documents().selectExpr("CAST(doc_id AS string) AS doc_id", "text"), PATH)
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == len(corpus)


def test_query(spark):
    got = queries()["op11_token_counts"](spark, "/root/testdata/sf0.001").toPandas()
    assert list(got.columns) == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id")
    assert got["n_tokens"].tolist() == want(docs.loc[got["doc_id"], "text"].tolist())
