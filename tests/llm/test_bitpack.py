import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from newswell.llm import bitpack
from newswell.llm.shared import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 777):
        ids = rng.integers(0, 1 << bits, n)
        data = bitpack.pack(ids, bits)
        assert len(data) == -(-n // 64) * bits * 8 and (bitpack.unpack(data, n, bits) == ids).all()


TEXTS = ["İstanbul ΣΑΣ straße ÀÉ's don't x'll a.b,c 12,3", "<|endoftext|> a<|endoftext|>b", "ªµ \x1c a\x1cb é ́x  tab\tq nb\xa0sp", "", " \n ", "Hello, WORLD!?..;", "été."]


def plain(tokenizer, texts):
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kept", [4, 100_000])
def test_column_encoder_equals_the_library(monkeypatch, kept):
    monkeypatch.setattr(bitpack, "CACHE_WORDS", kept)
    e = bitpack.Encoder(PATH)
    assert e.by_parts
    rng = np.random.default_rng(1)
    alphabet = list("abcdeABCDE  \n\t.,;:!?'-12éÉßµªΣσİı\u0301\xa0漢")
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(2000)] * 2
    ids, at = e.encode(pa.array(texts).slice(3))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == plain(e.tokenizer, texts[3:])
    ids, at = e.encode(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [x + [2] for x in plain(e.tokenizer, texts)]
    assert e.encode(pa.array([], pa.string()), 2)[1].tolist() == [0]


def test_tokenizers_of_other_settings_read_whole_texts():
    e = bitpack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_parts
    ids, at = e.encode(pa.array(TEXTS), 7)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [x + [7] for x in plain(e.tokenizer, TEXTS)]


def test_files_round_trip(spark, documents, corpus):
    manifest = bitpack.write_tokens(documents(), PATH, scratch(spark, "t"), file_rows=7)
    assert manifest.count() > 3
    got = sorted(bitpack.read_tokens(manifest).collect(), key=lambda r: r["start"])
    e = bitpack.Encoder(PATH)
    want = {}
    for i, t in corpus:
        want.setdefault(i, []).append(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    assert len(got) == len(corpus)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
        want[r["doc_id"]].remove(r["ids"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)


def test_random_access(spark, tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n) for n in (0, 5, 40_000, 1, 300_000, 16_384)]
    w = bitpack.Writer(f"file://{tmp_path}/x.bin", 16)
    for k, ids in enumerate(docs):
        w.add(k, ids)
    assert w.close() == (6, sum(map(len, docs)))
    r, flat = bitpack.Reader(f"file://{tmp_path}/x.bin"), np.concatenate(docs)
    for a, b in ((0, 1), (5, 5), (16_383, 16_385), (100_000, 290_000), (len(flat) - 1, len(flat))):
        assert (r.ids(a, b) == flat[a:b]).all()
    with open(f"{tmp_path}/cut.bin", "wb") as f:
        f.write(open(f"{tmp_path}/x.bin", "rb").read()[:-9])
    with pytest.raises(ValueError):
        bitpack.Reader(f"file://{tmp_path}/cut.bin")


def test_query_columns(spark, documents, clashing, corpus):
    rows = bitpack.read_tokens(bitpack.write_tokens(clashing, PATH, scratch(spark, "t"))).mapInArrow(bitpack._digest, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()
    empty = next(r for r in rows if r["doc_id"] == 32)
    assert empty["n_tokens"] == 1 and empty["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())
    assert bitpack.read_tokens(bitpack.write_tokens(documents([]), PATH, scratch(spark, "t"))).count() == 0


def test_query_equals_the_library(spark, documents, corpus, tmp_path):
    rows = [(i, t) for i, t in corpus if i is not None and i not in (40, 41)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = bitpack.op5_token_bitpacking(spark, str(tmp_path)).collect()
    e, start = bitpack.Encoder(PATH), 0
    want = []
    for i, t in sorted(rows):
        (ids,) = plain(e.tokenizer, [t or ""])
        ids.append(2)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want
