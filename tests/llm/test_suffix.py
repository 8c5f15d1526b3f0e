import hashlib
from collections import Counter

import numpy as np
import pytest
from newswell.llm import suffix


def brute(rows, length, keep):
    data = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    seen, out = set(), {}
    for k in order:
        d, flags = data[k], np.zeros(len(data[k]) + 1, int)
        for i in range(len(d) - length + 1):
            s = d[i : i + length]
            if (count[s] > 1) if keep == "none" else (s in seen):
                flags[i] += 1
                flags[i + length] -= 1
            seen.add(s)
        flags = np.cumsum(flags[:-1]) > 0
        out[k] = (rows[k][0], len(d), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~flags])).hexdigest())
    return sorted(out.values(), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=str)


def rows(corpus):
    rng = np.random.default_rng(2)
    shared = " ".join(f"p{rng.integers(99)}" for _ in range(80))
    own = lambda n: " ".join(f"q{rng.integers(999)}" for _ in range(n))
    more = [(100 + k, f"{own(30)} {shared} {own(20)}") for k in range(8)] + [(120, "a" * 1000), (121, "ab" * 400 + own(30)), (122, "ä" * 150), (123, shared[:150])]
    return [x for x in corpus if x[0] != 50] + more


@pytest.mark.parametrize(("keep", "hot", "sort"), [("none", 20_000, 2 << 20), ("none", 2, 100), ("first", 20_000, 100), ("first", 2, 2 << 20)])
def test_matches_brute_force(documents, corpus, monkeypatch, keep, hot, sort):
    monkeypatch.setattr(suffix, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix, "SORT_BYTES", sort)
    r = rows(corpus)
    if keep == "first":  # rows equal in id and text stay together
        r = list(dict.fromkeys(r))
    assert got(suffix.remove_repeats(documents(r), 200, keep)) == brute(r, 200, keep)


def test_rows_equal_in_id_and_text_stay_together(documents):
    rng = np.random.default_rng(9)  # a text that does not repeat itself
    text = "".join(chr(97 + k) for k in rng.integers(0, 26, 500))
    out = suffix.remove_repeats(documents([(1, text), (1, text), (2, text)]), 200, "first").collect()
    assert sorted((r["doc_id"], len(r["kept"])) for r in out) == [(1, 500), (1, 500), (2, 0)]


def test_smaller_before():
    p = np.array([5, 3, 4, 9, 1, 7, 2])
    want = [max([j for j in range(i) if p[j] < p[i]], default=-1) for i in range(len(p))]
    assert suffix.smaller_before(p).tolist() == want


def test_previous_factors_match_brute_force():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    raw, length = data.tobytes(), 8
    starts = np.arange(len(data) - length + 1)
    rank = suffix.suffix_ranks(data, starts, length)
    strings = [raw[s : s + length] for s in starts]
    for keep in ("first", "none"):
        want = [x in strings[:k] or (keep == "none" and x in strings[k + 1 :]) for k, x in enumerate(strings)]
        assert suffix.repeated(rank, starts, keep).tolist() == want


def test_query_columns(spark, documents, tmp_path):
    own = lambda seed: "".join(chr(97 + k) for k in np.random.default_rng(seed).integers(0, 26, 300))
    shared = own(1)[:250]
    rows_ = [(1, own(2) + shared + own(3)), (2, own(4) + shared), (3, None), (4, own(5))]
    documents(rows_).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffix.op8_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [(got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"]) for k in (1, 2, 3, 4)] == [(850, 250, 1), (550, 250, 1), (0, 0, 0), (300, 0, 0)]
    assert got[1]["kept_sha256"] == hashlib.sha256((own(2) + own(3)).encode()).hexdigest()


def test_suffix_ranks_are_byte_order():
    data = np.frombuffer(b"banana bandana cabana banana bandana ", np.uint8)
    for length in (8, 11, 16):
        starts = np.arange(len(data) - length + 1)
        strings = [bytes(data[s : s + length]) for s in starts]
        order = {x: k for k, x in enumerate(sorted(set(strings)))}
        assert suffix.suffix_ranks(data, starts, length).tolist() == [order[x] for x in strings]


def test_empty_and_clashing(documents, clashing, corpus):
    assert suffix.remove_repeats(documents([])).count() == 0
    assert suffix.remove_repeats(clashing, keep="none").count() == len(corpus)
