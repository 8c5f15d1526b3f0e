import re

import numpy as np
import pytest
from newswell.llm import jaccard


def shingles(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws)} if 0 < len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i is None, i or 0), len(s), -1 if (c := least.get(find(k))) is None else c) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def family(rng, n, size, edits, first):
    base = [f"w{rng.integers(5000)}" for _ in range(size)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.integers(size)] = f"e{rng.integers(10_000)}"
        out.append((first + k, " ".join(own)))
    return out


def shown(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


@pytest.mark.parametrize(("n", "percent", "tile"), [(3, 90, 512), (5, 80, 6)])
def test_components_match_brute_force(documents, corpus, monkeypatch, n, percent, tile):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    rng = np.random.default_rng(1)
    rows = [*corpus, *family(rng, 25, 150, 3, 1000), *family(rng, 20, 60, 1, 2000), *family(rng, 6, 12, 1, 3000)]
    assert shown(jaccard.similar_groups(documents(rows), n, percent)) == brute(rows, n, percent)


def test_pairs_at_the_threshold_share_a_key():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for size in (10, 19, 50, 300, 2000):
            for _ in range(20):
                base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                most = size * (100 - percent) // (100 + percent)
                a = np.unique(np.concatenate([base[most:], rng.integers(0, 1 << 63, most, dtype=np.uint64)]))
                b = np.unique(base)
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    keys = [set(jaccard.segment_keys(x, int(bands.of(len(x))), bands).tolist()) for x in (a, b)]
                    assert keys[0] & keys[1]


def test_one_of_each_group_stays(documents, clashing):
    kept = jaccard.drop_near_copies(documents(), 5, 80)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and not set(range(20, 26)) & set(ids) and 1 in ids and 30 not in ids and 31 not in ids
    assert {32, 33, 34, 50, 52} <= set(ids)
    assert jaccard.drop_near_copies(clashing, 5, 80).columns == clashing.columns


def test_empty(documents):
    assert jaccard.similar_groups(documents([])).count() == 0
    assert jaccard.drop_near_copies(documents([])).count() == 0


def test_rows_without_or_with_shared_ids_are_decided_by_themselves(documents):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    rows = [(None, text("a")), (None, near("a")), (1, text("b")), (5, near("b")), (5, text("c")), (7, text("d")), (7, text("d"))]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in jaccard.drop_near_copies(documents(rows), 5, 80).collect())
    assert len([k for k in kept if k[0] == -1]) == 1
    assert kept[1:] == [(1, text("b")), (5, text("c")), (7, text("d"))]


def test_keys_and_texts_are_not_shuffled_whole_without_broadcasts(spark, documents, monkeypatch):
    """What a join without broadcasts writes to shuffles stays below the texts; before, keys as rows and whole texts went through them several times."""
    from newswell.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 500))) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(10)] + [(2000, rows[3][1])]
    df = documents(rows)
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        it = store.stageList(jvm.java.util.ArrayList(), False, False, spark._sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(it.apply(k).shuffleWriteBytes() for k in range(it.size()))

    before = written()
    kept = [r["doc_id"] for r in jaccard.drop_near_copies(df, 5, 80).collect()]
    assert sorted(kept) == list(range(300))
    assert written() - before < sum(len(t) for _, t in rows)


def test_keys_of_many_rows_and_flushes_meet(documents, monkeypatch):
    """Packed keys come back as they were, and rows of one key meet within a flush and across several."""
    refs, keys = np.array([0, 0, 3, 9, 70_000]), np.array([5, 1 << 39, 7, (1 << 40) - 1, 5], np.uint64)
    assert all((x == y).all() for x, y in zip(jaccard._unpacked(*jaccard._packed(refs, keys)), (refs, keys)))
    values, owners = [np.array([1, 2, 3], np.uint64), np.array([3, 9], np.uint64), np.array([3], np.uint64)], [np.array([0, 0, 0]), np.array([1, 1]), np.array([2])]
    out = list(jaccard._flushed(7, 1, values, owners))
    assert len(out) == 1 and out[0][:2] == (0, 7) and np.frombuffer(out[0][4], np.int64).reshape(-1, 2).tolist() == [[1, 0], [2, 0]]
    assert jaccard._unpacked(*out[0][2:4])[0].tolist() == [0, 0, 0, 1]
    rows = family(np.random.default_rng(3), 40, 80, 1, 0)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 500)
    assert shown(jaccard.similar_groups(documents(rows).repartition(5), 3, 90)) == brute(rows, 3, 90)


def test_a_bounded_test_holds_all_its_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from newswell.llm import shared

    keys, others = spark.range(500).select(F.xxhash64("id").alias("k")), spark.range(10_000, 20_000).select(F.xxhash64("id").alias("k"))
    held = shared.may_hold(keys)
    assert keys.where(held("k")).count() == 500 and others.where(held("k")).count() < 500
    monkeypatch.setattr(shared, "MOST_BITS", 1 << 9)
    assert keys.where(shared.may_hold(keys)("k")).count() == 500
    assert others.where(shared.may_hold(keys.limit(0))("k")).count() == 0
