import random
import re

from newswell.llm import decontam


def split(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def distance(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.choice("idr")
        if kind == "i":
            out.insert(k, "extra")
        elif kind == "d" and len(out) > 1:
            del out[k]
        else:
            out[k] = "other"
    return out


def items_and_texts():
    rng = random.Random(8)
    word = lambda: f"v{int(60 * rng.random() ** 2)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 4, 7, 8, 12, 15, 25, 40, 59))]
    texts = []
    for k, t in items:
        for n in (0, 1, 2, 4, 6, 9):
            own = edited(rng, t.split(), n)
            texts.append((len(texts), " ".join([*(word() for _ in range(rng.randrange(40))), *own, *(word() for _ in range(rng.randrange(40)))])))
    return items, texts


def test_matches_brute_force(spark, documents, corpus, clashing):
    items, texts = items_and_texts()
    items += [(90, None), (91, ""), (92, items[5][1])]
    texts += [(900, None), (901, items[6][1].upper().replace(" ", ", ")), (901, items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find_items(documents(texts), bench).collect()}
    want = set()
    for i, t in items:
        w = split(t)
        if len(w) >= decontam.LEAST_WORDS:
            for d, x in texts:
                n = distance(w, split(x))
                if n <= decontam.budget(len(w)):
                    want.add((d, i, n))
    assert got == want and len(want) > 30
    clean = {r["doc_id"] for r in decontam.decontaminate(documents(texts), bench).collect()}
    assert clean == {d for d, _ in texts} - {d for d, _, _ in want}
    out = decontam.decontaminate(clashing, bench)
    assert out.columns == clashing.columns and out.count() == len(corpus)


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    items, texts = items_and_texts()
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(decontam.find_items(documents(texts), bench))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert key(decontam.find_items(documents(texts), bench)) == whole


def test_spans_hold_the_item(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (r,) = decontam.find_items(documents([(1, f"x y z {item.replace('delta', 'DELTA!')} q r")]), bench).collect()
    assert (r["start_word"], r["end_word"], r["distance"]) == (3, 13, 0)


def test_empty(spark, documents, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_items(documents(), none).count() == 0 and decontam.decontaminate(documents(), none).count() == len(corpus)
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontam.find_items(documents([]), bench).count() == 0 and decontam.decontaminate(documents([]), bench).count() == 0


def test_short_items_are_found(spark, documents):
    bench = spark.createDataFrame([(1, "solo"), (2, "two words"), (3, "one two three four five"), (4, "a b c d")], "item_id long, text string")
    texts = [(1, "x solo y"), (2, "x two, words y"), (3, "x one two changed four five y"), (4, "a b x d"), (5, "x y z")]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find_items(documents(texts), bench).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 1)}
    assert {r["doc_id"] for r in decontam.decontaminate(documents(texts), bench).collect()} == {4, 5}


def test_string_ids_and_query(spark, documents, tmp_path):
    bench = spark.createDataFrame([("q1", "one two three four five six"), ("q2", None)], "item_id string, text string")
    docs = spark.createDataFrame([("d1", "x one two three four five six y"), (None, "nothing")], "doc_id string, text string")
    assert [tuple(r) for r in decontam.find_items(docs, bench).collect()] == [("d1", "q1", 0, 1, 7)]
    documents([(1, "see one two three four five six"), (2, "clean")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in decontam.op10_decontamination(spark, str(tmp_path)).collect()] == [(1, 7, 0, 1, 7)]
