import re
from collections import defaultdict

from newswell.llm import mixing
from newswell.llm.shared import stored
from pyspark.sql import functions as F


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > most * sizes[s]}
        if not over:
            return target | {s: most * sizes[s] for s in full}
        full |= over


def rows_of(spark, df):
    sizes = stored(mixing.sized(df), "sizes")
    return mixing.with_copies(sizes, mixing.mixing_plan(sizes)).collect()


def test_targets_and_counts(spark, documents, corpus):
    rows = [x for x in corpus if x[0] != 50] + [(100 + k, "word " * (10 + k % 37)) for k in range(400)] + [(600, "long " * 2000)]
    df = documents(rows).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.col("source")))
    got = rows_of(spark, df)
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["n_copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["n_copies"] <= 2 and r["source_size"] is not None
    for s, t in fill(dict(sizes)).items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= max(3, 0.001 * t) or s is None
    again = rows_of(spark, df.repartition(5))
    key = lambda r: (str(r["doc_id"]), r["size"], r["n_copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_words(documents, corpus):
    got = documents().select("text", mixing.n_words(F.col("text")).alias("n")).collect()
    assert all(r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got)


def test_documents_as_often_as_taken(spark, documents, clashing):
    df = documents()
    want = sum(r["n_copies"] for r in rows_of(spark, df))
    assert mixing.mix_documents(df).count() == want
    assert mixing.mix_documents(clashing).columns == clashing.columns
    assert mixing.mix_documents(documents([])).count() == 0


def test_only_null_and_empty(documents):
    assert all(r["n_copies"] == 0 for r in rows_of(None, documents([(1, None), (2, "")])))


def test_probabilities_follow_sizes_and_the_number_is_fixed(spark):
    """Over many seeds long documents are taken in proportion to their words, and each stratum gives the same number."""
    sizes = [10] * 60 + [20] * 60 + [40] * 60 + [2000]
    rows = [(k, "w " * n, "a") for k, n in enumerate(sizes)] + [(900 + k, "w " * 100, "b") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = stored(mixing.sized(df), "sizes")
    plan = mixing.strata_plan(sized, share=0.25)
    by = {(r["source"], r["stratum"]): r for r in plan.collect()}
    long_, (small, mid, big) = by["a", 87], (by["a", k] for k in (26, 34, 42))
    assert long_["take"] == long_["n"] == 1  # it would be taken more than once: certain
    expected = [mid["rate"] * 60 * s for s in (10, 20, 40)]
    assert all(abs(x["take"] - e) <= 1.5 for x, e in zip((small, mid, big), expected)) and small["take"] < mid["take"] < big["take"]
    numbers = set()
    for seed in (1, 2, 3):
        stratum = mixing._planned(sized, stored(mixing.mixing_plan(sized, share=0.25, seed=seed), "p"), seed)
        numbers.add(tuple(sorted((r["source"], r["__t"], r["n_"]) for r in stratum.where(mixing._taken()).groupBy("source", "__t").agg(F.count("*").alias("n_")).collect())))
    assert len(numbers) == 1


def test_ties_fall_together_and_ids_of_other_types(spark):
    rows = [("x", "one two three", None)] * 4 + [(None, "four five", None)] * 3 + [(f"d{k}", "w " * 30, "s") for k in range(20)]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    assert sum(r["doc_id"] == "x" for r in out) % 4 == 0 and sum(r["doc_id"] is None for r in out) % 3 == 0


def test_query_columns(spark, documents, corpus, tmp_path):
    rows = [(k, "word " * (5 + k % 40)) for k in range(300)] + [(400, None), (401, "long " * 3000)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op6_source_mixing(spark, str(tmp_path)).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len((dict(rows)[r["doc_id"]] or "").split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = fill(dict(size))
    assert len(got) == len(rows) and all(r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 for r in got)
    assert all(abs(taken[s] - t) <= 3 for s, t in want.items())
