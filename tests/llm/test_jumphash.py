from pyspark.sql import functions as F

from newswell.llm import jumphash


def jump(key, n):
    key, b, j = (key or 0) % (1 << 64), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_is_the_published_hash(spark):
    keys = [0, 1, 2, 3, 17, 10**9, 10**18, -1, -(1 << 63), (1 << 63) - 1, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 25, 100):
        assert [r[1] for r in df.select("k", jumphash.jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]


def test_growth_moves_rows_into_the_new_shard_only(spark):
    df = spark.range(20_000).select(jumphash.jump_hash(F.col("id"), 24).alias("a"), jumphash.jump_hash(F.col("id"), 25).alias("b"))
    moved = df.where("a <> b")
    assert moved.where("b <> 24").count() == 0 and 500 < moved.count() < 1100


def test_slots_have_no_gaps(documents, clashing, monkeypatch, corpus):
    monkeypatch.setattr(jumphash, "SLOT_ROWS", 5)
    out = jumphash.shard_documents(clashing)
    assert out.columns == [*clashing.columns, "shard", "slot"]
    by = {}
    for r in out.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == len(corpus) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert jumphash.shard_documents(documents([])).count() == 0


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("17",)], "doc_id string")
    got = [tuple(r) for r in jumphash.shard_rows(df, 5).selectExpr("doc_id", "shard", "xxhash64(doc_id)").collect()]
    assert [s for _, s, _ in got] == [jump(None if i is None else h, 5) for i, _, h in got]
    assert jumphash.shard_documents(df.selectExpr("doc_id", "'t' AS text"), 5).count() == 5
    whole = spark.createDataFrame([(17,)], "doc_id int")
    assert jumphash.shard_rows(whole, 24).first()["shard"] == jump(17, 24)


def test_plan_is_native(documents):
    plan = jumphash.shard_documents(documents())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query_columns(spark, documents, tmp_path):
    import zlib

    rows = [(k, f"text {k} é") for k in range(200)] + [(900, None), (901, "")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got, slots = jumphash.op7_jump_sharding(spark, str(tmp_path)).collect(), {}
    for r in got:
        data = (dict(rows)[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25)) and (r["grown_shard"] in (r["shard"], 24))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
