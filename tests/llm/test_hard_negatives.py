import math
import random

import duckdb
import numpy as np
import pytest
from newswell.llm import hard_negatives as hn
from newswell.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    sound = [(k, i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * float(np.float32(x))) for x in v]) for k, (i, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, label, v in sound:
        if i is None or i % 50:
            continue
        scored = sorted(((-dot(v, w), last(j), j, l) for m, j, l, w in sound if m != k), key=lambda x: x[:2])
        for s, _, j, _ in [x for x in scored if x[3] == label][:5]:
            fit = [x for x in scored if x[3] != label and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out += [(i, j, r, x[2], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=lambda x: tuple((y is None, y or 0) for y in x))


def made(n, dims, seed=1, spread=0.6):
    """Groups of vectors, so that positives and negatives mix; copies, ties and odd rows among them."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for k in range(n):
        c = rng.randrange(6)
        v = [x + rng.gauss(0, spread) for x in centres[c]]
        size = math.sqrt(sum(x * x for x in v))
        rows.append((k, [x / size for x in v], rng.choice((c, c, c, rng.randrange(10)))))
    return rows


def check(spark, rows, dims=None):
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=lambda x: tuple((y is None, y or 0) for y in x)) == brute(rows)
    return got


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELL_ROWS", 4)
    monkeypatch.setattr(hn, "RUN_ROWS", 16)
    rows = made(600, 9)
    rows += [(i, rows[3][1], 3) for i in range(1000, 1100)] + [(50, rows[50][1], rows[50][2]), (None, rows[3][1], 4), (None, rows[0][1], 2), (2000, None, 1), (2050, [1.0, None] + [0.0] * 7, 1), (2100, [float("nan")] * 9, 1), (2150, [0.1] * 9, None), (2200, [0.0] * 9, 5), (2201, [0.0] * 9, 5), (2202, [0.0] * 9, 6), (2250, [0.5, 0.5], 1)]
    assert len(check(spark, rows)) > 50


def test_large_components_and_one_dimension(spark):
    rng = random.Random(4)
    check(spark, [(k, [rng.uniform(-1, 1) * 10**4 for _ in range(5)], k % 3) for k in range(200)])
    check(spark, [(k, [float(k % 11)], k % 3) for k in range(120)])
    assert len(check(spark, [(50 * k, [1e30, 1.0], 1) for k in range(1)])) == 0


def test_empty_and_odd_tables(spark):
    for rows in ([], [(0, None, 1)], [(0, [], 1)], [(0, [1.0], 1)]):
        assert hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).count() == 0
    from pyspark.sql import functions as F

    rows = made(120, 4)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit("x"), "row": F.lit(1), "cell": F.lit(2)})
    assert hn.hard_negatives(more).count() == len(brute(rows))


def test_bounds_hold_and_search_stops_early(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-200, 200, (500, 8)).astype(np.float64)
    codes = hn.fit_codes(x[:, :4], 8), hn.fit_codes(x[:, 4:], 8)
    of = [hn.nearest(p, c) for p, c in zip((x[:, :4], x[:, 4:]), codes)]
    radii = tuple(np.array([max([0.0, *np.sqrt(((p - c[k]) ** 2).sum(axis=1))[o == k]]) for k in range(len(c))]) for p, c, o in zip((x[:, :4], x[:, 4:]), codes, of))
    index = hn.Index.__new__(hn.Index)
    index.codes, index.radii, index.runs = codes, radii, {int(k): [] for k in of[0] * len(codes[1]) + of[1]}
    q = x[0]
    seen = list(index.visit(q))
    assert [h for h, *_ in seen] == sorted((h for h, *_ in seen), reverse=True) and {c for *_, c in seen} == set(index.runs)
    for high, low, cell in seen:
        scores = x[of[0] * len(codes[1]) + of[1] == cell] @ q
        assert (scores <= high).all() and (scores >= low).all()
    assert len(list(index.visit(q, seen[5][0]))) < len(seen)


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query_equals_sql(spark, folder):
    got = queries()["op12_hard_negatives"](spark, f"/root/testdata/{folder}").toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{folder}/embeddings.parquet'")
    want = c.execute(hn.OP12_SQL).df()
    assert list(got.columns) == list(want.columns)
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(got)
