import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, nulls, empty and very long ones, repeated rows and repeated ids."""
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randint(60, 140))) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    near = base[0].split()
    for k in range(6):
        own = list(near)
        own[rng.randrange(len(own))] = f"x{k}"
        rows.append((20 + k, " ".join(own)))
    rows += [(30, base[1]), (31, base[1]), (32, None), (33, ""), (34, " \t\n "), (35, "one"), (36, "one two"), (37, "One  TWO"), (38, "é ü ñ ª"), (40, base[2]), (40, base[2]), (41, base[3]), (41, base[4])]
    rows += [(50, " ".join(words(rng, 30_000))), (51, "ab " * 3000), (52, base[5] + "\n" + base[6]), (None, base[7])]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    def make(rows=None, **more):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en", None if i is None or i % 7 == 0 else f"s{i % 3}", len(t) if t else None) for i, t in (corpus if rows is None else rows)], SCHEMA)
        return df.withColumns({k: F.lit(v) for k, v in more.items()})

    return make


#: Names that operators use inside; a table may have columns of the same names.
CLASHES = {"kept": "a", "node": 1, "row": 2, "v": 0.5, "size": 3, "shard_": 4, "spans": "b", "copies": 7, "target": "t", "rest": 1.5, "word": "x", "start": 9, "distance": 8}


@pytest.fixture(scope="session")
def clashing(documents):
    return documents(**CLASHES)
