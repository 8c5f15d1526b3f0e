"""Helpers that several operators share: shared storage, size-checked broadcasts, text hashing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswell.storage import new_folder, stored  # noqa: F401  (operators import both from here)

#: A side of a join is broadcast only when its rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that one vectorised step takes at once; a longer document is a step of its own.
STEP_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- storage


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return new_folder(spark, what)


def small_side(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """``df`` (already stored) marked for broadcast if its size is below the limit; else it is joined by a shuffle.

    The size is that of its strings and binaries, summed, and ``row_bytes`` for the other columns of each row.
    """
    long_ = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    rows = df.agg(F.count("*"), *(F.coalesce(F.sum(F.octet_length(f"`{c}`")), F.lit(0)) for c in long_)).first()
    return F.broadcast(df) if rows[0] * row_bytes + sum(rows[1:]) <= (BROADCAST_BYTES if limit is None else limit) else df


#: Bits, at most, of a test that is sent to all tasks, and bits for each key.
MOST_BITS, KEY_BITS = 1 << 26, 12


def may_hold(keys: DataFrame) -> Callable[[Column], Column]:
    """A test for well mixed 64-bit keys, a column of its own in ``keys`` (already stored): true for all of them and for few others.

    Its size is bounded; with more keys it is true for more others. Rows that it leaves out need no shuffle to be told apart.
    """
    spark, n = keys.sparkSession, keys.count()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(6, (n * KEY_BITS).bit_length()))
    places = F.explode(F.array(*(F.shiftright(F.col(keys.columns[0]), k).bitwiseAND(F.lit(bits - 1).cast("bigint")) for k in (0, 19, 38))))
    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    rows = keys.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(word).alias("m")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def held(key: pd.Series) -> pd.Series:
        k, out = key.to_numpy(np.int64), np.ones(len(key), bool)
        for by in (0, 19, 38):
            at = (k >> by) & (bits - 1)
            out &= (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        return pd.Series(out)

    return held


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is not installed on the path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def clean_names(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that no other column can clash with those an operator adds."""
    return df.select(*(F.col(f"`{c}`") for c in wanted))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if _POWERS.get("n", np.zeros(0)).size < n:
        size = max(n, STEP_BYTES + 1)
        for name, base in (("n", _MULT), ("i", pow(_MULT, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["n"][:n], _POWERS["i"][:n]


class Step:
    """Some whole documents as one run of bytes, with the words found in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.docs = data, offsets, len(offsets) - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask marks."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0], out=total[1:])
        return total

    def spans(self, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of the runs of bytes that ``space`` does not mark; runs end with their document."""
        solid = ~space[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.offsets] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(starts, self.offsets)
        return starts, ends, np.diff(at)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
        total = self.prefix(LOWER[self.data] if lower else self.data)
        inverse = _powers(len(self.data) + 1)[1]
        return mix((total[ends] - total[starts]) * inverse[starts])


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, Step]]:
    """Cut a string column into steps of about ``limit`` bytes; yields the first row of each. Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        own = offsets[row : to + 1]
        yield row, Step(data[own[0] : own[-1]], own - own[0])
        row = to


def windows(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive words that lie in one document, and the position of each one's first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_MULT) + words[k : len(words) - n + 1 + k]
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(len(total)) + n <= ends[: len(total)])
    return mix(total[at]), at


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)


def to_int64(x: np.ndarray) -> pa.Array:
    """Hashes as Spark longs."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
