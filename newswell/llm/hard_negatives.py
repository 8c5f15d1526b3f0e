"""Hard negatives by an inverted multi-index over quantised vectors; results are exact.

Each half of a vector has a codebook, and a pair of codes is a cell. The vectors of the
cells lie in files; a list of the runs in them says where. For an anchor, each code of a half
bounds the half's part of the score: inner product with the code, plus the length of
the anchor's half times the largest distance of a vector from that code. A heap visits cells in
the order of the summed bounds (multi-sequence), and the search ends when no further cell
can change what was found: the positives first, then the windows below their scores.

Codebooks are fitted on a bounded sample of rows; all rows are indexed, and the bounds hold for
all of them, so the sample changes the time alone.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.llm.shared import clean_names, scratch, stored

#: Rows, at most, on which codebooks are fitted, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 16_384, 8
#: Codes of each half, at most; vectors of a cell, about; vectors, at most, that are read as one run.
MOST_CODES, CELL_ROWS, RUN_ROWS = 256, 200, 1 << 14
#: Anchors that one task searches for, about, and bytes of vectors that it remembers.
TASK_ANCHORS, CACHE_BYTES = 256, 64 << 20
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these parts in 100 of its positive's.
LEAST, MOST = 50, 95
#: Components beyond this are taken as this, so that scores of up to 2,048 components fit into 64 bits.
LARGEST = 1 << 26


def fit_codes(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``n`` groups at most: those farthest apart first, then rounds of averaging."""
    centres = [x[0]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < n and far.max() > 0:
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        of = nearest(x, c)
        size = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    size = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None] < size[:, None]] = np.asarray(column.flatten())
    return out


class Index:
    """The cells of an index as a task reads them."""

    def __init__(self, manifest: str, codes: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray], dims: int, width: int, exact: type):
        self.codes, self.radii, self.dims, self.width, self.exact = codes, radii, dims, width, exact
        store, folder = pafs.FileSystem.from_uri(manifest)
        names = [f.path for f in store.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")]
        self.runs: dict[int, list[tuple]] = {}
        for name in sorted(names):
            for cell, path, at, n in zip(*(c.to_pylist() for c in pq.read_table(name, filesystem=store).select(["cell", "path", "at", "n"]).columns)):
                self.runs.setdefault(cell, []).append((path, at, n))
        self.seen: OrderedDict = OrderedDict()
        self.held = 0

    def run(self, path: str, at: int, n: int) -> tuple[np.ndarray, ...]:
        """Row, id, label and vectors of one run."""
        found = self.seen.pop((path, at), None)
        if found is None:
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                data = f.read_at(n * (24 + self.width * self.dims), at)
            row, number, label = np.frombuffer(data, "<i8", 3 * n).reshape(3, n)
            vectors = np.frombuffer(data, f"<i{self.width}", n * self.dims, 24 * n).reshape(n, self.dims).astype(self.exact)
            found = row, number, label, vectors
            self.held += vectors.nbytes
            while self.held > CACHE_BYTES and self.seen:
                self.held -= self.seen.popitem(last=False)[1][3].nbytes
        self.seen[path, at] = found
        return found

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and greatest score that each code of a half allows, with room for rounding."""
        low, high = [], []
        half = self.codes[0].shape[1]
        for part, c, r in zip((q[:half].astype(np.float64), q[half:].astype(np.float64)), self.codes, self.radii):
            middle, reach = c @ part, np.sqrt((part**2).sum()) * r
            room = 1e-9 * (np.abs(middle) + reach) + 1e-3
            low.append(middle - reach - room)
            high.append(middle + reach + room)
        return low, high

    def visit(self, q: np.ndarray, floor: float = -np.inf) -> Iterator[tuple[float, float, int]]:
        """Greatest and least score and number of the cells that hold rows, the greatest first, until none reaches ``floor``."""
        (low1, low2), (high1, high2) = self.bounds(q)
        one, two = np.argsort(-high1, kind="stable").tolist(), np.argsort(-high2, kind="stable").tolist()
        high1, high2, low1, low2 = high1.tolist(), high2.tolist(), low1.tolist(), low2.tolist()
        heap = [(-(high1[one[0]] + high2[two[0]]), 0, 0)]
        n = len(two)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < floor:
                return
            # A cell's neighbours follow it: the next of the second half, and, from the first column, the next of the first.
            if j + 1 < n:
                heapq.heappush(heap, (-(high1[one[i]] + high2[two[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(high1[one[i + 1]] + high2[two[0]]), i + 1, 0))
            cell = one[i] * n + two[j]
            if cell in self.runs:
                yield -bound, low1[one[i]] + low2[two[j]], cell


class _Best:
    """The first rows by score and id, at most ``most``."""

    def __init__(self, most: int):
        self.most, self.rows = most, []

    def least(self) -> float:
        return self.rows[-1][0] if len(self.rows) == self.most else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = scores >= self.least()
        if keep.any():
            scores, ids, rows = scores[keep], ids[keep], rows[keep]
            first = np.lexsort((rows, ids, -scores))[: self.most]
            new = list(zip(scores[first].tolist(), ids[first].tolist(), rows[first].tolist()))
            self.rows = sorted(self.rows + new, key=lambda x: (-x[0], x[1], x[2]))[: self.most]


#: Stands for a null id: after all others, as ids of vectors are less.
_NO_ID = (1 << 63) - 1


def mine(index: Index, row: int, label: int, q: np.ndarray, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> Iterator[tuple]:
    """``positive id, rank, negative id, positive score, negative score`` of one anchor."""
    q = q.astype(index.exact)
    found = _Best(positives)
    for high, _, cell in index.visit(q):
        if high < found.least():
            break
        for run in index.runs[cell]:
            rows, ids, labels, vectors = index.run(*run)
            own = (labels == label) & (rows != row)
            if own.any():
                found.add((vectors[own] @ q).astype(np.int64), ids[own], rows[own])
    windows = [(s, i, -(-least * s // 100), most * s // 100, _Best(negatives)) for s, i, _ in found.rows]
    open_ = [w for w in windows if w[2] <= w[3]]
    if open_:
        top = max(w[3] for w in open_)
        for high, low, cell in index.visit(q, min(w[2] for w in open_)):
            if all(high < max(w[2], w[4].least()) for w in open_):
                break
            if low > top:
                continue
            for run in index.runs[cell]:
                rows, ids, labels, vectors = index.run(*run)
                scores = (vectors @ q).astype(np.int64)
                other = labels != label
                for _, _, a, b, best in open_:
                    own = other & (scores >= max(a, best.least())) & (scores <= b)
                    if own.any():
                        best.add(scores[own], ids[own], rows[own])
    for score, i, _, _, best in windows:
        for rank, (s, k, _) in enumerate(best.rows, 1):
            yield i, rank, k, score, s


def quantise(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v``: labels as they count, components as whole numbers; rows that take no part are left out."""
    v = clean_names(vectors, "vec_id", "embedding", "label")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * 256))).cast("bigint"))
    number, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    return v.where(sound).select(number.alias("vec_id"), F.when(number % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("v"))


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the anchors, whose ``vec_id`` is divisible by ``every``.

    Rows with a null label, a null vector or a component that is null, NaN or infinite take no part. A null ``vec_id``
    makes no anchor and comes after all others among equal scores. Repeated rows are rows of their own: an
    anchor's copy can be its positive, and each copy of an anchor is an anchor. Missing components
    count as 0; those beyond ``LARGEST`` in amount as ``LARGEST``. Positives with a score below 0 have no
    window. Other columns are not looked at; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(quantise(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    n, dims, largest, length = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(square)).first()
    if not n or not dims:
        return spark.createDataFrame([], out)
    width = 2 if largest < 1 << 15 else 4
    exact = np.float32 if length < 1 << 24 else np.float64 if length < 1 << 53 else np.int64
    codes_wanted = max(1, min(MOST_CODES, 1 << max(0, round(np.log2(np.sqrt(n / CELL_ROWS))))))
    place = F.xxhash64("row")
    some = rows if n <= SAMPLE_ROWS else rows.where(F.pmod(place, F.lit(n)) < 2 * SAMPLE_ROWS)
    sample = _matrix(some.orderBy(place, "row").limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks(), dims).astype(np.float64)
    half = -(-dims // 2)
    codes = fit_codes(sample[:, :half], codes_wanted), fit_codes(sample[:, half:], codes_wanted) if half < dims else np.zeros((1, 0))
    kind = f"<i{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            parts = x[:, :half].astype(np.float64), x[:, half:].astype(np.float64)
            of = [nearest(p, c) for p, c in zip(parts, codes)]
            far = [np.sqrt(((p - c[k]) ** 2).sum(axis=1)) for p, c, k in zip(parts, codes, of)]
            data = x.astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in data], pa.binary()), *(pa.array(k, pa.int32()) for k in of), *map(pa.array, far)], names=["row", "vec_id", "label", "v", "c1", "c2", "r1", "r2"])

    coded = stored(rows.select("vec_id", "label", "v", "row").mapInArrow(encode, "row long, vec_id long, label long, v binary, c1 int, c2 int, r1 double, r2 double").withColumn("cell", F.col("c1") * len(codes[1]) + F.col("c2")), "coded-vectors")
    radii = []
    for c, (name, far) in zip(codes, (("c1", "r1"), ("c2", "r2"))):
        own = np.zeros(len(c))
        for k, r in coded.groupBy(name).agg(F.max(far)).collect():  # a row a code
            own[k] = r
        radii.append(own)
    # Cells of many rows are dealt in runs of a bounded size; there are MOST_CODES ** 2 cells at most.
    runs = coded.groupBy("cell").agg(F.ceil(F.count("*") / RUN_ROWS).cast("int").alias("runs"))
    dealt = coded.join(F.broadcast(runs), "cell").select("cell", F.pmod(F.xxhash64("row"), F.col("runs")).cast("int").alias("run"), "row", "vec_id", "label", "v")
    folder = scratch(spark, "multi-index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        told, at, key, held, file = [], 0, None, [], None

        def close():
            nonlocal at
            table = pa.Table.from_batches(held)
            data = b"".join((*(np.asarray(table[c].fill_null(_NO_ID)).astype("<i8").tobytes() for c in ("row", "vec_id", "label")), *table["v"].to_pylist()))
            file.write(data)
            told.append((key[0], f"{folder}/{name}", at, table.num_rows))
            at += len(data)

        for batch in batches:
            pair = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
            cuts = [0, *(np.flatnonzero((np.diff(pair) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                new = tuple(pair[:, low].tolist())
                if new != key:
                    if held:
                        close()
                    key, held = new, []
                    file = file or store.open_output_stream(os.path.join(base, name))
                held.append(batch.slice(low, high - low))
        if held:
            close()
        if file:
            file.close()
            columns = list(zip(*told))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["cell", "path", "at", "n"])

    manifest = scratch(spark, "multi-index-runs")
    files = max(1, min(n // RUN_ROWS, 1 << 14))
    dealt.repartition(files, "cell", "run").sortWithinPartitions("cell", "run").mapInArrow(write, "cell int, path string, at long, n long").write.parquet(manifest)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from newswell.llm.hard_negatives import Index as Cells
        from newswell.llm.hard_negatives import mine as search_one

        index = None
        for batch in batches:
            index = index or Cells(manifest, codes, tuple(radii), dims, width, exact)
            for row, number, label, v in zip(*(c.to_pylist() for c in batch.columns)):
                got = [(number, *x) for x in search_one(index, row, label, np.frombuffer(v, kind), positives, negatives, least, most)]
                if got:
                    a, p, rank, k, s, t = zip(*got)
                    ids = [pa.array([None if i == _NO_ID else i for i in x], pa.int64()) for x in (p, k)]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), ids[0], pa.array(rank, pa.int32()), ids[1], pa.array(s, pa.int64()), pa.array(t, pa.int64())], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    anchors = coded.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v", "cell")
    tasks = max(spark.sparkContext.defaultParallelism, n // every // TASK_ANCHORS)
    # Neighbours in the order of cells want the same cells, which their task remembers.
    return anchors.repartitionByRange(tasks, "cell", "row").drop("cell").mapInArrow(search, out)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS r
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.r AS br, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT p.r, p.k, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND p.k <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
