"""Exact removal of repeated byte strings by suffix order and longest previous factors.

A window is a string of ``length`` bytes within a document. Windows are compared
within *blocks*: the least 32-byte gram hash in a window (its anchor) is the same
wherever the window stands, so equal windows lie in blocks that share an anchor.

1. Each document is cut into blocks, runs of windows with one anchor. Blocks that
   are equal as a whole repeat all their windows and are counted by Spark.
2. Where an anchor has several different blocks, the first of each is fetched. Their
   suffixes are put in order by prefix doubling, up to ``length`` bytes. The previous
   and the next smaller position in suffix order are the candidates for the longest
   previous factor: a window has an earlier copy if and only if one of them agrees
   with it in ``length`` bytes. Greater positions give the longest next factor in the
   same way, and so the first copies.
3. Anchors with very many different blocks are not sorted in one task: their windows
   are counted by hash instead, spread over all tasks.

Step 1 is what keeps copies from meeting in one task: of a block that stands in
many places one goes into suffix order, and where its factors reach elsewhere is
known already for all of it.

``keep="first"`` removes later copies only; ``keep="none"`` removes every copy.
Strings are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newswell.llm.shared import BROADCAST_BYTES, Step, _powers, clean_names, mix, small_side, steps, stored

LENGTH = 200
GRAM = 32
#: Different blocks of one anchor above which windows are counted by hash instead of sorted in one task.
HOT_BLOCKS = 20_000
#: Bytes of blocks that one suffix sort takes, at least, before it starts.
SORT_BYTES = 2 << 20


def cut_blocks(step: Step, length: int) -> tuple[np.ndarray, ...]:
    """The different blocks of each document: document, anchor hash, block hash, number of windows, bounds of its starts; then all starts.

    Equal blocks of one document, as in text that repeats itself, are one entry with several starts.
    """
    size = len(step.data)
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64)) + (np.zeros(1, np.int64), np.zeros(0, np.int64))
    if size < length:
        return nothing
    total = step.prefix(step.data)
    inverse = _powers(size + 1)[1]
    grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: size - GRAM + 1])
    shift = np.uint64(max(20, int(size).bit_length()))
    least = (grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64)
    want = length - GRAM + 1
    reach = 1
    while reach * 2 <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if want > reach:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    anchor = (least & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    room = np.repeat(step.offsets[1:], np.diff(step.offsets))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= room)
    if not len(at):
        return nothing
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start, last = at[first], at[np.append(first[1:], len(at)) - 1]
    whole = mix((total[last + length] - total[start]) * inverse[start])
    doc = np.searchsorted(step.offsets, start, "right") - 1
    order = np.lexsort((start, whole, doc))
    doc, whole, start, last = doc[order], whole[order], start[order], last[order]
    lead = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])]))
    return doc[lead], grams[anchor[start[lead]]], whole[lead], (last - start + 1)[lead], np.append(lead, len(start)), start - step.offsets[doc]


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length``-byte string at each start, by prefix doubling: equal strings have equal ranks, in byte order."""
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    rank = np.zeros(len(data) + length, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | padded[k : k + len(rank)]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    have = 8
    while have * 2 <= length:
        rank = np.unique(rank[:-have] * np.uint64(len(rank)) + rank[have:], return_inverse=True)[1].astype(np.uint64)
        have *= 2
    if have == length:
        return np.unique(rank[starts], return_inverse=True)[1]
    return np.unique(rank[starts] * np.uint64(len(rank)) + rank[starts + length - have], return_inverse=True)[1]


def smaller_before(position: np.ndarray) -> np.ndarray:
    """For each place of a sequence the nearest place before it with a smaller value, -1 if none."""
    out = np.arange(len(position)) - 1
    wrong = np.flatnonzero(out >= 0)
    while len(wrong):
        wrong = wrong[position[out[wrong]] > position[wrong]]
        out[wrong] = out[out[wrong]]
        wrong = wrong[out[wrong] >= 0]
    return out


def previous_factor_reaches(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether each suffix's longest previous factor is as long as the strings that ``rank`` tells apart.

    Both sequences are in suffix order. The longest match at a smaller position is that with the nearest
    suffix before or after in order that has one.
    """
    before = smaller_before(position)
    after = len(position) - 1 - smaller_before(position[::-1])[::-1]
    out = np.zeros(len(position), bool)
    for other in (before, np.where(after < len(position), after, -1)):
        out |= (other >= 0) & (rank[np.maximum(other, 0)] == rank)
    return out


def repeated(rank: np.ndarray, position: np.ndarray, keep: str) -> np.ndarray:
    """Marks strings to remove: later copies by their previous factors, first ones too by their next factors with ``keep="none"``.

    ``rank`` orders the suffixes, ``position`` their places in the input.
    """
    order = np.lexsort((position, rank))
    r, p = rank[order], position[order]
    out = np.zeros(len(rank), bool)
    out[order] = previous_factor_reaches(r, p)
    if keep == "none":
        out[order] |= previous_factor_reaches(r, -p)
    return out


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


MARKS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("starts", pa.list_(pa.int32())), ("size", pa.int32())])


def _sort_blocks(length: int, keep: str):
    """Task over rows of ``anchor, doc_id, row, start, n, data`` sorted by anchor: marks found by suffix order, some anchors at a time."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        data, n = table.column("data").combine_chunks(), np.asarray(table.column("n"))
        sizes = n + length - 1
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        block = np.repeat(np.arange(len(n)), n)
        starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[block]
        rank = suffix_ranks(raw, starts, length)
        # Places in the input: blocks by document id, row and offset, and windows within.
        order = np.lexsort((np.asarray(table.column("start")), np.asarray(table.column("row")), np.asarray(table.column("doc_id").fill_null(-(1 << 63)))))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        window = starts - begin[block]
        flags = repeated(rank, place[block] * (int(n.max()) + 1) + window, keep)
        rows, start = np.asarray(table.column("row")), np.asarray(table.column("start"))
        a, b = _spans(np.insert(flags, np.cumsum(n)[:-1], False)) if len(n) > 1 else _spans(flags)
        owner = np.searchsorted(np.cumsum(n + 1), a, "right")
        base = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        first = (start[owner] + a - base[owner]).astype(np.int32)
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(owner)), pa.array(rows[owner]), pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32)), pa.array(first)), pa.array((b - a + length - 1).astype(np.int32))], schema=MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = np.asarray(batch.column(0))
            if size >= SORT_BYTES:  # sort what is held, once its last anchor is complete
                other = np.flatnonzero(anchors != held[-1].column(0)[-1].as_py())
                if len(other):
                    held.append(batch.slice(0, int(other[0])))
                    yield solve(pa.Table.from_batches(held))
                    held, size, batch = [], 0, batch.slice(int(other[0]))
            held.append(batch)
            size += batch.column("data").nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``doc_id, row, spans``: for each row of ``doc_id, text, row`` with any, the merged byte ranges to remove, in order. Stored."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, step in steps(batch.column(1)):
                doc, anchor, block, n, bounds, starts = cut_blocks(step, length)
                own = pa.array(doc + at)
                starts = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(starts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), batch.column(0).take(own), batch.column(2).take(own), starts, pa.array(n.astype(np.int32))], names=["anchor", "block", "doc_id", "row", "starts", "n"])

    cut = docs.mapInArrow(blocks, "anchor long, block long, doc_id long, row long, starts array<int>, n int")
    by_anchor, by_block = Window.partitionBy("anchor"), Window.partitionBy("anchor", "block")
    in_order = by_block.orderBy(F.col("doc_id").asc_nulls_first(), "row")
    seen = cut.select("*", F.min("block").over(by_anchor).alias("least"), F.max("block").over(by_anchor).alias("most"), F.sum(F.size("starts")).over(by_block).alias("copies"), F.row_number().over(in_order).alias("nth"))
    seen = stored(seen.where("copies > 1 OR least <> most").select("anchor", "doc_id", "row", "starts", "n", (F.col("copies") > 1).alias("again"), (F.col("least") != F.col("most")).alias("mixed"), "nth"), "suffix-blocks")
    size = (F.col("n") + length - 1).cast("int").alias("size")
    if keep == "first":
        marks = seen.where("nth > 1 OR size(starts) > 1").select("doc_id", "row", F.when(F.col("nth") > 1, F.col("starts")).otherwise(F.slice("starts", F.lit(2), F.size("starts"))).alias("starts"), size)
    else:
        marks = seen.where("again").select("doc_id", "row", "starts", size)

    # The first of each different block, with its bytes. A block with copies elsewhere can still repeat a window of an earlier one.
    firsts = seen.where("mixed AND nth = 1").select("anchor", "doc_id", "row", F.get("starts", F.lit(0)).alias("start"), "n")
    hot = stored(firsts.groupBy("anchor").agg(F.count("*").alias("blocks")).where(F.col("blocks") > HOT_BLOCKS).select("anchor"), "suffix-hot")
    firsts = firsts.join(small_side(hot.withColumn("hot", F.lit(True)), 16), "anchor", "left")
    wanted = stored(firsts.groupBy(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).agg(F.collect_list(F.struct("anchor", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted")), "suffix-wanted")
    fetched = docs.join(wanted, (F.col("row") == F.col("own_row")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("row", "doc_id", "text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = []
                for row, doc_id, text, want in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns)):
                    data = text.encode()
                    rows += [(x["anchor"], doc_id, row, x["start"], x["n"], x["hot"], data[x["start"] : x["start"] + x["n"] + length - 1]) for x in want]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.bool_()), pa.array(c[6], pa.binary())], names=["anchor", "doc_id", "row", "start", "n", "hot", "data"])

    fetched = fetched.mapInArrow(fetch, "anchor long, doc_id long, row long, start int, n int, hot boolean, data binary")
    # Rows of equal id and text are one row here; both copies are marked by their equal blocks.
    usual = fetched.where("NOT hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    marks = marks.unionByName(usual.mapInArrow(_sort_blocks(length, keep), "doc_id long, row long, starts array<int>, size int"))
    if hot.limit(1).count():

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for anchor, doc_id, row, start, n, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "row", "start", "n", "data"))):
                    own = Step(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    at = np.arange(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(own.hashes(at, at + length).view(np.int64)), pa.array([doc_id] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array((start + at).astype(np.int32))], names=["anchor", "window", "doc_id", "row", "start"])

        windows = fetched.where("hot").mapInArrow(split, "anchor long, window long, doc_id long, row long, start int")
        if keep == "first":
            windows = windows.withColumn("nth", F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.col("doc_id").asc_nulls_first(), "row", "start"))).where("nth > 1")
        else:
            windows = windows.withColumn("copies", F.count("*").over(Window.partitionBy("anchor", "window"))).where("copies > 1")
        marks = marks.unionByName(windows.select("doc_id", "row", F.array("start").alias("starts"), F.lit(length).alias("size")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges in batch.column(2).to_pylist():
                own: list[list[int]] = []
                for a, b in sorted((a, a + x["size"]) for x in ranges for a in x["starts"]):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                out.append([x for r in own for x in r])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "row", "spans"])

    grouped = marks.groupBy("doc_id", "row").agg(F.collect_list(F.struct("starts", "size")).alias("ranges"))
    return stored(grouped.mapInArrow(merge, "doc_id long, row long, spans array<int>"), "suffix-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for each row: the byte ranges removed, as starts and ends in turn, and the bytes left.

    Texts are taken as UTF-8; null ones are empty. Texts of fewer than ``length`` bytes lose
    nothing. Repeated rows are copies of each other; with ``keep="first"`` the one that comes
    first by ``doc_id`` stays, null ids before all others, and of rows equal in id and text
    neither can be told from the other and both stay. ``doc_id`` is an integer, or a string of digits;
    other strings are an error. A row is told apart by its id and a 64-bit hash of both. A text may be as
    long as a Spark value; its places are 32-bit. An empty table stays empty. Removal can cut a character
    in two, so ``kept`` is binary.
    """
    docs = clean_names(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    if keep == "first":
        twin = docs.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
        spans = repeated_spans(docs.dropDuplicates(["doc_id", "row"]) if twin.limit(1).count() else docs, length, keep)
    else:
        spans = repeated_spans(docs, length, keep)
    entries = spans.agg(F.coalesce(F.sum(F.size("spans") + 10), F.lit(0))).first()[0]
    spans = spans.withColumnsRenamed({"doc_id": "own_id", "row": "own_row"})
    side = F.broadcast(spans) if entries * 4 <= BROADCAST_BYTES else spans
    joined = docs.join(side, (F.col("row") == F.col("own_row")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sizes, kept = [], []
                for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = text.encode()
                    sizes.append(len(data))
                    bounds = [0, *(own or []), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), part.column(2), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<int>, kept binary")


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), LENGTH, keep="none")
    n_spans = F.coalesce(F.size("spans") / 2, F.lit(0)).cast("bigint")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.greatest(n_spans, F.lit(0)).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
