"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. Each text becomes its set of word n-grams, as sorted 64-bit hashes. Texts with
   the same set are one *node*, named by a 64-bit hash of the set; words and n-grams
   are compared by 64-bit hashes too.
2. Candidates. Two sets of sizes x and y with Jaccard similarity t or more differ
   in at most (1 - t) / (1 + t) * (x + y) elements. If the hash range is cut into
   that many segments and one more, some segment holds the same elements in both.
   Sizes are banded so that partners lie in the same or in neighbouring bands, and
   each node gives one key a segment for its own band and for the band below.
   Nodes that share a key belong to one *family*; others can't be linked. Keys are
   dealt into buckets as packed bytes, 40 bits of each, so unlike keys that agree in
   these make a family larger and lose nothing.
3. Tiles. A family's sets, shipped once, are dealt into tiles by size band. Within
   a tile a bitmap of hashed elements bounds each overlap from above by bit counts;
   only pairs that pass are intersected exactly. Pairs already known to be connected
   are skipped, so a group of copies costs a tree of links, not all pairs.
4. Families larger than a tile are first linked tile by tile, each tile together
   with one common pivot of its band. Where that leaves them in several components,
   all pairs of tiles that may hold a link between components are compared as well.

No candidate, group or bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswell.llm.shared import SPACE, clean_names, may_hold, mix, small_side, steps, stored, windows
from newswell.operators.components import components

#: Sets that are compared in one tile, and elements in them.
TILE_ROWS, TILE_ELEMENTS = 4096, 2 << 20
#: Bits of a key that its bucket compares; bytes of text, about, whose keys are one bucket.
LOW_BITS, LOW_BYTES, BUCKET_BYTES = 40, 5, 16 << 20
#: Keys, about, that a task gathers before it packs them; bits of a row's number within such a flush, and of a flush's within a task.
FLUSH_KEYS, ROW_BITS, FLUSH_BITS = 2 << 20, 24, 16
#: Spare segments for each 100 that the bound needs. Each set leaves out so many of its weakest segments.
SPARE_PERCENT = 60


class Bands:
    """Size bands for a similarity of ``percent`` / 100: partners lie at most one band apart."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = percent
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * 100 // percent + 1)
        self.lows = np.array(lows, np.int64)

    def of(self, n):
        return np.searchsorted(self.lows, n, "right") - 1

    def segments(self, band: int) -> tuple[int, int]:
        """Segments for pairs within a band, and of it with the next, and how many of them are spare.

        Differing elements at most, and one more, are needed; the spare ones let each set leave out its weakest.
        """
        most = int(self.lows[band + 1] - 1 + self.lows[band + 2] - 1)
        need = most * (100 - self.percent) // (100 + self.percent) + 1
        spare = need * SPARE_PERCENT // 100
        return need + spare, spare


def shingle_sets(step, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each document; all words as one gram where there are fewer."""
    starts, ends, counts = step.spans(SPACE)
    words = step.hashes(starts, ends, lower=True) if len(starts) else np.zeros(0, np.uint64)
    grams, at = windows(words, counts, n)
    per = np.maximum(counts - n + 1, 0)
    at_word, at_gram = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(per)])
    for k in range(step.docs):
        if 0 < counts[k] < n:
            yield windows(words[at_word[k] : at_word[k + 1]], counts[k : k + 1], int(counts[k]))[0]
        else:
            yield np.unique(grams[at_gram[k] : at_gram[k + 1]])


def set_hash(grams: np.ndarray) -> np.uint64:
    """Name of a set: a sum of its mixed elements, with its size."""
    return mix(np.array([np.sum(mix(grams ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(grams))], np.uint64))[0]


def segment_keys(grams: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """A key for each segment of the hash range, for the groups of the own band and of the band below.

    Equal keys mean equal elements. A partner agrees in one segment more than are spare.
    Each side leaves out as many as are spare, those of the fewest elements and among
    them those of the least hash; the strongest segment in which both agree has all the
    others below it on either side, so neither leaves it out.
    """
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams))])
    out = []
    for group in (band, band - 1):
        if group < 0:
            continue
        m, spare = bands.segments(group)
        bounds = (np.arange(1, m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m)).astype(np.uint64)
        cut = np.concatenate([[0], np.searchsorted(grams, bounds), [len(grams)]])
        sums = mix((total[cut[1:]] - total[cut[:-1]]) ^ mix(np.arange(m, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(group + 1)))
        out.append(sums[np.lexsort((sums, np.diff(cut)))[spare:]])
    return np.concatenate(out)


def row_key() -> Column:
    """Key of a row by id and text, where an id may be null or stand for several texts. Rows alike in both share it."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def _packed(refs: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Places in a flush, in order, and the lowest 40 bits of their keys as bytes."""
    steps_ = pa.compress(np.diff(refs, prepend=0).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
    return len(refs).to_bytes(8, "little") + steps_, np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]).tobytes()


def _unpacked(refs: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(refs[:8], "little")
    places = np.cumsum(np.frombuffer(pa.decompress(refs[8:], 4 * n, codec="zstd", asbytes=True), np.uint32), dtype=np.int64)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :LOW_BYTES] = np.frombuffer(keys, np.uint8).reshape(n, LOW_BYTES)
    return places, whole.reshape(-1).view("<u8")


def _hubs(values: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the least reference of each value stands, and pairs, each once, of another with the value and that one."""
    order = np.lexsort((refs, values))
    values, refs = values[order], refs[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    hub = refs[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(values) else refs
    rest = ~first & (refs != hub)
    one, hub = refs[rest], hub[rest]
    order_ = np.lexsort((hub, one))
    one, hub = one[order_], hub[order_]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (hub[1:] != hub[:-1])
    return order[first], one[new], hub[new]


def _flushed(flush: int, buckets: int, keys: list[np.ndarray], rows: list[np.ndarray]) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """``bucket, flush, refs, keys, pairs`` of the keys of some rows; a key that many of them have goes on once, with their pairs."""
    values, refs = np.concatenate(keys), np.concatenate(rows)
    bucket = (values >> np.uint64(LOW_BITS)) % np.uint64(buckets)
    values = (bucket << np.uint64(LOW_BITS)) | (values & np.uint64((1 << LOW_BITS) - 1))
    at, one, hub = _hubs(values, refs)
    values, refs = values[at], refs[at]
    order = np.lexsort((refs, values >> np.uint64(LOW_BITS)))
    values, refs = values[order], refs[order]
    bucket = (values >> np.uint64(LOW_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    shares = np.array_split(np.stack([one, hub], 1).astype(np.int64), len(cuts) + 1)
    for low, high, own in zip([0, *cuts], [*cuts, len(values)], shares):
        yield int(bucket[low]), flush, *_packed(refs[low:high], values[low:high]), own.tobytes()


def _node_rows(docs: DataFrame, n: int, bands: Bands, kind: str, buckets: int) -> DataFrame:
    """``doc_id, row_key, node, n_shingles, ref`` of each row, with no node where there is no word; and their keys, as ``bucket, flush, refs, keys, pairs``.

    Rows are numbered by flushes, and within one; a flush is what a task gathers before it packs its keys.
    """
    schema = f"doc_id {kind}, row_key long, node long, n_shingles long, ref long, bucket int, flush long, refs binary, keys binary, pairs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, part = None, TaskContext.get().partitionId()
        flush, row_of, todo, owners, waiting = part << FLUSH_BITS, 0, [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            all_ = _flushed(flush, buckets, todo, owners)
            while some := list(islice(all_, 256)):
                columns = [pa.array(x, f.type) for x, f in zip(zip(*some), list(fields)[5:])]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), f.type) for f in list(fields)[:5]), *columns], schema=fields)

        for batch in batches:
            fields = fields or pa.schema([("doc_id", batch.column(0).type), *((c, pa.int64()) for c in ("row_key", "node", "n_shingles", "ref")), ("bucket", pa.int32()), ("flush", pa.int64()), *((c, pa.binary()) for c in ("refs", "keys", "pairs"))])
            for row, step in steps(batch.column(1)):
                if waiting >= FLUSH_KEYS or row_of + step.docs > 1 << ROW_BITS:
                    yield from packed()
                    flush, row_of, todo, owners, waiting = flush + 1, 0, [], [], 0
                nodes, sizes = [], []
                for k, grams in enumerate(shingle_sets(step, n)):
                    sizes.append(len(grams))
                    nodes.append(set_hash(grams) if len(grams) else np.uint64(0))
                    if len(grams):
                        own = segment_keys(grams, int(bands.of(len(grams))), bands)
                        todo.append(own)
                        owners.append(np.full(len(own), row_of + k, np.int64))
                        waiting += len(own)
                sizes = np.array(sizes, np.int64)
                nodes = pa.array(np.array(nodes, np.uint64).view(np.int64), mask=sizes == 0)
                refs = pa.array((flush << ROW_BITS) + row_of + np.arange(step.docs))
                rest = [pa.nulls(step.docs, f.type) for f in list(fields)[5:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, step.docs), batch.column(2).slice(row, step.docs), nodes, pa.array(sizes), refs, *rest], schema=fields)
                row_of += step.docs
        if todo:
            yield from packed()

    return docs.mapInArrow(run, schema)


def _shared_keys(packed: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of rows (``ref``) that reach all rows with a key in common."""

    def run(table: pa.Table) -> pa.Table:
        values, refs, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for flush, places, keys, own in zip(*(table.column(c).to_pylist() for c in ("flush", "refs", "keys", "pairs"))):
            places, low = _unpacked(places, keys)
            values.append(low)
            refs.append((flush << ROW_BITS) + places)
            pairs.append((flush << ROW_BITS) + np.frombuffer(own, np.int64).reshape(-1, 2))
        _, one, hub = _hubs(np.concatenate(values), np.concatenate(refs))
        both = np.concatenate([np.stack([one, hub], 1), *pairs])
        return pa.table({"u": pa.array(both[:, 0]), "v": pa.array(both[:, 1])})

    return packed.groupBy("bucket").applyInArrow(run, "u long, v long")


def tile_links(sets: list[np.ndarray], known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (positions) that join components of one tile; ``known`` numbers those that are connected already."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    known = known[order].copy()
    bits = 256
    while bits < 2 * sizes[-1] and bits < 1 << 15:
        bits *= 2
    maps = np.zeros((len(order), bits // 64), np.uint64)
    for row, k in enumerate(order):
        spot = mix(sets[k]) & np.uint64(bits - 1)
        np.bitwise_or.at(maps[row], (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    links = []
    for i in range(len(order) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        others = np.arange(i + 1, last)
        others = others[known[others] != known[i]]
        if not len(others):
            continue
        only_i = np.bitwise_count(maps[i] & ~maps[others]).sum(axis=1).astype(np.int64)
        only_j = np.bitwise_count(maps[others] & ~maps[i]).sum(axis=1).astype(np.int64)
        most = np.minimum(sizes[i] - only_i, sizes[others] - only_j)
        others = others[100 * most >= percent * (sizes[i] + sizes[others] - most)]
        for j in others:
            if known[j] == known[i]:
                continue
            a, b = sets[order[i]], sets[order[j]]
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                links.append((int(order[i]), int(order[j])))
                known[known == known[j]] = known[i]
    return links


def _compare(dealt: DataFrame, percent: int) -> DataFrame:
    """For the tiles of ``tile, node, known, grams``: each node ``a`` that links reach and the least node ``b`` that they reach in the tile."""

    def run(table: pa.Table) -> pa.Table:
        nodes = np.asarray(table.column("node"))
        _, first = np.unique(nodes, return_index=True)
        raw, known = table.column("grams").take(pa.array(first)), np.asarray(table.column("known"))[first]
        nodes = nodes[first]
        links = tile_links([np.frombuffer(x.as_buffer(), np.uint64) for x in raw], known, percent)
        root = np.arange(len(nodes))  # nodes are in order, so the least place of a component is its least node
        for i, j in links:
            low, high = sorted((root[i], root[j]))
            root[root == high] = low
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[moved]), "b": pa.array(nodes[root[moved]])})

    return dealt.groupBy("tile").applyInArrow(run, "a long, b long")


def _with_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``wanted`` rows (``row_key, node, ...``, one a node) with the sets of their documents as bytes."""
    rest = [c for c in wanted.columns if c not in ("row_key", "node")]
    side = small_side(wanted, 64)
    # Where the side is too large to be sent, texts of other rows are left out before the shuffle.
    some = docs.where(may_hold(wanted.select("row_key"))("row_key")) if side is wanted else docs
    joined = some.join(side, "row_key").select("text", "node", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, step in steps(batch.column(0)):
                grams = list(shingle_sets(step, n))
                own = batch.slice(row, step.docs)
                right = np.array([len(g) > 0 and int(set_hash(g).astype(np.int64)) == v for g, v in zip(grams, own.column(1).to_pylist())], bool)
                out = pa.RecordBatch.from_arrays([*own.columns[1:], pa.array([g.tobytes() for g in grams], pa.binary())], names=["node", *rest, "grams"])
                yield out.filter(pa.array(right))  # another text may share a key

    return joined.mapInArrow(run, ", ".join(["node long", *(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in rest), "grams binary"]))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the least ``doc_id`` that links reach.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of
    lower-cased (A-Z) word ``n``-grams. Rows with fewer than ``n`` words have all their
    words as one gram; rows without words, null texts included, have none and link with
    nothing. Equal rows, and rows with equal ``doc_id``, each give a row. A null
    ``doc_id`` counts as larger than any other; ids may be of any type that has an order.
    A text of any length gives its whole set. An empty table gives an empty result.
    """
    return _row_groups(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def _row_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The columns of ``similar_groups``, with each row's ``row_key`` and that of its group's first row (least ``doc_id``, then key) as ``first_key``, null without words."""
    docs = clean_names(docs, "doc_id", "text").withColumn("row_key", row_key())
    kind = docs.schema["doc_id"].dataType.simpleString()
    bands = Bands(percent)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt_rows = stored(_node_rows(docs, n, bands, kind, min(1 << 20, size // BUCKET_BYTES + 1)), "jaccard-rows")
    rows = dealt_rows.where("bucket IS NULL").select("doc_id", "row_key", "node", "n_shingles", "ref")
    worded = rows.where("node IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    nodes = stored(worded.groupBy("node").agg(F.min(place).alias("x"), F.max("n_shingles").alias("size"), F.min("ref").alias("ref")).select("node", "x.doc_id", "x.row_key", "size", "ref"), "jaccard-nodes")

    # Families: all nodes that share keys, through the first row of each key. Rows of one node are tied to its first.
    pairs = _shared_keys(dealt_rows.where("bucket IS NOT NULL").select("bucket", "flush", "refs", "keys", "pairs"))
    copies = worded.select("node", F.col("ref").alias("u")).join(nodes.select("node", F.col("ref").alias("v")), "node").where("u <> v").select("u", "v")
    found = components(pairs.unionByName(copies), "u", "v").select(F.col("node").alias("ref"), F.col("component").alias("family"))
    found = stored(nodes.select("ref", "node").join(found, "ref").select("node", "family"), "jaccard-families")
    families = found.join(found.groupBy("family").agg(F.count("*").alias("members")).where("members > 1").select("family"), "family", "left_semi")
    families = stored(families, "jaccard-families")
    fits = (F.col("members") <= TILE_ROWS) & (F.col("elements") <= TILE_ELEMENTS)
    sizes = families.join(nodes, "node").groupBy("family").agg(F.count("*").alias("members"), F.sum("size").alias("elements"))
    large = small_side(stored(sizes.where(~fits).select("family"), "jaccard-large"), 8)
    lows = F.array(*(F.lit(int(x)) for x in bands.lows if x <= 1 << 40))
    banded = F.size(F.filter(lows, lambda x: x <= F.col("size"))) - 1

    # Tiles: a small family is one; a large one is dealt by band and hash, with a pivot in each.
    big = families.join(large, "family", "left_semi").join(nodes, "node").withColumn("band", banded)
    dealt = big.groupBy("family", "band").agg(F.greatest(F.ceil(F.count("*") / (TILE_ROWS // 2)), F.ceil(F.sum("size") / (TILE_ELEMENTS // 2))).cast("int").alias("salts"), F.min("node").alias("pivot"))
    big = big.join(dealt, ["family", "band"]).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.col("salts")).cast("int"))
    big = stored(big, "jaccard-big")
    tile_of = lambda *c: F.xxhash64(*c)
    small = families.join(large, "family", "left_anti").join(nodes, "node").select("row_key", "node", F.array(tile_of("family")).alias("tiles"), F.col("node").alias("known"))
    plain = tile_of("family", "band", "salt")
    below = big.groupBy("family", F.col("band").alias("below")).agg(F.max("salts").alias("salts_below"))
    pivots = big.withColumn("below", F.col("band") - 1).join(below, ["family", "below"], "left")
    others = lambda band, salts: F.transform(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1), lambda s: F.xxhash64("family", band, s))
    everywhere = F.array_distinct(F.concat(F.array(plain), F.when(F.col("node") == F.col("pivot"), F.concat(others(F.col("band"), F.col("salts")), F.when(F.col("salts_below").isNotNull(), others(F.col("below"), F.col("salts_below"))).otherwise(F.array().cast("array<long>")))).otherwise(F.array().cast("array<long>"))))
    first = small.unionByName(pivots.select("row_key", "node", everywhere.alias("tiles"), F.col("node").alias("known")))
    first = stored(first, "jaccard-tiles")
    links = stored(_compare(_with_sets(docs, first, n).withColumn("tile", F.explode("tiles")).drop("tiles"), percent), "jaccard-links")
    linked = stored(components(links), "jaccard-linked")

    # Large families that are not yet one component: every pair of tiles that may hold a link.
    if big.limit(1).count():
        state = stored(big.join(linked, "node", "left").withColumn("known", F.coalesce("component", "node")), "jaccard-state")
        open_ = state.groupBy("family").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x <> y").select("family")
        major = state.groupBy("family", "known").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("major"))
        state = stored(state.join(open_, "family", "left_semi").join(major, "family").withColumn("minor", F.col("known") != F.col("major")), "jaccard-open")
        if state.limit(1).count():
            # Tiles of the rows outside the largest component, against all tiles of their band and its neighbours.
            grid = stored(state.groupBy("family", "band", "salt").agg(F.max("minor").alias("minor")), "jaccard-grid")
            left, right = grid.where("minor").select("family", F.col("band").alias("b1"), F.col("salt").alias("s1")), grid.select("family", F.col("band").alias("b2"), F.col("salt").alias("s2"))
            near = left.select("*", F.explode(F.array(F.col("b1") - 1, F.col("b1"), F.col("b1") + 1)).alias("b2")).join(right, ["family", "b2"])
            near = near.select("family", "b1", "s1", "b2", "s2", F.xxhash64("family", "b1", "s1", "b2", "s2").alias("tile"))
            sides = near.select("family", F.col("b1").alias("band"), F.col("s1").alias("salt"), "tile").unionByName(near.select("family", F.col("b2").alias("band"), F.col("s2").alias("salt"), "tile")).distinct()
            tiles = sides.groupBy("family", "band", "salt").agg(F.collect_set("tile").alias("tiles"))
            second = stored(state.join(tiles, ["family", "band", "salt"]).select("row_key", "node", "tiles", "known"), "jaccard-second")
            more = _compare(_with_sets(docs, second, n).withColumn("tile", F.explode("tiles")).drop("tiles"), percent)
            bridges = second.where("known <> node").select(F.col("node").alias("a"), F.col("known").alias("b"))
            linked = stored(components(links.unionByName(more).unionByName(bridges)), "jaccard-linked")

    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min(place).alias("x")).select("component", F.col("x.doc_id").alias("component_id"), F.col("x.row_key").alias("first_key"))
    names = stored(named.select("node", "component").join(firsts, "component").select("node", "component_id", "first_key"), "jaccard-names")
    out = rows.select("doc_id", "row_key", "n_shingles", "node").join(small_side(names, 40), "node", "left")
    return out.select("doc_id", "row_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "first_key")


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, that with the least ``doc_id``, with the columns of ``docs``.

    Rows are told apart by id and text: of texts that share an id, only those that are near copies of
    another row go, and of repeated rows one stays. Rows without words are no copies and all stay.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    groups = stored(_row_groups(docs, n, percent).where("n_shingles > 0").select(F.col("row_key").alias(key), "first_key"), "jaccard-groups")
    gone = stored(groups.where(F.col(key) != F.col("first_key")).select(key).distinct(), "jaccard-gone")
    again = stored(groups.where(F.col(key) == F.col("first_key")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "jaccard-again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, row_key())
    side, more = small_side(gone, 16), again.limit(1).count() > 0
    if side is not gone:
        sure, some = None, keyed
    else:  # too many to be sent: only rows that may be among them are shuffled
        held = may_hold(stored(gone.unionByName(again), "jaccard-either"))
        sure, some = keyed.where(~held(key)), keyed.where(held(key))
    kept = some.join(side, key, "left_anti")
    if more:
        again = small_side(again, 16)
        once = kept.join(again, key, "left_semi").dropDuplicates([key])
        kept = kept.join(again, key, "left_anti").select(*columns).unionByName(once.select(*columns))
    return kept.select(*columns) if sure is None else sure.select(*columns).unionByName(kept.select(*columns))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
g AS (SELECT doc_id, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM u WHERE n >= 3 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, a || ' ' || b || ' ' || c AS x FROM g WHERE c IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
o AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN rare USING (x) JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * k >= 90 * (za.n + zb.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, m.c), d.doc_id) AS component_id
FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
