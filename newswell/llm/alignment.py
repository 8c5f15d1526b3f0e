"""Two tokenizers side by side: which tokens of one cover which bytes of the other, over all texts.

Texts are shuffled by their whole content, so that equal ones are tokenised and aligned
once and weigh as often as they occur. Offsets where both tokenizers end a token cut a
text into groups; between two neighbouring ends of either one, exactly one pair of tokens
overlaps, so the links of a text are the gaps of the merged offsets.

Different texts are aligned in blocks of a few megabytes. A block names each of its id
pairs once with its weight; the weights are summed over all blocks, and each block gets the
sums of its own pairs back (a join on the pair, then on the block), so no task holds the
pairs of the corpus. Both tokenizers see each different word of a column once: one cuts
words by its own pattern, and the other has no token in which a blank follows another
character, so texts can be cut before blanks.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.llm.bitpack import gather
from newswell.llm.shared import Step, clean_names, steps, stored
from newswell.llm.token_counts import TokenCounter, byte_alphabet, distinct, parts

#: Bytes of text, about, that are aligned as one block.
BLOCK_BYTES = 4 << 20
#: Words, at most, of which a Python worker remembers the ids in each of two generations.
CACHE_WORDS = 200_000
#: Texts with so many copies that they are joined by broadcast: at most this many, each with more copies than ``rows / MOST_HOT``, and more than ``LEAST_HOT``.
MOST_HOT, LEAST_HOT = 50_000, 100

_BLANK = "▁"


class _Side:
    """One tokenizer: ids of all words of a step, and bytes of each id."""

    def __init__(self, strings: list[bytes], encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode, self.new, self.old = encode, {}, {}
        self.bytes = strings
        self.sizes = np.array([len(x) for x in strings], np.int64)

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit integers; one more byte follows where they do not spell it."""
        found = list(map(self.new.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing and self.old:
            for k in missing:
                found[k] = self.old.get(words[k])
            self.new.update((words[k], found[k]) for k in missing if found[k] is not None)
            missing = [k for k in missing if found[k] is None]
        if missing:
            spell, new = self.bytes.__getitem__, self.new
            for k, ids in zip(missing, self.encode([words[k] for k in missing])):
                told = array("i", ids).tobytes()
                if b"".join(map(spell, ids)) != words[k]:
                    told += b"-"
                new[words[k]] = found[k] = told
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        return found

    def ids(self, step: Step, starts: np.ndarray, words: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, where each text's begin, with the end, and which texts they spell."""
        known = self._known(words.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known))
        odd = size & 3 > 0
        if odd.any():
            known = [x[:-1] if len(x) & 3 else x for x in known]
        size >>= 2
        ids, ends = gather(np.frombuffer(b"".join(known), "<i4"), np.cumsum(size) - size, size, number)
        at = np.concatenate([[0], ends])[np.searchsorted(starts, step.offsets)]
        good = np.ones(step.docs, bool)
        if odd.any():  # what is lost in one word another might make up for, so the whole text decides
            for k in np.unique(np.searchsorted(step.offsets, starts[odd[number]], "right") - 1):
                good[k] = b"".join([self.bytes[i] for i in ids[at[k] : at[k + 1]].tolist()]) == step.data[step.offsets[k] : step.offsets[k + 1]].tobytes()
        return ids, at, good


class Tokens:
    """Ids of both sides of some texts and where each text's begin; ``offsets`` are those of the texts' bytes."""

    def __init__(self, ids_a: np.ndarray, at_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray, offsets: np.ndarray):
        self.ids_a, self.at_a, self.ids_b, self.at_b, self.offsets = ids_a, at_a, ids_b, at_b, offsets

    def only(self, good: np.ndarray) -> Tokens:
        cut = lambda ids, at: (ids[np.repeat(good, np.diff(at))], _bounds(np.diff(at)[good]))
        return Tokens(*cut(self.ids_a, self.at_a), *cut(self.ids_b, self.at_b), _bounds(np.diff(self.offsets)[good]))


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Aligner:
    """Tokens of both sides of whole texts, each with a blank before it."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece

        counter, alphabet = TokenCounter(byte_file), byte_alphabet()
        self.words = counter.words
        strings = {i: bytes(alphabet[c] for c in t) for t, i in counter.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in t)}
        letters = {b: c for c, b in alphabet.items()}
        model = counter.tokenizer.model
        self.a = _Side([strings.get(i, b"") for i in range(max(strings) + 1)], lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(letters))] for w in words])
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        spelt = lambda i: bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else b"" if pieces.is_control(i) else pieces.id_to_piece(i).replace(_BLANK, " ").encode()
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        blank = pieces.piece_to_id(_BLANK)
        # Texts can be cut before blanks if no token has one after another character and white space stays as it is.
        self.by_words = not any(_BLANK in n.lstrip(_BLANK) for n in names) and "".join(pieces.encode("  a   b ", out_type=str)) == f"{_BLANK * 3}a{_BLANK * 3}b{_BLANK}" and not pieces.is_unknown(blank)
        encode = lambda words: pieces.encode([w[1:].decode() for w in words], num_threads=1)  # noqa: E731  (the model puts the first blank itself)
        self.b = _Side([spelt(i) for i in range(len(names))], lambda words: [[blank] if w == b" " and self.by_words else ids for w, ids in zip(words, encode(words))])
        # Each id is told with the mark that follows it: | after the last of side A, ; after a group, a comma else.
        self.told = [b"%d%b" % (i, mark) for i in range(max(len(self.a.bytes), len(names))) for mark in (b",", b"|", b";")]

    def tokens(self, step: Step) -> tuple[Tokens, np.ndarray]:
        """Tokens of a step's texts, and which of them both sides spell. A text that is a blank alone is an empty one."""
        data, offsets = step.data, step.offsets
        ids_a, at_a, good_a = self.a.ids(step, *self.words(step))
        cut = np.zeros(len(data), bool)
        cut[offsets[:-1]] = True
        if self.by_words:
            cut[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        starts = np.flatnonzero(cut)
        ids_b, at_b, good_b = self.b.ids(step, starts, *distinct(data, starts))
        return Tokens(ids_a, at_a, ids_b, at_b, offsets), good_a & good_b

    def align(self, t: Tokens) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray]:
        """Of texts that both sides spell: measures of each, its groups as text, the pair of each link, and the text of each link."""
        end_a, end_b = np.cumsum(self.a.sizes[t.ids_a]), np.cumsum(self.b.sizes[t.ids_b])
        place = np.searchsorted(end_a, end_b)
        last_b = end_a[place] == end_b
        last_a = np.zeros(len(end_a), bool)
        last_a[place[last_b]] = True
        both, other = end_b[last_b], end_b[~last_b]
        ends = np.concatenate([end_a, other])
        merged = np.argsort(ends, kind="stable")  # two sorted runs
        ends, of_a, of_b = ends[merged], merged < len(end_a), np.concatenate([last_a, np.ones(len(other), bool)])[merged]
        pair = t.ids_a[np.cumsum(of_a) - of_a].astype(np.int64) << 32 | t.ids_b[np.cumsum(of_b) - of_b]
        bounds = np.searchsorted(ends, t.offsets, "right")
        measures = {"n_a": np.diff(t.at_a), "n_b": np.diff(t.at_b), "n_groups": np.diff(np.searchsorted(both, t.offsets, "right")), "n_links": np.diff(bounds)}
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        told = list(map(self.told.__getitem__, np.concatenate([t.ids_a * 3 + last_a, t.ids_b * 3 + 2 * last_b])[order].tolist()))
        at = (t.at_a + t.at_b).tolist()
        return measures, [b"".join(told[x:y]) for x, y in zip(at[:-1], at[1:])], pair, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_file: str, piece_file: str) -> Aligner:
    key = (byte_file, piece_file)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(byte_file, piece_file)
    return _ALIGNERS[key]


_BLOCK = "block long, rank int, pair long, weight long, texts array<struct<digest:binary,copies:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, links binary"


class _Block:
    """Texts, or parts of one, that are aligned together."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.texts, self.pairs, self.owners, self.copies = [], [], [], []

    def add(self, digests: list[bytes], copies: np.ndarray, measures: dict, shas: list, pair: np.ndarray, text: np.ndarray, size: int) -> None:
        self.owners.append(text + len(self.texts))
        self.texts += [dict(zip(("digest", "copies", "groups_sha256", *measures), x)) for x in zip(digests, copies.tolist(), shas, *(m.tolist() for m in measures.values()))]
        self.pairs.append(pair)
        self.copies.append(copies)
        self.bytes += size

    def batches(self) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("rank", pa.int32()), ("pair", pa.int64()), ("weight", pa.int64()), ("texts", pa.list_(pa.struct([("digest", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))), ("links", pa.binary())])
        pairs, inverse, n = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent pairs have small numbers, which compress
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        weight = np.bincount(inverse, weights=np.concatenate(self.copies)[np.concatenate(self.owners)].astype(np.float64), minlength=len(pairs)).astype(np.int64)
        for low in range(0, len(pairs), 1 << 16):
            own = order[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), self.number)), pa.array(np.arange(low, low + len(own)), pa.int32()), pa.array(pairs[own]), pa.array(weight[own]), pa.nulls(len(own), schema.field(4).type), pa.nulls(len(own), pa.binary())], schema=schema)
        planes = rank[inverse].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([self.number]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([self.texts], schema.field(4).type), pa.array([zstandard.ZstdCompressor(level=1).compress(planes)], pa.binary())], schema=schema)


def _links(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _spaced(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))


def _aligned(batches: Iterator[pa.RecordBatch], mine: Aligner) -> Iterator[pa.RecordBatch]:
    """Blocks of ``digest, copies, text``. A very long text is aligned in parts, whose measures are added up later."""
    first = TaskContext.get().partitionId() << 32
    block, number = _Block(first), 0
    sha = lambda told: hashlib.sha256(told[:-1]).hexdigest()
    for batch in batches:
        for row, step in steps(_spaced(batch.column(2))):
            digests, copies = (batch.column(k).slice(row, step.docs) for k in (0, 1))
            copies = np.asarray(copies)
            cut = list(parts(step)) if mine.by_words else [step]
            if len(cut) > 1 and not all(mine.tokens(p)[1].all() for p in cut):
                continue
            whole = hashlib.sha256()
            for k, part in enumerate(cut):
                tokens, good = mine.tokens(part)
                if not good.all():  # texts that are not spelt leave before anything is aligned
                    tokens, digests, copies = tokens.only(good), digests.filter(pa.array(good)), copies[good]
                if not len(copies):
                    continue
                measures, told, pair, text = mine.align(tokens)
                if len(cut) == 1:
                    shas = [sha(t) for t in told]
                else:
                    whole.update(told[0] if k < len(cut) - 1 else told[0][:-1])
                    shas = [whole.hexdigest() if k == len(cut) - 1 else None]
                block.add(digests.to_pylist(), copies, measures, shas, pair, text, len(part.data))
                if block.bytes >= BLOCK_BYTES:
                    yield from block.batches()
                    number += 1
                    block = _Block(first + number)
    if block.texts:
        yield from block.batches()


def _told_sums(block: pa.Table, sums: pa.Table) -> pa.Table:
    """Measures of a block's texts, from the sums of its pairs."""
    rank = np.asarray(sums["place"])
    count, best = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    count[rank], best[rank] = np.asarray(sums["count"]), np.asarray(sums["best"]).astype(np.int64)
    texts = block["texts"].combine_chunks().flatten()
    links = _links(block["links"][0].as_py())
    at = np.concatenate([[0], np.cumsum(np.asarray(texts.field("n_links")))])
    of = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[links])])[at])
    names = ("digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return pa.table({**{n: texts.field(n) for n in names}, "n_best": pa.array(of(best)), "count_sum": pa.array(of(count))})


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, pair_table: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs``.

    With ``pair_table``: ``a, b, count, best`` of all id pairs instead.

    Null and empty texts, and those that either tokenizer does not spell as they are, have no tokens: zeros
    and an empty hash. Repeated rows, and rows with equal texts, weigh one each and get equal measures; ids may be
    of any type, null or repeated. Ties for a B id's highest count are all best. A very long text is aligned in parts
    (cut before a blank, where both tokenizers end a token); other columns are not looked at. An
    empty table gives an empty result.
    """
    docs = clean_names(docs, "doc_id", "text")
    aligner(byte_file, piece_file)
    keyed = stored(docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("digest")), "keyed-texts")
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from newswell.llm.alignment import _aligned as work
        from newswell.llm.alignment import aligner as mine

        yield from work(batches, mine(byte_file, piece_file))

    blocks = stored(texts.mapInArrow(run, _BLOCK), "aligned-blocks")
    named = blocks.where("rank IS NOT NULL").select("block", "rank", "pair", "weight")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counts = stored(named.groupBy("pair").agg(F.sum("weight").alias("count")), "pair-counts")
    # One row a token of the second vocabulary at most: that bounds what is broadcast.
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    counts = counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    if pair_table:
        return counts.select(F.shiftright("pair", 32).alias("a"), "b", "count", "best")
    sums = named.drop("weight").join(counts.drop("b"), "pair").select(F.col("block").alias("asker"), F.col("rank").alias("place"), "count", "best")
    out = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    told = blocks.where("rank IS NULL").select("block", "texts", "links").groupBy("block").cogroup(sums.groupBy("asker")).applyInArrow(_told_sums, out)
    measures = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    told = stored(told.groupBy("digest").agg(F.max("copies").alias("copies"), *(F.sum(m).alias(m) for m in measures), F.max("groups_sha256").alias("groups_sha256")), "text-measures")

    # A text with very many copies is joined by broadcast, of which there can be few; no key of the other join has more rows.
    many = max(LEAST_HOT, keyed.count() // MOST_HOT)
    hot, rest = told.where(F.col("copies") > many).drop("copies"), told.where(F.col("copies") <= many).drop("copies")
    marked = keyed.join(F.broadcast(hot.select("digest", F.lit(True).alias("hot"))), "digest", "left")
    joined = keyed.join(F.broadcast(hot), "digest").unionByName(marked.where("hot IS NULL AND digest IS NOT NULL").drop("hot").join(rest, "digest", "left")).unionByName(keyed.where("digest IS NULL"), allowMissingColumns=True)
    return joined.select("doc_id", *(F.coalesce(m, F.lit(0)).alias(m) for m in measures), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
