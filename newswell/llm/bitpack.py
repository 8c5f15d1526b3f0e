"""Token ids in fixed-width bit-packed files.

An id takes the least bits that the vocabulary needs. 64 ids fill ``bits`` 64-bit
words, so packing and unpacking are 64 shifts over whole columns of such groups.
A file holds blocks of ``BLOCK_IDS`` ids and then an index: the byte offset of each
block, and id and first position of each document. Any run of ids is read by
fetching its blocks alone.

File: 8 bytes magic; blocks; index arrays (int64 little-endian: block offsets,
document ids, document positions with the end, then a bitmap byte a document: 1 if
its id is null); footer of six uint64: bits, ids, documents, blocks, position of the
index, 8 bytes magic.
"""

from __future__ import annotations

import math
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newswell.llm.shared import clean_names, scratch, stored

MAGIC = b"NWELLTOK"
BLOCK_IDS = 1 << 14
END_ID = 2
#: Documents, about, in one file, and the most files; beyond that many, files grow instead.
FILE_ROWS, MOST_FILES = 8192, 1 << 14
#: Words, at most, of which a Python worker remembers the ids; the half not asked for lately goes first.
CACHE_WORDS = 100_000
#: Bytes of text that are encoded as one column; a longer document is a column of its own.
COLUMN_BYTES = 3 << 20
#: Closing punctuation that is looked up apart from its word; letters of such words (those of Latin-1).
CLOSING = ".,;:!?"
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit-pack ids; the last group is filled with zeros."""
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.ravel()[: len(ids)] = ids
    words = np.zeros((len(groups), bits), np.uint64)
    for k in range(64):
        at, shift = divmod(k * bits, 64)
        words[:, at] |= groups[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, at + 1] |= groups[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed data, as uint32."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    groups = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        at, shift = divmod(k * bits, 64)
        got = words[:, at] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | (words[:, at + 1] << np.uint64(64 - shift))
        groups[:, k] = got & mask
    return groups.ravel()[:n].astype(np.uint32)


class Writer:
    """Writes one file; documents are added in order and only the index stays in memory."""

    def __init__(self, path: str, bits: int):
        store, name = pafs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(name), recursive=True)
        self.out, self.bits = store.open_output_stream(name), bits
        self.out.write(MAGIC)
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.blocks, self.doc_ids, self.null, self.starts = [self.at], [], [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 16 * BLOCK_IDS:
            self._flush(self.n_waiting // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for k in range(0, n, BLOCK_IDS):
            data = pack(ids[k : min(n, k + BLOCK_IDS)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.n_waiting)
        for x in (self.blocks, self.doc_ids, self.starts):
            self.out.write(np.array(x, "<i8").tobytes())
        self.out.write(np.array(self.null, np.uint8).tobytes())
        self.out.write(np.array([self.bits, self.starts[-1], len(self.doc_ids), len(self.blocks) - 1, self.at], "<u8").tobytes() + MAGIC)
        self.out.close()
        return len(self.doc_ids), self.starts[-1]


class Reader:
    """Random access to a file's documents and ids."""

    def __init__(self, path: str):
        store, name = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        footer = self.file.read_at(48, size - 48)
        if size < 56 or footer[40:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no complete token file")
        self.bits, self.n_ids, self.n_docs, n_blocks, at = (int(x) for x in np.frombuffer(footer[:40], "<u8"))
        index = self.file.read_at(size - 48 - at, at)
        cut = np.cumsum([0, n_blocks + 1, self.n_docs, self.n_docs + 1]) * 8
        self.blocks, self.doc_ids, self.starts = (np.frombuffer(index[a:b], "<i8") for a, b in zip(cut[:-1], cut[1:]))
        self.null = np.frombuffer(index[cut[-1] :], np.uint8).astype(bool)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK_IDS, -(-end // BLOCK_IDS)
        data = self.file.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a]))
        first = a * BLOCK_IDS
        return unpack(data, min(self.n_ids, b * BLOCK_IDS) - first, self.bits)[start - first : end - first]

    def close(self) -> None:
        self.file.close()


class _Kept:
    """Results of ``make`` for at most ``CACHE_WORDS`` words, in two halves: when the newer is full, the older goes."""

    def __init__(self, make):
        self.make, self.new, self.old = make, {}, {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        out = list(map(self.new.get, keys))
        for k, value in enumerate(out):
            if value is None:
                key = keys[k]
                value = self.old.get(key)
                out[k] = value = self.make(key) if value is None else value
                if len(self.new) >= CACHE_WORDS // 2:
                    self.new, self.old = {}, self.new
                self.new[key] = value
        return out


def splits_at_blanks(settings: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space, never joins across it, and takes letters, closing marks and the rest apart.

    Read from its own settings: only then are a text's ids those of its parts between blanks.
    """
    normalizers = (settings.get("normalizer") or {}).get("normalizers") or []
    splitters = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = settings["model"]
    if [x["type"] for x in normalizers] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splitters] != ["Split", "ByteLevel"]:
        return False
    words, to_bytes = splitters
    return (
        normalizers[1]["pattern"] == {"Regex": r"\s+"}
        and normalizers[1]["content"] == " "
        and words["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (words["behavior"], words["invert"]) == ("Removed", True)
        and not to_bytes["add_prefix_space"]
        and not to_bytes["use_regex"]
        and model["type"] == "BPE"
        and not model.get("dropout")
        and settings.get("truncation") is None
        and settings.get("padding") is None
        and all(not any(c.isspace() for c in t["content"]) and any(not c.isalpha() and c not in CLOSING for c in t["content"]) for t in settings["added_tokens"])
    )


class Encoder:
    """Ids of whole columns of texts by the ``tokenizers`` library.

    Where the tokenizer's settings allow it, a column is cut at blanks and newlines
    and dictionary-encoded, so that each different part is encoded once, and ids are
    gathered by the parts' numbers. A part of Latin-1 letters and closing punctuation
    is looked up as lower-cased letters and punctuation, which the tokenizer
    lower-cases and splits in the same way; any other part goes through the whole
    tokenizer. Texts of tokenizers with other settings go through it as they are.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_parts = splits_at_blanks(json.loads(self.tokenizer.to_str()))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}
        self.stems, self.others = _Kept(self._stem), _Kept(self._any)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, f"<u{self.width}").tobytes()

    def _any(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b""

    def _stem(self, stem: str) -> bytes:
        """Ids of one lower-cased word: the tokenizer's model, given the word's bytes in its alphabet."""
        word = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.alphabet)
        return self._bytes([t.id for t in self.model.tokenize(word)])

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different parts: all ids, and each part's first one and their number."""
        stem = pc.utf8_rtrim(parts, CLOSING)
        simple = pc.match_substring_regex(stem, f"^[{LETTERS}]+$")
        plain, odd = np.flatnonzero(np.asarray(simple)), np.flatnonzero(~np.asarray(simple))
        stems = pc.utf8_lower(stem.filter(simple)).dictionary_encode()
        tails = pc.utf8_ltrim(parts.filter(simple), LETTERS).dictionary_encode()
        known = [b"", *self.stems(stems.dictionary.to_pylist()), *self.others(tails.dictionary.to_pylist()), *self.others(parts.take(pa.array(odd)).to_pylist())]
        units = np.zeros((len(parts), 2), np.int64)
        units[plain, 0] = 1 + np.asarray(stems.indices)
        units[plain, 1] = 1 + len(stems.dictionary) + np.asarray(tails.indices)
        units[odd, 0] = 1 + len(stems.dictionary) + len(tails.dictionary) + np.arange(len(odd))
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        ids, ends = gather(np.frombuffer(b"".join(known), f"<u{self.width}"), np.cumsum(size) - size, size, units.ravel())
        ends = ends[1::2]
        return ids, np.concatenate([[0], ends[:-1]])[: len(ends)], np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column without nulls, one after the other, and where each text's begin, with the end; ``end_id`` closes each text."""
        kind = f"<u{self.width}"
        if not self.by_parts:
            more = [] if end_id is None else [end_id]
            lists = [x.ids + more for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in lists for i in x], kind), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        at = np.asarray(lists.offsets).astype(np.int64)
        number, at = np.asarray(parts.indices), at - at[0]
        ids, first, size = self._parts(parts.dictionary)
        if end_id is not None:  # the end is one more part of each text
            number = np.insert(number, at[1:], len(first))
            at = at + np.arange(len(at))
            ids, first, size = np.append(ids, np.array(end_id, kind)), np.append(first, len(ids)), np.append(size, 1)
        ids, ends = gather(ids, first, size, number)
        return ids, np.concatenate([[0], ends])[at]


def gather(ids: np.ndarray, first: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids that ``number`` lists, one after the other, and where each ends."""
    sizes = size[number]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    take = np.repeat((first[number] - ends + sizes).astype(np.int32 if len(ids) + total < 1 << 31 else np.int64), sizes)
    take += np.arange(total, dtype=take.dtype)
    return ids[take], ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_rows: int = FILE_ROWS) -> DataFrame:
    """Encode all texts and write their ids, in ascending ``doc_id`` order, to files in ``folder``.

    Returns the stored manifest ``file, path, n_docs, n_tokens``, a row a file. Null
    texts are empty and have the end id alone; null ids come first; rows with equal
    ids stand together in any order. ``doc_id`` is an integer (a string of digits is
    taken as one). A text of any length is one row, whose ids Spark's limit of 2 GB a
    row must hold. A task that runs again writes another file, and the manifest names
    those that count. An empty table gives no file.
    """
    docs = clean_names(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    n_files = min(MOST_FILES, max(1, math.ceil(docs.count() / file_rows)))
    cuts = docs.stat.approxQuantile("doc_id", [k / n_files for k in range(1, n_files)], 0.2 / n_files) if n_files > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))
    reader = encoder(tokenizer)
    width, bits = reader.width, bits_for(max(reader.tokenizer.get_vocab_size(), end_id + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from newswell.llm.bitpack import encoder as mine

        e = mine(tokenizer)
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0)).astype(np.int64))
            k = 0
            while k < batch.num_rows:
                to = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + COLUMN_BYTES, "right")))
                part = batch.slice(k, to - k)
                k = to
                ids, at = e.encode(part.column(1).fill_null(""), end_id)
                # Spark's batches address binary data by 32 bits, so rows leave in as many batches as that needs.
                low = 0
                while low < len(at) - 1:
                    high = max(low + 1, int(np.searchsorted(at, at[low] + (1 << 28), "right")) - 1)
                    own = part.slice(low, high - low).column(0)
                    bounds = ((at[low : high + 1] - at[low]) * width).astype(np.int32)
                    data = pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids[at[low] : at[high]].tobytes())])
                    file = np.searchsorted(cuts, np.asarray(own.fill_null(np.iinfo(np.int64).min)), "right")
                    yield pa.RecordBatch.from_arrays([pa.array(file.astype(np.int32)), own, data], names=["file", "doc_id", "ids"])
                    low = high

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, path = None, None, None
        rows = []

        def close():
            rows.append((at, path, *out.close()))

        for batch in batches:
            for file, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if file != at:
                    if out:
                        close()
                    at, path = file, f"{folder}/tokens-{file:06d}-{uuid.uuid4().hex}.bin"
                    out = Writer(path, bits)
                out.add(doc_id, np.frombuffer(ids, f"<u{width}"))
        if out:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "path", "n_docs", "n_tokens"), r)) for r in rows], schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    encoded = docs.mapInArrow(encode, "file int, doc_id long, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("file")).sortWithinPartitions("file", "doc_id")
    return stored(dealt.mapInArrow(write, "file int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in the files; ``start`` counts the ids before a document in all files."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("before"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns)):
                file = Reader(path)
                k = 0
                while k < file.n_docs:
                    to = max(k + 1, int(np.searchsorted(file.starts, file.starts[k] + (1 << 18), "right")) - 1)
                    ids = file.ids(int(file.starts[k]), int(file.starts[to]))
                    own = file.starts[k : to + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[k:to], mask=file.null[k:to]), pa.array(own[:-1] + first), pa.array(np.diff(own)), pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ids.astype(np.int32)))],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    k = to
                file.close()

    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids array<int>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ids, at = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
        sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_bitpacking(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "tokens"))
    return read_tokens(manifest).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
