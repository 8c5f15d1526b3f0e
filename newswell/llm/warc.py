"""WARC archives compressed by Zstandard, one frame a record, with a dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswell.llm.shared import clean_names, scratch, small_side, stored

#: Fixed values of the format: magic of the dictionary's skippable frame and of Zstandard frames.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: Records, and their bytes, at most, from which an archive's dictionary is trained; the dictionary's size; bytes after which an archive ends.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 200, 2 << 20, 32 << 10, 256 << 20
DATE = "2024-01-31T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, with the payload's length, but not the payload."""
    head = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = head if revisit else head + payload
    target = "".join(c if c.isprintable() and c != " " else "%20" for c in url or "about:blank")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return CRLF.join([VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"", b""]) + block + CRLF * 2


class Writer:
    """Writes one archive. The first records wait until the dictionary is trained from them."""

    def __init__(self, path: str):
        store, name = pafs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(name), recursive=True)
        # Without ``compression=None`` the stream would be wrapped in another Zstandard frame because of its name.
        self.out, self.path, self.waiting, self.size, self.n, self.written, self.compress = store.open_output_stream(name, compression=None), path, [], 0, 0, 0, None

    def add(self, data: bytes) -> None:
        self.n += 1
        self.size += len(data)
        if self.compress:
            self._write(data)
            return
        self.waiting.append(data)
        if len(self.waiting) >= TRAIN_RECORDS or self.size >= TRAIN_BYTES:
            self._begin()

    def _write(self, data: bytes) -> None:
        frame = self.compress(data)
        self.out.write(frame)
        self.written += len(frame)

    def _begin(self) -> None:
        import zstandard

        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
        except (zstandard.ZstdError, ValueError):  # too few or too small samples to train from: they are the dictionary themselves
            trained = zstandard.ZstdCompressionDict(b"".join(self.waiting)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.written += 8 + len(content)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True).compress
        for data in self.waiting:
            self._write(data)
        self.waiting = []

    def close(self) -> None:
        if not self.compress and self.waiting:
            self._begin()
        self.out.close()


def frames(path: str) -> Iterator[bytes]:
    """The content of each record's frame, one decoded at a time. A file without the leading dictionary, or that ends within a frame, is refused."""
    import zstandard

    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as f:
        head = f.read(8)
        if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary leads the archive")
        size = struct.unpack("<I", head[4:])[0]
        content = f.read(size)
        if len(content) < size:
            raise ValueError(f"{path}: the dictionary is cut off")
        if content[:4] == FRAME:
            content = zstandard.ZstdDecompressor().decompress(content)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        frame, parts, begun, data = decoder.decompressobj(), [], False, b""
        while True:
            data = data or f.read(1 << 20)
            if not data:
                break
            begun = True
            parts.append(frame.decompress(data))
            data = b""
            if frame.eof:
                data = frame.unused_data
                yield b"".join(parts)
                frame, parts, begun = decoder.decompressobj(), [], False
        if begun:
            raise ValueError(f"{path}: the last frame is cut off")


def parse(data: bytes) -> dict:
    """Check a record's version, headers and lengths, and its payload against its digest."""
    head, split, rest = data.partition(CRLF * 2)
    first, *lines = head.split(CRLF)
    if first not in (b"WARC/1.0", b"WARC/1.1") or not split:
        raise ValueError("no WARC record")
    headers = {}
    for line in lines:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError(f"no header: {line[:80]!r}")
        headers[k.strip().decode().lower()] = v.strip().decode()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in headers:
            raise ValueError(f"{k} is missing")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != CRLF * 2:
        raise ValueError(f"the block has {len(rest) - 4} bytes and not {n}")
    http, split, payload = rest[:n].partition(CRLF * 2)
    lengths = [int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:")]
    if not split or len(lengths) != 1:
        raise ValueError("the HTTP headers give no length")
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if len(payload) != lengths[0] or digest(payload) != told:
            raise ValueError("the payload does not match its length or digest")
    elif headers["warc-type"] != "revisit" or payload or "warc-refers-to" not in headers:
        raise ValueError("neither response nor revisit")
    return {"headers": headers, "payload": payload, "payload_bytes": lengths[0], "payload_digest": told}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``page_id, url, html``; returns the stored manifest ``path, n_records``.

    Of rows with equal payloads that with the least ``page_id`` is a response (rows
    that share this id all are), the others are revisits of it. A null html is an
    empty payload; a null ``page_id`` comes after all others and, alone with its
    payload, is a response. Archives follow the partitions of ``pages``.
    """
    pages = clean_names(pages, "page_id", "url", "html").withColumns({"page_id": F.col("page_id").cast("bigint"), "html": F.coalesce("html", F.lit(""))}).withColumn("__key", F.sha2("html", 256))
    least = pages.groupBy("__key").agg(F.min("page_id").alias("__least"), F.count("*").alias("__n")).where("__n > 1").select("__key", "__least")
    least = stored(least, "warc-equal")
    joined = pages.join(small_side(least, 120), "__key", "left")
    revisit = F.coalesce(F.col("__least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__least")), F.lit(False))
    rows = joined.select("page_id", "url", "html", "__least", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for page_id, url, html, least_id, again in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    if out is None:
                        out = Writer(f"{folder}/pages-{uuid.uuid4().hex}.warc.zst")
                    out.add(record(page_id, url, html.encode(), least_id, again))
                    if out.written >= ARCHIVE_BYTES:
                        out.close()
                        done.append(out)
                        out = None
        if out:
            out.close()
            done.append(out)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x.path for x in done]), pa.array([x.n for x in done], pa.int64())], names=["path", "n_records"])

    return stored(rows.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` and, if wanted, ``payload`` of all records.

    A record that breaks the format, or whose length or digest is wrong, stops the read; so does
    an archive with fewer or more records than the manifest says, as after a cut between two frames.
    """
    n = max(1, manifest.count())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path, told in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size, seen = [], 0, 0

                def out():
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

                for data in frames(path):
                    x, seen = parse(data), seen + 1
                    h = x["headers"]
                    rows.append((number(h.get("warc-page-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to-page-id")), x["payload_bytes"], x["payload_digest"], *[x["payload"]] * payloads))
                    size += len(x["payload"]) if payloads else 200
                    if size > 4 << 20:
                        yield out()
                        rows, size = [], 0
                if seen != told:
                    raise ValueError(f"{path}: {seen} records instead of {told}")
                if rows:
                    yield out()

    return manifest.select("path", "n_records").repartition(n).mapInArrow(read, ", ".join(f"{c} {'binary' if c == 'payload' else 'long' if t == pa.int64() else 'string'}" for c, t in zip(names, kinds)))


def op9_warc_zstd(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = read_archives(write_archives(pages, scratch(spark, "warc")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
