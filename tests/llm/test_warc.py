import struct

import pytest
import zstandard
from newswell.llm import warc
from newswell.llm.shared import scratch

ROWS = [(5, "http://a.example/x y\r\nz", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "u", None), (7, "u", ""), (None, "v", "<p>same</p>"), (None, "w", "only"), (3, "long", "é" * 200_000), (4, "rep", "r"), (4, "rep", "r"), *((100 + k, f"h{k}", f"<html><body>{'text ' * 40}{k}</body></html>") for k in range(300))]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    manifest = warc.write_archives(pages(spark, ROWS).coalesce(1).selectExpr("*", "1 AS __least", "2 AS revisit"), scratch(spark, "w"))
    got = warc.read_archives(manifest).collect()
    least = {}
    for i, _, h in ROWS:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    count = {}
    for _, _, h in ROWS:
        count[h or ""] = count.get(h or "", 0) + 1
    want = []
    for i, _, h in ROWS:
        data, first = (h or "").encode(), least.get(h or "")
        again = count[h or ""] > 1 and first is not None and i != first
        want.append((i, "revisit" if again else "response", first if again else None, len(data), warc.digest(data), b"" if again else data))
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)


def written(tmp_path, rows):
    w = warc.Writer(f"file://{tmp_path}/a.warc.zst")
    for i, u, h in rows:
        w.add(warc.record(i, u, (h or "").encode(), None, False))
    w.close()
    return (tmp_path / "a.warc.zst").read_bytes()


@pytest.mark.parametrize("n", [1, 3, len(ROWS)])
def test_dictionary_leads_the_archive(tmp_path, n):
    """The bytes on disk, read with the library alone: a skippable frame with the dictionary, then a frame a record."""
    data = written(tmp_path, ROWS[:n])
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    rest, records = data[8 + size :], []
    while rest:
        assert rest[:4] == warc.FRAME
        frame = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        records.append(frame.decompress(rest))
        assert frame.eof
        rest = frame.unused_data
    assert records == [warc.record(i, u, (h or "").encode(), None, False) for i, u, h in ROWS[:n]]
    assert list(warc.frames(f"file://{tmp_path}/a.warc.zst")) == records


def test_every_cut_is_refused(spark, tmp_path):
    data = written(tmp_path, ROWS)
    (tmp_path / "b.warc.zst").write_bytes(data)
    path = f"file://{tmp_path}/b.warc.zst"
    manifest = spark.createDataFrame([(path, len(ROWS))], "path string, n_records long")
    assert warc.read_archives(manifest).count() == len(ROWS)
    last = data.rindex(warc.FRAME)
    for cut in [3, 9, *range(last + 1, len(data))]:
        (tmp_path / "b.warc.zst").write_bytes(data[:cut])
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(path))
    (tmp_path / "b.warc.zst").write_bytes(data[:last])  # between two frames: only the manifest tells
    assert len(list(warc.frames(path))) == len(ROWS) - 1
    with pytest.raises(Exception, match="records instead of"):
        warc.read_archives(manifest).count()
    (tmp_path / "b.warc.zst").write_bytes(data[8 + struct.unpack("<I", data[4:8])[0] :])
    with pytest.raises(ValueError):
        list(warc.frames(path))


def test_broken_records_are_refused():
    good = warc.record(1, "u", b"payload", None, False)
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-1], good + b"x", good.replace(b"payload\r", b"payl0ad\r"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dat"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []), scratch(spark, "w"))).count() == 0


def test_query_columns(spark, tmp_path):
    pages(spark, [(3, "u", "x"), (1, "v", "x"), (2, "w", None), (5, "z", "é")]).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in warc.op9_warc_zstd(spark, str(tmp_path)).collect()}
    assert [(got[k]["record_type"], got[k]["refers_to"], got[k]["payload_bytes"]) for k in (1, 2, 3, 5)] == [("response", None, 1), ("response", None, 0), ("revisit", 1, 1), ("response", None, 2)]
    assert got[3]["payload_digest"] == got[1]["payload_digest"] == warc.digest(b"x") and len(got[1]["payload_digest"]) == 32
