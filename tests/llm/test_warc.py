"""Operator 11: what is written comes back, and what is damaged is found."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from tallybook.llm import warc

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, None, None), (3, "http://a b\r\nX: 1", "<p>one</p>"), (9, "http://ü/", ""), (None, "http://n/", "<p>one</p>"), (4, "u", "é漢😀" * 50_000),
    (5, "same row", "twice"), (5, "same row", "twice"), (-6, "minus", "\r\n\r\nWARC/1.1\r\n"), (None, None, "no id"), (7, "other", "<p>one</p> "),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, `__file` string")


def expected(rows, least):
    out, first = [], {}
    for i, (page, _, html) in enumerate(rows):
        first[html or ""] = max(first.get(html or "", (False, 0, -1)), (page is not None, page or 0, i))
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        best = first[html or ""]
        told = len(data) < least or best[2] == i
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if told else "revisit", None if told else rows[best[2]][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 6])
@pytest.mark.parametrize("size", [warc.FILE_BYTES, 1])
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_rows(spark, least, size, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    monkeypatch.setattr(warc, "small", lambda df: df.hint("shuffle_hash") if not broadcast else df)
    files = warc.write_warc(table(spark).coalesce(1), least=least)
    found = warc.read_warc(files)
    rows = found.select(warc.page_of(found.record_id).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(found.refers_to).alias("refers_to"), "payload").collect()
    assert sorted(repr(tuple(r)[:-1]) for r in rows) == expected(PAGES, least)
    texts = {(p, (h or "").encode()) for p, _, h in PAGES}
    assert all((r.page_id, bytes(r.payload)) in texts for r in rows if r.record_type == "response") and all(r.payload is None for r in rows if r.record_type == "revisit")
    assert warc.unresolved(found).collect() == []
    assert len({r.record_id for r in found.collect()}) == len(PAGES)


def test_nothing(spark):
    files = warc.write_warc(table(spark).limit(0))
    assert files.collect() == [] and warc.read_warc(files).collect() == []


def archive(*bodies, dictionary=None, packed=False):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    frames = [zstandard.ZstdCompressor(dict_data=known, write_checksum=True).compress(b) for b in bodies]
    lead = warc.dictionary_frame(zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary) if dictionary else b""
    return lead + b"".join(frames)


FIELDS = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": warc.DATE}


def read(data):
    return list(warc.records(io.BytesIO(data), "f"))


@pytest.mark.parametrize("packed", [False, True])
def test_dictionary_of_the_leading_frame(packed, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    samples = [warc.record(FIELDS, f"words {i} and more words {i * i}".encode() * 5) for i in range(300)]
    dictionary = warc.trained(samples)
    data = archive(*samples, dictionary=dictionary, packed=packed)
    assert len(data) < len(archive(*samples)) + len(dictionary)
    found = read(data)
    assert [r["payload"] for r in found] == [f"words {i} and more words {i * i}".encode() * 5 for i in range(300)]
    assert all("problem" in r for r in read(data[8 + struct.unpack("<I", data[4:8])[0] :]))  # without it nothing decodes


def test_large_and_foreign_frames():
    large = bytes(range(256)) * 3000
    streamed = zstandard.ZstdCompressor().compressobj()  # no size in its header
    frame = streamed.compress(warc.record(FIELDS, large)) + streamed.flush()
    zeros = archive(warc.record(FIELDS, bytes(400_000)))
    skipped = struct.pack("<II", 0x184D2A51, 3) + b"abc"
    assert [r["payload"] for r in read(frame + skipped + zeros)] == [large, bytes(400_000)]
    assert warc.trained([]) is None and read(b"") == []


@pytest.mark.parametrize(
    "body, said",
    [
        (b"WARC/2.0\r\n\r\n", "version"),
        (b"WARC/1.1\r\nWARC-Type: x\r\n", "does not end"),
        (b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n", "warc-record-id"),
        (warc.record(FIELDS, b"abc")[:-1], "block"),
        (warc.record(FIELDS, b"abc") + b"x", "block"),
        (warc.record(FIELDS, b"abc").replace(b"Length: 3", b"Length: 4"), "block"),
        (warc.record(FIELDS, b"abc").replace(b"Length: 3", b"Length: -3"), "no length"),
        (warc.record({**FIELDS, "WARC-Payload-Digest": "sha1:" + "A" * 32}, b"abc"), "digest"),
        (warc.record({**FIELDS, "WARC-Type": "revisit"}, b""), "revisit"),
        (warc.record({**FIELDS, "WARC-Type": "response", "Content-Type": warc.HTTP}, warc.http_header(4) + b"abc"), "HTTP body"),
        (warc.record(FIELDS, b"abc").replace(b"WARC-Date", b"WARC-Type"), "twice"),
    ],
)
def test_invalid_records(body, said):
    good = warc.record(FIELDS, b"fine")
    found = read(archive(good, body, good))
    assert [r.get("payload") for r in found] == [b"fine", None, b"fine"] and said in found[1]["problem"]


def test_damaged_frames(spark, tmp_path):
    good = [warc.record(FIELDS, b"some text %d" % i * 30) for i in range(3)]
    ends = [len(archive(*good[:i])) for i in range(4)]
    data = bytearray(archive(*good))
    data[ends[2] - 1] ^= 1  # the check sum of the second
    assert ["problem" in r for r in read(bytes(data))] == [False, True, False]
    assert ["problem" in r for r in read(bytes(data[: ends[3] - 5]))] == [False, True, True]
    assert "no frame" in read(b"WARC/1.1 in plain text")[0]["problem"]
    path = tmp_path / "x.warc.zst"
    path.write_bytes(bytes(data))
    files = spark.createDataFrame([(f"file://{path}",)], "path string")
    rows = warc.read_warc(files, strict=False).orderBy("offset").collect()
    assert [r.problem is None for r in rows] == [True, False, True] and [r.offset for r in rows] == ends[:3]
    with pytest.raises(Exception, match="does not decode"):
        warc.read_warc(files).collect()
