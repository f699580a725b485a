"""WARC archives of Zstandard frames, written and read (operator 11).

A file begins with a skippable frame that holds the dictionary (as it is, or as a Zstandard frame of its own); each
record follows as one frame, compressed with that dictionary. The reader cuts a stream into frames by their block
headers alone, so a frame that does not decode costs one record and no more.

A page's record is a `response` with the page as its payload, or, where another record has the same payload, a
`revisit` that names that record and holds the HTTP header only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, located, put, shared_dir, small, small_batches, text_of, uri, written

DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
#: Bytes of a dictionary at most, and how many pages, and how much of each, it is trained on.
DICTIONARY_BYTES, TRAINED_PAGES, TRAINED_CHARS = 64 << 10, 400, 16 << 10
#: A task closes a file and opens the next after so many bytes.
FILE_BYTES = 32 << 20
#: Bytes that are read at a time, and that a batch of records holds.
CHUNK, BATCH = 1 << 20, 4 << 20
#: Copies of one payload meet their response in so many shares.
SHARES = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Fields that stand once at most; others that are repeated are joined by commas.
ONCE = (*REQUIRED, "warc-target-uri", "warc-refers-to", "warc-payload-digest", "content-type")
#: Payload of records that carry an HTTP response.
HTTP = "application/http"


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record: version, named fields, an empty line, the block, two line ends."""
    head = "".join(f"{name}: {value}\r\n" for name, value in {**fields, "Content-Length": str(len(block))}.items())
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def http_header(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data


def trained(samples: list[bytes]) -> bytes | None:
    """A dictionary for records like samples; None where they are too few or too small for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


class Invalid(ValueError):
    """Says what is wrong with a frame or a record."""


class Frames:
    """(offset, bytes) of the frames of a stream, of which no more than a frame and a chunk is held."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.offset = stream, b"", 0, 0

    def has(self, n: int) -> bool:
        """Whether n more bytes are there; they are read if need be."""
        while len(self.held) - self.at < n:
            more = self.stream.read(max(CHUNK, n - len(self.held) + self.at))
            if not more:
                return False
            self.held, self.at = self.held[self.at :] + more, 0
        return True

    def bytes(self, begin: int, n: int) -> bytes:
        if not self.has(begin + n):
            raise Invalid("the file ends inside a frame")
        return self.held[self.at + begin : self.at + begin + n]

    def length(self) -> int:
        """Bytes of the frame that begins here, from its own header and those of its blocks."""
        magic = self.bytes(0, 4)
        if 0x184D2A50 <= int.from_bytes(magic, "little") <= 0x184D2A5F:
            return 8 + int.from_bytes(self.bytes(4, 4), "little")
        if magic != FRAME:
            raise Invalid("no frame begins here")
        flags = self.bytes(4, 1)[0]
        single = flags >> 5 & 1
        at = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            head = int.from_bytes(self.bytes(at, 3), "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise Invalid("a block of an unknown kind")
            at += 3 + (1 if kind == 1 else size)
        return at + 4 * (flags >> 2 & 1)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.has(1):
            n = self.length()
            frame = self.bytes(0, n)
            yield self.offset, frame
            self.at, self.offset = self.at + n, self.offset + n


def opened(frames: Frames) -> tuple[zstandard.ZstdDecompressor, Iterator[tuple[int, bytes]]]:
    """A decompressor with the dictionary of the leading skippable frame, if there is one, and the frames of records."""
    rest = iter(frames)
    first = next(rest, None)
    if first is None or int.from_bytes(first[1][:4], "little") != DICTIONARY_FRAME:
        return zstandard.ZstdDecompressor(), (x for part in ([first] if first else [], rest) for x in part)
    data = first[1][8:]
    if data[:4] == FRAME:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if data[:4] != DICTIONARY:
        raise Invalid("the leading frame holds no dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)), rest


def decoded(unpack: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    one = unpack.decompressobj()
    try:
        data = one.decompress(frame)
    except zstandard.ZstdError as e:
        raise Invalid(f"a frame does not decode: {e}") from None
    if not one.eof or one.unused_data:
        raise Invalid("a frame does not end where its blocks do")
    return data


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields by their names in small letters; a line that begins with a blank goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Invalid("a header line without a name")
        if name in found and name in ONCE:
            raise Invalid(f"{name} is given twice")
        found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
    return found


def length_of(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", value):
        raise Invalid(f"{what}: no length")
    return int(value)


def parsed(data: bytes) -> dict:
    """The record of a decoded frame. Raises Invalid unless its header, its lengths and its digest are right."""
    version, _, rest = data.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise Invalid("no WARC version")
    head, end, body = rest.partition(b"\r\n\r\n")
    if not end:
        raise Invalid("the header does not end")
    fields = fields_of(head)
    if missing := [name for name in REQUIRED if not fields.get(name)]:
        raise Invalid(f"no {', '.join(missing)}")
    n = length_of(fields, "record")
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise Invalid(f"the block is to have {n} bytes and two line ends, but {len(body)} follow")
    kind, payload = fields["warc-type"], body[:n]
    out = {"record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "refers_to": fields.get("warc-refers-to")}
    digest = fields.get("warc-payload-digest", "")
    digest = digest[5:] if digest[:5].lower() == "sha1:" else None
    length = n
    if fields.get("content-type", "").replace(" ", "").lower().startswith(HTTP):
        top, end, payload = payload.partition(b"\r\n\r\n")
        if not end:
            raise Invalid("the HTTP header does not end")
        http = fields_of(top.partition(b"\r\n")[2]) if b"\r\n" in top else {}
        length = length_of(http, "HTTP") if "content-length" in http or kind == "revisit" else len(payload)
        if kind == "response" and length != len(payload):
            raise Invalid(f"the HTTP body is to have {length} bytes and has {len(payload)}")
    if kind == "revisit":
        if not out["refers_to"] or not digest:
            raise Invalid("a revisit without the record or the digest of its payload")
        payload = None
    else:
        own = base32(payload)
        if digest not in (None, own):
            raise Invalid("the payload has another digest")
        digest = own
    return {**out, "payload_bytes": length, "payload_digest": digest, "payload": payload}


RECORDS = {"path": pa.string(), "offset": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "problem": pa.string()}
SCHEMA = "path string, offset long, record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def records(stream, path: str) -> Iterator[dict]:
    """What a stream holds, record by record; a frame or record that is not right gives a row that says so in problem."""
    frames = Frames(stream)
    try:
        unpack, rest = opened(frames)
        for offset, frame in rest:
            if frame[:4] != FRAME:
                continue
            try:
                yield {"path": path, "offset": offset, **parsed(decoded(unpack, frame))}
            except Invalid as e:
                yield {"path": path, "offset": offset, "problem": str(e)}
    except (Invalid, zstandard.ZstdError) as e:
        yield {"path": path, "offset": frames.offset, "problem": str(e)}


def read_warc(files: DataFrame, payload: bool = True, strict: bool = True) -> DataFrame:
    """One row per record of the archives in files (path string): where it lies, its fields, its payload, problem.

    A task reads one file as a stream and holds a record at a time. payload_bytes and payload_digest (base 32, SHA-1)
    are those of the whole payload, for a revisit as its header tells them; its payload is null, and so are all with
    payload=False. Frames are checked for their end and check sum, records for version, named fields, lengths and
    digest. What is not right raises an error, or with strict=False is a row with a problem and no other value; after a
    frame whose end can't be found the rest of that file is one problem. An empty archive, or no files, gives no rows;
    other columns of files are not read.
    """
    small_batches(files.sparkSession)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in RECORDS.items()], list(RECORDS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            store, at = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_file(at) as f:
                for r in records(f, path):
                    if strict and "problem" in r:
                        raise Invalid(f"{path} at byte {r['offset']}: {r['problem']}")
                    if not payload:
                        r["payload"] = None
                    rows.append(r)
                    held += 500 + len(r.get("payload") or b"")
                    if held >= BATCH:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    paths = files.select(F.col("path").cast("string").alias("path"))
    return paths.repartition(max(1, paths.count())).mapInArrow(read, SCHEMA)


def unresolved(found: DataFrame) -> DataFrame:
    """record_id, refers_to, n of revisits that name no response with their digest: there should be none."""
    revisits = found.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    there = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest")
    return revisits.join(there, ["refers_to", "payload_digest"], "left_anti")


def _plain(url: str | None) -> str:
    """A URL that fits into a header line: blanks and control characters are written as their bytes."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"


def record_id(page_id: Column, file: Column, row: Column) -> Column:
    """Names a page and the place of its row, so that rows that repeat a page_id have records of their own."""
    place = F.lower(F.lpad(F.hex(F.xxhash64(file, row)), 16, "0"))
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), place, F.lit(">"))


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+):", 1).try_cast("long")


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """record_id, refers_to (null: a response), url, payload for each row of pages.

    Payloads are told apart by SHA-256. A payload's rows are counted in shares first, so no task sees all copies of one;
    only payloads with copies go back to the rows, broadcast if they were counted as few, else by payload and share.
    """
    columns = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_of(pages, html_col).alias("payload")
    rows = located(pages, *columns).withColumnsRenamed(dict(zip(PLACE, ("file", "row"))))
    key = rows.select(F.sha2("payload", 256).alias("digest"), F.pmod(F.xxhash64("file", "row"), F.lit(SHARES)).alias("share"), F.struct("id", "file", "row").alias("rank")).where(F.octet_length("payload") >= least)
    parts = written(key.groupBy("digest", "share").agg(F.max("rank").alias("rank"), F.count("*").alias("n")))
    firsts = parts.groupBy("digest").agg(F.max("rank").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    copies = written(parts.select("digest", "share").join(firsts, "digest").select("digest", "share", record_id(F.col("first.id"), F.col("first.file"), F.col("first.row")).alias("first")), narrow=True)
    told = rows.withColumns({"digest": F.sha2("payload", 256), "share": F.pmod(F.xxhash64("file", "row"), F.lit(SHARES)), "record_id": record_id(F.col("id"), F.col("file"), F.col("row"))})
    joined = told.join(small(copies), ["digest", "share"], "left")
    return joined.select("record_id", F.when(F.col("first") != F.col("record_id"), F.col("first")).alias("refers_to"), "url", "payload")


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = DATE) -> DataFrame:
    """Writes a record per row of pages into archives below folder (that all executors share); returns path, n_records, n_bytes.

    Of rows with equal payloads of at least `least` bytes that with the largest id becomes a response, the others
    revisits of it; of rows that repeat that id the last by place in the input, and a null id is smaller than all
    others. Null pages are empty payloads, null URLs are about:blank; blanks and control characters of URLs are written
    as %XX. Other columns are not read. An empty table gives no archive. The dictionary is trained on about
    TRAINED_PAGES pages, twice as many at most, picked by a hash of their place, which changes no record.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = uri(folder or shared_dir(spark))
    n = pages.count()
    some = located(pages, F.substring(text_of(pages, html_col), 1, TRAINED_CHARS).alias("text"))
    some = some.where(F.shiftrightunsigned(F.xxhash64(*PLACE), 1) < min((1 << 63) - 1, TRAINED_PAGES * (1 << 63) // max(1, n))).limit(2 * TRAINED_PAGES)
    sample = trained([record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:0:>", "WARC-Date": date, "Content-Type": HTTP}, http_header(0) + r.text.encode()) for r in some.collect()])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(sample) if sample else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True).compress
        start = dictionary_frame(sample) if sample else b""
        seq, n, held, size = 0, 0, [start], 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{seq:06d}.warc.zst"
            put(name, b"".join(held))
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [n], "n_bytes": [size + len(start)]})

        for batch in batches:
            for own, refers, url, payload in zip(*(batch.column(c).to_pylist() for c in ("record_id", "refers_to", "url", "payload"))):
                data = payload.encode()
                fields = {"WARC-Type": "revisit" if refers else "response", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": _plain(url)}
                fields |= {"WARC-Refers-To": refers, "WARC-Profile": PROFILE} if refers else {}
                fields |= {"WARC-Payload-Digest": f"sha1:{base32(data)}", "Content-Type": f"{HTTP};msgtype=response"}
                held.append(pack(record(fields, http_header(len(data)) + (b"" if refers else data))))
                n, size = n + 1, size + len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
                    seq, n, held, size = seq + 1, 0, [start], 0
        if n:
            yield close()

    return written(marked(pages, id_col, url_col, html_col, least).mapInArrow(write, "path string, n_records long, n_bytes long"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")), payload=False)
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, payload, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
