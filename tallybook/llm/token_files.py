"""Token ids in files of fixed-width packed bits, and back (operator 10).

One file holds consecutive documents in ascending id order:

    magic      8 bytes  b"TBITS\\x00\\x00\\x01"
    header     5 x uint64, little-endian: bits, ids per block, blocks, documents, ids
    doc_ids    documents x int64 (the smallest int64 stands for null)
    starts     (documents + 1) x uint64, position of each document's first id in this file
    offsets    (blocks + 1) x uint64, byte offset of each block in the payload
    payload    blocks; each packs its ids, most significant bit first, into bits bits apiece and ends on a whole byte

bits is the least width that holds the largest id of the vocabulary. Any id is found from its block's offset, and a
block unpacks with a few numpy operations. A manifest table lists the files in order with their numbers of documents
and ids; the sum over the files before gives each document's place in the whole sequence.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import mapped, put, shared_dir, small_batches, text_of, uri, written
from .words import RecentWords

MAGIC = b"TBITS\x00\x00\x01"
BLOCK = 8192
#: A task closes a file and opens the next after so many ids.
FILE_IDS = 4_000_000
#: Documents that a task encodes at a time.
SLICE = 1000
#: Letters, then stops and signs: the normal form is the word itself, and its pieces are these two.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*)([!-/:-@\[-`{-~]*)")
NULL_ID = np.iinfo(np.int64).min
END = 1


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as a string of bits bits each, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of a packed block, as uint32."""
    if bits in (8, 16, 32):
        return data[: n * bits // 8].view(f">u{bits // 8}").astype(np.uint32)
    flags = np.unpackbits(data, count=n * bits).reshape(n, bits).astype(np.uint32)
    return flags @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def packed_file(doc_ids: list[int], docs: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    lengths = np.array([0, *map(len, docs)], "<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    header = np.array([bits, block, len(blocks), len(docs), len(ids)], "<u8")
    return b"".join([MAGIC, header.tobytes(), np.array(doc_ids, "<i8").tobytes(), np.cumsum(lengths, dtype="<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a packed file that lies in memory or is mapped into it."""

    def __init__(self, data: np.ndarray):
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, n_blocks, n_docs, self.n_ids = map(int, data[8:48].view("<u8"))
        a, b, c = 48 + 8 * n_docs, 56 + 16 * n_docs, 64 + 16 * n_docs + 8 * n_blocks
        self.doc_ids, self.starts, self.offsets, self.payload = data[48:a].view("<i8"), data[a:b].view("<u8"), data[b:c].view("<u8"), data[c:]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin up to end, of which only the blocks that hold them are read."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        parts = [unpack(self.payload[int(self.offsets[k]) : int(self.offsets[k + 1])], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(first, last + 1)]
        return np.concatenate(parts)[begin - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


@lru_cache(maxsize=1)
def _encoder(path: str) -> RecentWords:
    """The tokenizers library behind a bounded memory of words: new words are encoded together, with marks in between.

    Of words whose pieces are certain only the pieces are handed over, straight to the library's model.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def ids(text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    mark, symbols = ids("\x00"), dict(enumerate(byte_symbols()))
    tokenize = library.model.tokenize

    def make(words: list[bytes]) -> list[bytes]:
        done, rest = {}, []
        for word in words:
            if found := PLAIN.fullmatch(word):
                done[word] = array("I", [x.id for piece in found.groups() if piece for x in tokenize(piece.decode("latin-1").translate(symbols))]).tobytes()
            else:
                rest.append(word)
        done.update(zip(rest, together(rest)))
        return [*map(done.__getitem__, words)]

    def together(words: list[bytes]) -> list[bytes]:
        if len(mark) != 1:
            return [ids(w.decode()).tobytes() for w in words]
        plain = [w for w in words if b"\x00" not in w]
        found = ids(b" \x00 ".join(plain).decode())
        at = 4 * np.flatnonzero(found == mark[0])
        data = found.tobytes()
        known = dict(zip(plain, (data[i:j] for i, j in zip([0, *(at + 4).tolist()], [*at.tolist(), len(data)]))))
        return [known[w] if w in known else ids(w.decode()).tobytes() for w in words]

    return RecentWords(make)


MANIFEST = "part long, seq long, path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int | None = END, vocabulary_size: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) and writes packed files in ascending doc_id order; returns the manifest.

    Null doc_ids come first, rows with the same doc_id are ordered by text. Null and empty texts have no ids but
    end_id. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    folder = uri(folder or shared_dir(spark))
    if vocabulary_size is None:
        from tokenizers import Tokenizer

        vocabulary_size = max(Tokenizer.from_file(path).get_vocab().values()) + 1
    bits = bits_for(max(vocabulary_size, (end_id or 0) + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, ids, found, n = _encoder(path).encode, TaskContext.get().partitionId(), 0, [], [], 0
        tail = np.array([] if end_id is None else [end_id], "<u4")

        def close():
            name = f"{folder}/part-{part:06d}-{seq:06d}.tbits"
            put(name, packed_file(ids, found, bits))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [name], "n_docs": [len(ids)], "n_ids": [n]})

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = batch.slice(i, SLICE).to_pydict()
                for doc_id, own in zip(some["doc_id"], encode(some["text"])):
                    ids.append(NULL_ID if doc_id is None else doc_id)
                    found.append(np.concatenate([own.view("<u4"), tail]))
                    n += len(found[-1])
                    if n >= FILE_IDS:
                        yield close()
                        seq, ids, found, n = seq + 1, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32), read from the files."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch.path, batch.before):
                file = TokenFile(mapped(name))
                for i in range(0, len(file.doc_ids), 1024):
                    k = range(i, min(i + 1024, len(file.doc_ids)))
                    found = [file.document(j).astype("<u4") for j in k]
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if x == NULL_ID else x for x in file.doc_ids[k.start : k.stop].tolist()], "Int64"),
                        "start": [start + int(file.starts[j]) for j in k],
                        "n_tokens": [len(x) for x in found],
                        "ids": [x.tobytes() for x in found],
                    })

    files = max(1, manifest.count())
    return placed.select("path", "before").repartition(files).mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
