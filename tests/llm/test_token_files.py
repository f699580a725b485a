import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallybook.llm import token_files

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 20), st.lists(st.lists(st.integers(0, 2**20 - 1), max_size=40), max_size=8), st.integers(1, 16))
def test_packed_and_back(bits, docs, block):
    docs = [np.array(d, np.uint32) & np.uint32((1 << bits) - 1) for d in docs]
    file = token_files.TokenFile(np.frombuffer(token_files.packed_file(list(range(len(docs))), docs, bits, block), np.uint8))
    assert [file.document(k).tolist() for k in range(len(docs))] == [d.tolist() for d in docs]


def test_width():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("most", [4_000_000, 3])
def test_query_rows(spark, most, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", most)
    rows = [(7, "A b. C,"), (3, None), (5, ""), (1, "nul \x00 x\x00y, <|endoftext|>z."), (None, "null id"), (5, "same id"), (9, "w " * 30_000), (-2, "A b. C,")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, path int").repartition(3)
    got = token_files.read_tokens(token_files.write_tokens(docs)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in ordered:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == sorted((s, i, n, c) for i, s, n, c in want)
    none = docs.limit(0)
    assert token_files.read_tokens(token_files.write_tokens(none)).collect() == []


def test_certain_pieces_go_straight_to_the_model():
    words = [b"abc", "\u00e9t\u00e9&&&".encode(), b"...", b"'s", b"<|", b"a'", b"x1", b"n'est", "\u00c9a".encode(), "\u00f7a".encode(), b"\x00", b"<|endoftext|>"]
    assert [bool(token_files.PLAIN.fullmatch(w)) for w in words] == [True] * 3 + [False] + [True] * 2 + [False] * 6
    encoder = token_files._encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.make(words)]
    assert got == [LIBRARY.encode(w.decode(), add_special_tokens=False).ids for w in words]
