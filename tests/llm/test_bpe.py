import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallybook.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "Hello, it's 2024!", "<|endoftext|>a<|startoftext|> B", "ΑΣ ΣΑΣ İstanbul été", "日本語 жы x y\x1cz\x85w", "zqxj" * 700, "a" * 20_000, "<|endoftext| <", "don't WE'LL I'd", "A, b. C.\nD!, (e). f.,g ,h 1, 2.", "W\u030a, x. J\u030c A\u0301.", "<|ENDOFTEXT|> a, b.", "́ ́a"]


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    v = bpe.vocabulary(PATH)
    assert v.encode([text])[0].tolist() == want
    assert v.decode(np.array(want, "i4")) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    same(text)


def test_characters_of_every_category_and_marks_in_any_order():
    rng = random.Random(6)
    every = [chr(c) for c in range(0x250, 0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c)]
    texts = [f"a{x}{y}b" for x, y in zip(rng.sample(every, 20_000), rng.sample(every, 20_000))]
    texts += ["a" + "".join(rng.choices(marks, k=rng.choice((2, 3)))) + "e\u0301" for _ in range(20_000)]
    texts += ["a\U0001145e\U00011163f", "a\u1ab3\U00010f83", "a\u1ddc\U00011a47"]
    v = bpe.vocabulary(PATH)
    want = [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in v.encode(texts)] == want


def test_kept_columns_with_names_of_the_result(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, decoded int")
    with pytest.raises(ValueError):
        bpe.encode_decode(docs, keep=("decoded",))


def test_cuts_are_where_no_token_has_the_pair():
    v = bpe.vocabulary(PATH)
    z, q, a = (v.plain[ord(c)] for c in "zqa")
    assert list(v.cut([z, q, a])) == [[z], [q, a]]
    assert not any("zq" in t for t in v.tokens.values()) and any("qa" in t for t in v.tokens.values())


def test_new_words_are_merged_side_by_side(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrstzqx\u00e9\u00df\u00c8'&$.5", k=rng.randrange(1, 30))) for _ in range(5000)]
    words += ["abba" * 15, "abba" * 17, "<", "x<|endoftext|>", "\u0436", "\u00aa1", "\x1c", "a\x1cb"]
    alone = []
    v = bpe.Vocabulary(PATH)
    monkeypatch.setattr(v, "piece", lambda piece, one=v.piece: alone.append(piece) or one(piece))
    want = [x.ids for x in LIBRARY.encode_batch(words, add_special_tokens=False)]
    assert [x.tolist() for x in v.encode(words)] == want
    assert len(alone) < 20 and v.side_by_side([]) == [] and v.side_by_side([" ", "a"]) == [b"", np.array(v.last[97], "<i4").tobytes()]


def test_decode_undoes_encode_on_spark(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == ["one</w> two</w>", ""]


def test_query_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, None, "Hello, it's 2024!"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(docs)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0)).collect() == []
