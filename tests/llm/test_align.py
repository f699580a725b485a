"""Operator 12 against plain loops over the libraries' own tokens of whole texts."""

import hashlib
import os
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallybook.llm import align

os.environ["TOKENIZERS_PARALLELISM"] = "false"
LEFT = Tokenizer.from_file(public_tokenizers.path(align.A))
LEFT.encode_special_tokens = True
RIGHT = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B))
BYTE = align.byte_level()
PATHS = public_tokenizers.path(align.A), public_tokenizers.path(align.B)


def plain(text):
    """(ids of A, ids of B, [(ids of A, ids of B) of each group]); None without tokens."""
    if not text:
        return None
    a, b = LEFT.encode(f" {text}", add_special_tokens=False), RIGHT.encode(text)
    left = [bytes(BYTE[c] for c in t) for t in a.tokens]
    right = [bytes([int(p[3:5], 16)]) if RIGHT.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(RIGHT.id_to_piece, b))]
    if not b"".join(left) == b"".join(right) == f" {text}".encode():
        return None
    groups, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(left) or j < len(right):
        if x <= y:
            groups[-1][0].append(a.ids[i])
            x, i = x + len(left[i]), i + 1
        else:
            groups[-1][1].append(b[j])
            y, j = y + len(right[j]), j + 1
        if x == y:
            groups.append(([], []))
    return a.ids, b, groups[:-1]


def expected(texts):
    docs = [plain(t) for t in texts]
    links = [Counter((p, q) for x, y in (d[2] if d else []) for p in x for q in y) for d in docs]
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for d, own in zip(docs, links):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in d[2]) if d else None
        n_best, total = sum(n for k, n in own.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in own.items())
        out.append((*(map(len, d) if d else (0, 0, 0)), sum(own.values()), n_best, total, hashlib.sha256(shown.encode()).hexdigest() if d else ""))
    return out


TEXTS = [
    "Plain words, and more words.", "", None, "<|endoftext|> and <s> </s> <unk> are text", "white  space\n\n\tand tabs \r\n end \n", "ünïcödé 漢字かな 😀👩‍👩‍👧 naïve",
    "no break spaces​  here \u0085x", "a lower block ▁ is no blank", " leading", "trailing   ", "   ", "\n", "'s it's 'S don't", "1234567890 12 3.4e-5", "aaaaaaaaaaaaaaaa" * 300,
    "nul \x00 and \x1c\x1f bytes!\x1c! x", "Plain words, and more words.", "the end. " * 200, "﻿mark", "é combining", "x" * 30 + "=" * 50, "ſt ﬁ Ⅷ ½ ²",
]


@pytest.mark.parametrize("limits", [{}, {"COUNTED": 20, "SLICE": 40, "UNITS": 5, "ENCODED": 30}])
def test_rows(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(align, name, value)
    ids = [*range(len(TEXTS) - 1), None]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in zip(ids, TEXTS)], "doc_id long, text string, row int, pairs string").repartition(3)
    got = align.alignment(docs).collect()
    want = [(i, *r) for i, r in zip(ids, expected(TEXTS))]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert order(map(tuple, got)) == order(want)
    assert align.alignment(docs.limit(0)).collect() == []


def test_joins_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tallybook.llm.common.BROADCAST_ROWS", 3)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert sorted(map(tuple, align.alignment(docs).collect())) == [(i, *r) for i, r in enumerate(expected(TEXTS))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the'sS.,!?1 9\n\t  éß漢▁😀_-\x1c​") | st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
def test_groups_of_any_text(texts):
    docs, table = align._units(*PATHS).documents(texts)
    for text, units in zip(texts, docs):
        want = plain(text)
        assert (want is None) == (not units)
        if want:
            assert ";".join(table[u][3] for u in units) == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want[2])
            assert [sum(table[u][k] for u in units) for k in range(3)] == list(map(len, want))
