import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallybook.llm import ngram


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [None]


def brute(rows):
    """Modified Kneser-Ney in plain dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    uni, pairs = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            ws = words(t)
            uni.update(ws)
            pairs.update(zip(["<s>", *[("w", w) for w in ws[:-1]]], ws))
    n, v, types = sum(uni.values()), len(uni), Counter(w for _, w in pairs)
    of, after = Counter(), defaultdict(Counter)
    for (b, w), c in pairs.items():
        of[b] += c
        after[b][min(c, 3)] += 1
    d = ngram.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = ngram.discounts([sum(c == k for c in types.values()) for k in (1, 2, 3, 4)])
    rest = sum(e[min(c, 3)] for c in types.values())
    t = len(pairs)
    q = lambda w: (max(types[w] - e[min(types[w], 3)], 0) + rest / (v + 1)) / t

    def p(b, w):
        if not of[b]:
            return q(w)
        c = pairs[b, w]
        return max(c - d[min(c, 3)], 0) / of[b] + sum(d[k] * m for k, m in after[b].items()) / of[b] * q(w)

    out = {}
    for i, text in rows:
        ws = words(text)
        score = sum(math.log10(p(b, w)) for b, w in zip(["<s>", *[("w", w) for w in ws[:-1]]], ws))
        out[i] = (held[i], len(ws), sum(w in uni for w in ws), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), score)
    return out, p, uni


def corpus():
    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(base, [1 / (k + 1) for k in range(40)], k=rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " \n", "New WORDS É é here", "the " * 5000, "w1\x0bw2\tw3"]
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk, most_heavy", [(3_000_000, 20_000), (300, 20_000), (300, 2)])
def test_as_plain_counting(spark, chunk, most_heavy, monkeypatch):
    monkeypatch.setattr(ngram, "CHUNK", chunk)
    monkeypatch.setattr(ngram.train, "__defaults__", ("text", chunk, most_heavy))
    monkeypatch.setattr(ngram, "LOOK", 1)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    want, p, uni = brute(rows)
    got = {r.doc_id: tuple(r)[1:] for r in ngram.language_scores(docs).collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:4] == row[:4]
        assert got[i][4:] == pytest.approx(row[4:], rel=1e-9)
    for b in ("<s>", ("w", "w1"), ("w", "never")):
        assert sum(p(b, w) for w in [*uni, "unknown"]) == pytest.approx(1)


def test_nothing_to_learn_and_empty(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(only, "a b")], "doc_id long, text string")
    (row,) = ngram.language_scores(docs).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert ngram.language_scores(docs.limit(0)).collect() == []


def test_short_documents_fill_no_shard(spark, monkeypatch):
    """Every document begins with another word, so the start stands before more pairs than any word."""
    monkeypatch.setattr(ngram, "LOOK", 1)
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, f"a{i} b{rng.randrange(3000)} c{rng.randrange(3000)}") for i in range(8000)], "doc_id long, text string")
    model = ngram.train(docs, size=1000)
    sizes = [int(x.view("<u8")[0]) for x in (ngram.mapped(f"{model.folder}/pairs-{k:06d}")[:8] for k in range(model.shards))]
    assert model.shards > 15 and max(sizes) < 2 * sum(sizes) / len(sizes)
