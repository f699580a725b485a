"""Severity and quality models, on a small corpus of which each knows one half."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import quality, toxicity

BASE = [a + b + c for a in ("ba", "re", "lo", "mi") for b in ("na", "to", "ri", "su") for c in ("l", "m", "n", "st")]


def corpus(n, seed):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(BASE) for _ in range(rng.randrange(30, 80))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if not good:
            words = [w for w in words[:12] for _ in range(6)] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(rng.choice([1, 3, 9])):
                words.insert(rng.randrange(len(words)), rng.choice(["vilescum", "grotzig", "grotzige"]))
        docs.append((i, " ".join(words), "extra"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus(500, 1)
    odd = [(900, None, ""), (901, "", ""), (902, " \n", ""), (903, "grotzig " * 20_000, ""), (904, docs[0][1], ""), (905, docs[0][1], "")]
    d = spark.createDataFrame([*docs, *odd], "doc_id long, text string, severity string").repartition(3)
    known = spark.createDataFrame([r for r in labels if r[0] % 2] + [(None, 1, 1), (5000, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return d, known, labels


def test_severity(frames):
    docs, known, labels = frames
    model = toxicity.train(docs, known)
    assert (np.diff(model.thresholds) > 0).all()
    found = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert len(found) == 506 and set(found[0].asDict()) == {"doc_id", "text", "p_toxic", "severity"}
    wrong = [i for i, _, toxic in labels if i % 2 == 0 and (found[i].p_toxic >= toxicity.REJECT) != toxic]
    assert len(wrong) <= 5
    assert all(0 <= r.p_toxic <= r.severity <= len(model.thresholds) for r in found.values())
    assert found[903].severity > 1.5 and found[900].p_toxic == found[901].p_toxic == found[902].p_toxic < 0.5
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == ["doc_id", "text", "severity"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.p_toxic < toxicity.REJECT}


def test_severity_without_labels(spark, frames):
    docs, known, _ = frames
    assert toxicity.train(docs, known.where("toxic = 0")) is None
    assert toxicity.train(docs.limit(0), known) is None
    assert {r.severity for r in toxicity.severity(docs, None).collect()} == {0.0}
    assert toxicity.severity(docs.limit(0), None).collect() == []


def test_thresholds_order_grades():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    z = x @ [1.5, -1.0, 0.0]
    grade = np.searchsorted([-1.0, 0.5, 2.0], z + 0.1 * rng.normal(size=400))
    weights, thresholds = toxicity.fit(x, grade)
    assert (np.diff(thresholds) > 0).all()
    guess = (1 / (1 + np.exp(thresholds[None, :] - (x @ weights)[:, None]))).sum(1)
    assert np.corrcoef(guess, grade)[0, 1] > 0.9


def test_quality(frames):
    docs, known, labels = frames
    model = quality.train(docs, known.where(~quality.held_out(known.doc_id)))
    found = {r.doc_id: r for r in quality.quality(docs, model).collect()}
    assert len(found) == 506 and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.GOOD) for r in found.values())
    wrong = [i for i, good, _ in labels if i % 2 == 0 and found[i].predicted != good]
    assert len(wrong) <= 10
    assert found[904].score == found[905].score == found[0].score and found[900].score == found[901].score


def test_quality_without_labels(frames):
    docs, known, _ = frames
    assert quality.train(docs, known.where("quality = 1")) is None
    assert {r.score for r in quality.quality(docs, None).collect()} == {0.5}
    assert quality.quality(docs.limit(0), None).collect() == []


def test_long_words_count_whole():
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefgh") for _ in range(9001))
    other = word[:4500] + "z" + word[4501:]
    gain = np.random.default_rng(6).normal(0, 1, quality.BUCKETS + 2)
    model = quality.Model(np.stack([gain, np.zeros_like(gain)], 1), np.array([[0.0, 1.0], [0.0, 0.0]]), np.zeros(2))
    assert model.scores([word]) != model.scores([other]) and not model.words
    marked = f"<{word}>"
    grams = sum(len(marked) - n + 1 for n in quality.GRAMS)
    assert sum(len(at) for at in quality.long_features([word])) == grams + -(-len(marked) // quality.LONGEST)
    # all of its n-grams, whatever the size of the parts
    whole = Counter()
    for at in quality.long_features([word]):
        whole.update(at.tolist())
    for n in quality.GRAMS:
        for i in range(0, len(marked) - n + 1, 97):
            h = np.zeros(1, np.uint64)
            for c in marked[i : i + n]:
                h = h * quality.P + np.uint64(ord(c))
            assert whole[int(quality._bucket(h, n)[0])]
    for text in (f"short {word} words short", f"{word} {word}"):
        at, share = quality.document_features(text)
        assert model.scores([text])[0] == pytest.approx(1 / (1 + np.exp(-float((gain[at] * share).sum()))))


def plain_quality(model, text):
    """A document's score from every feature on its own: pieces of 40 characters, character n-grams, repeats."""
    mask = (1 << 64) - 1

    def bucket(h, kind):
        h = (h + kind) * int(quality.M) & mask
        return ((h ^ (h >> 29)) * int(quality.M) & mask) >> 32

    p, words, found = int(quality.P), text.split(), []
    for word in words:
        word = f"<{word}>"
        for i in range(0, len(word), 40):
            found.append(bucket(sum(ord(c) * pow(p, k, 1 << 64) for k, c in enumerate(word[i : i + 40])) & mask, 0) % quality.BUCKETS)
        for n in (2, 3, 4):
            for i in range(len(word) - n + 1):
                h = 0
                for c in word[i : i + n]:
                    h = (h * p + ord(c)) & mask
                found.append(bucket(h, n) % quality.BUCKETS)
    found += [quality.REPEAT] * 8 * sum(a == b for a, b in zip(words, words[1:])) if words else [quality.EMPTY]
    return 1 / (1 + math.exp(-(sum(model.gain[i] for i in found) / len(found) + model.offset)))


def test_quality_scores_as_from_every_feature_alone(spark, monkeypatch):
    monkeypatch.setattr(quality, "CACHE", 30)
    monkeypatch.setattr(quality, "SLICE", 3)
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(0, 30, (quality.BUCKETS + 2, quality.DIM)), rng.normal(0, 1, (quality.DIM, 2)), rng.normal(0, 1, 2))
    letters = list("abcdeéß漢字😀")
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 12)))
    texts = [None, "", " \n", "a", "a a a", "漢字" * 4000, "x" * 38, "x" * 39, "y " * 50 + "z" * 4001] + [" ".join(word() for _ in range(rng.integers(1, 40))) for _ in range(30)]
    texts += texts[-3:]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r.score for r in quality.quality(docs, model).collect()}
    assert all(abs(got[i] - plain_quality(model, t or "")) < 1e-9 for i, t in enumerate(texts))
    assert len({round(x, 6) for x in got.values()}) > 20


def test_severity_as_from_every_feature_alone(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 10)
    index = {f: i for i, f in enumerate(["=bad", "badl*", "badly*", "=ok", "okay*", "überm*", "übermu*"])}
    weights, thresholds = np.array([1.0, 0.5, -0.25, 2.0, 0.75, 1.5, -3.0]), np.array([0.5, 1.75, 4.0])
    texts = [None, "", "bad BAD, ok-okay", "badly badlybad übermut_ÜBERMUT " * 50, "nothing here", "okays " * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, severity int")
    got = {r.doc_id: (r.p_toxic, r.severity) for r in toxicity.severity(docs, toxicity.Ordinal(index, weights, thresholds)).collect()}
    for i, t in enumerate([*texts, texts[2]]):
        words = re.findall(r"[^\W_]+", (t or "").lower())
        x = 0.0
        for f, k in index.items():
            n = sum(w == f[1:] if f[0] == "=" else len(w) >= len(f) - 1 and w.startswith(f[:-1]) for w in words)
            x += weights[k] * math.log1p(n)
        above = [1 / (1 + math.exp(h - x)) for h in thresholds]
        assert abs(got[i][0] - above[0]) < 1e-12 and abs(got[i][1] - sum(above)) < 1e-12


def test_thresholds_and_weights_are_where_the_likelihood_is_highest():
    """No small step in any parameter of a fitted cumulative-link model makes the sample likelier."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 3))
    grade = np.digitize(x @ [1.5, -1.0, 0.0] + rng.logistic(0, 1, 400), [-0.5, 1.0, 2.5])

    def loss(w, t):
        below = lambda e: 1 / (1 + np.exp(-(e - x @ w)))
        edges = np.array([*t, np.inf]), np.array([-np.inf, *t])
        return -np.log(below(edges[0][grade]) - below(edges[1][grade])).mean() + 0.5e-4 * w @ w

    w, t = toxicity.fit(x, grade, rounds=2000, rate=0.05)
    assert list(t) == sorted(t)
    for i in range(3):
        for step in (-0.02, 0.02):
            move = step * np.eye(3)[i]
            assert loss(w + move, t) > loss(w, t) and loss(w, t + move) > loss(w, t)
