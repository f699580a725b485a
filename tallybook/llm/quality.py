"""Document quality by supervised subword embeddings (operator 9).

Hashed words, hashed character n-grams of words, and a mark for a word that repeats the one before have learned vectors.
A document is the average of its vectors; a softmax layer on it gives the two classes. Vectors and layer are trained by
plain stochastic gradient descent in numpy on a bounded sample of labelled documents. As the layer is linear, a word's
share of the class scores is fixed once trained, so scoring sums a bounded cache of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, small_batches, text_of
from .toxicity import sampled

#: The model is trained on at most about so many labelled documents of either class, taken by a hash of the id.
SAMPLE = 1500
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 12
#: Steps at least; a small sample is gone through more often.
STEPS = 15_000
RATE = 1.0
GRAMS = (2, 3, 4)
#: A document is predicted to be good from this score on.
GOOD = 0.3
#: Documents that a task scores at a time.
SLICE = 500
#: Words that a worker keeps; all are dropped when it is full, which changes no score.
CACHE = 400_000
#: A longer word counts in pieces of so many characters; its n-grams go over the pieces' ends. It is not kept in the cache.
LONGEST = 40
#: Characters of a longer word that are worked on at a time (a multiple of LONGEST), and such parts at a time.
PART, PARTS = 100 * LONGEST, 50
#: Buckets beyond the hashed ones: a word that repeats the one before, a text without words. Each weighs like a usual word.
REPEAT, EMPTY, WEIGHT = BUCKETS, BUCKETS + 1, 8
P, M = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(LONGEST, P)]))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * M
    return ((h ^ (h >> np.uint64(29))) * M >> np.uint64(32)) % np.uint64(BUCKETS)


def counts(size: np.ndarray) -> np.ndarray:
    """Features of words by their length with marks: their pieces (one up to LONGEST) and their n-grams."""
    return -(-size // LONGEST) + sum(np.maximum(0, size - g + 1) for g in GRAMS)


def is_long(word: str) -> bool:
    return len(word) + 2 > LONGEST


def parts_of(word: str) -> Iterator[str]:
    """A word with marks in parts of PART characters, each with those that its last n-grams need of the next one."""
    word = f"<{word}>"
    return (word[i : i + PART + max(GRAMS) - 1] for i in range(0, len(word), PART))


def long_features(words: Iterable[str]) -> Iterator[np.ndarray]:
    """The buckets of long words, a bounded number at a time."""
    parts = (part for word in words for part in parts_of(word))
    while some := list(islice(parts, PARTS)):
        yield features_of(some)[0]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams, word after word, and where each word's begin."""
    return features_of([f"<{w}>" for w in words])


def features_of(marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words with marks, or parts of them: what begins in the first PART characters."""
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    begin = np.cumsum(size) - size
    owner, place = np.repeat(np.arange(len(marked)), size), np.arange(len(chars))
    left, inside = np.repeat(begin + size, size) - place, place - np.repeat(begin, size)
    own = inside < PART
    heads = np.flatnonzero(own & (inside % LONGEST == 0))
    found, owners = [_bucket(np.add.reduceat(np.where(own, chars * POWERS[inside % LONGEST], np.uint64(0)), heads), 0)], [owner[heads]]
    for n in GRAMS:
        at = place[own & (left >= n)]
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * P + chars[at + k]
        found.append(_bucket(h, n))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order, each = np.argsort(owners, kind="stable"), np.bincount(owners, minlength=len(marked))
    return np.concatenate(found)[order].astype(np.int64), np.cumsum(each) - each


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


class Model:
    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.offset = float(bias[1] - bias[0])
        self.gain = vectors @ (layer[:, 1] - layer[:, 0])  # what each bucket adds to the difference of the class scores
        self.words: dict[str, float] = {}

    def scores(self, texts: list[str]) -> list[float]:
        docs, known = [t.split() for t in texts], self.words
        every = [w for w in set().union(*docs) if not is_long(w)]
        new = [w for w in every if w not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = every
        if new:
            at, begin = word_features(new)
            known.update(zip(new, np.add.reduceat(self.gain[at], begin).tolist()))
        out = []
        for words in docs:
            again = WEIGHT * repeats(words)
            if words:
                size = np.fromiter(map(len, words), np.int64, len(words)) + 2
                n, total = int(counts(size).sum()) + again, again * self.gain[REPEAT]
                if size.max() > LONGEST:
                    total += sum(float(self.gain[at].sum()) for at in long_features(filter(is_long, words)))
                    words = [w for w in words if not is_long(w)]
                total += sum(map(known.__getitem__, words))
            else:
                total, n = WEIGHT * self.gain[EMPTY], WEIGHT
            out.append(float(1 / (1 + np.exp(np.clip(-(total / n + self.offset), -60, 60)))))
        return out


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document and their shares."""
    words = text.split()
    if not words:
        return np.array([EMPTY]), np.ones(1)
    counted = Counter(w for w in words if not is_long(w))
    total = np.zeros(REPEAT + 1)
    total[REPEAT] = WEIGHT * repeats(words)
    if counted:
        at, begin = word_features(list(counted))
        total += np.bincount(at, np.repeat(np.array(list(counted.values())), np.diff(np.append(begin, len(at)))), REPEAT + 1)
    for at in long_features(filter(is_long, words)):
        total += np.bincount(at, minlength=REPEAT + 1)
    used = np.flatnonzero(total)
    return used, total[used] / total.sum()


def train_sgd(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """docs: for each document its buckets and their shares (summing to 1); classes weigh alike."""
    rng = np.random.default_rng(seed)
    vectors, layer, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 2, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    epochs = max(EPOCHS, STEPS // len(docs))
    for epoch in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            step = RATE * (1 - epoch / epochs) * weight[labels[i]]
            hidden = share @ vectors[at]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= 0.1 * step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            vectors[at] -= 20 * step * share[:, None] * back
    return Model(vectors, layer, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, from docs (doc_id, text) that labels (doc_id, quality) marks; None if either class is absent.

    Only the sampled documents' features come to the driver; sample bounds their number.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, label, text in zip(batch.doc_id, batch.label, batch.text):
                at, share = document_features(text)
                yield pd.DataFrame({"doc_id": [doc_id], "label": [label], "at": [at.astype("<i4").tobytes()], "share": [share.astype("<f4").tobytes()]})

    small_batches(docs.sparkSession)
    chosen = sampled(labels, "quality", sample)
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(small(chosen, 4 * sample), "doc_id")
    rows = texts.mapInPandas(features, "doc_id long, label int, at binary, share binary").toPandas()
    if rows.label.nunique() < 2:
        return None
    rows = rows.sort_values(["doc_id", "at"], ignore_index=True)
    return train_sgd([(np.frombuffer(a, "<i4"), np.frombuffer(s, "<f4").astype(float)) for a, s in zip(rows["at"], rows["share"])], rows.label.to_numpy())


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from: the CRC-32 of the id as text leaves no remainder by 5; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1, the probability of a good document), predicted (1 from GOOD on).

    Null and empty texts, and texts of white space only, have one feature of their own; repeated rows score alike; texts are
    read whole; without a model every score is 0.5. Columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_of(docs).alias("text"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [model.scores(list(texts.iloc[i : i + SLICE])) for i in range(0, len(texts), SLICE)]
        return pd.Series([x for part in parts for x in part], dtype="float64")

    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (score("text") if model else F.lit(0.5)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, train(docs, labels.where(~held_out(F.col("doc_id")))))
