"""Severity of toxic language by cumulative-link ordinal regression (operator 2).

Texts are counts of words and word beginnings, of which the most telling ones by chi-square are kept. One weight vector
w is shared by all grades; P(grade <= g) = sigmoid(threshold_g - w.x) with thresholds in ascending order, and the
expected severity is the sum of P(grade > g) over the thresholds.

Labels only say whether a document is toxic. Its grade comes from how much it holds of the features that occur almost
only in toxic documents: grade 0 for documents that are not toxic, 1 to 3 by thirds of that amount among the toxic ones.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, small, small_batches, text_of, written

#: The model is fitted on at most about so many labelled documents of either label, taken by a hash of the id.
SAMPLE = 3000
#: Features that the model keeps.
FEATURES = 1024
#: A kept feature occurs in at least so many of the sampled documents.
LEAST_DOCS = 5
BEGINNINGS = (4, 5, 6)
#: Features of which this share of documents is toxic count towards the grade.
TELLING = 0.95
#: A document is rejected from this probability of a grade above 0.
REJECT = 0.5
CACHE = 100_000
WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


def text_features(text: str) -> Counter:
    found: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in word_features(word):
            found[f] += n
    return found


class Ordinal:
    """Weights, ascending thresholds and the index of each feature."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.index, self.weights, self.thresholds = index, weights, thresholds
        self.words: dict[str, tuple[int, ...]] = {}

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > g) for each threshold g, from w.x."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -60, 60)))

    def score(self, text: str) -> float:
        """w.x of a whole text; words are looked up in a bounded cache."""
        counts: dict[int, int] = {}
        for word in WORD.findall(text.lower()):
            found = self.words.get(word)
            if found is None:
                if len(self.words) >= CACHE:
                    self.words.clear()
                found = self.words[word] = tuple([self.index[f] for f in word_features(word) if f in self.index])
            for i in found:
                counts[i] = counts.get(i, 0) + 1
        return float(sum(self.weights[i] * np.log1p(n) for i, n in counts.items()))


def fit(x: np.ndarray, grade: np.ndarray, rounds: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient steps (Adam) on the mean log-likelihood with a ridge penalty."""
    k = int(grade.max())
    weights = np.zeros(x.shape[1])
    raw = np.concatenate([[1.0], np.zeros(k - 1)])  # first threshold, then logs of the gaps
    state = [np.zeros(x.shape[1] + k), np.zeros(x.shape[1] + k)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    n = len(x)
    for step in range(1, rounds + 1):
        gaps = np.exp(raw[1:])
        edges = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        z = x @ weights
        upper, lower = sigmoid(edges[grade + 1] - z), sigmoid(edges[grade] - z)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_w = -(x.T @ (dl - du)) / n + ridge * weights
        g_edge = np.array([(dl[grade == g + 1].sum() - du[grade == g].sum()) / n for g in range(k)])
        tail = np.cumsum(g_edge[::-1])[::-1]
        gradient = np.concatenate([g_w, [tail[0]], tail[1:] * gaps])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        weights, raw = weights - move[: len(weights)], raw - move[len(weights) :]
    return weights, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def sampled(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, label): at most about bound labelled ids of each label, by a hash of the id."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share, all_of = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(label)), 1), 1 << 63
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("label") == value) & (share <= min(all_of, bound * all_of // n) - 1))
    return one.where(keep)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Ordinal | None:
    """The model, from docs (doc_id, text) that labels (doc_id, toxic) marks; None if either label is absent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            rows = [(d, y, f, n) for d, y, t in zip(batch.doc_id, batch.label, batch.text) for f, n in text_features(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "feature", "n"])

    small_batches(docs.sparkSession)
    chosen = sampled(labels, "toxic", sample)
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(small(chosen, 4 * sample), "doc_id")
    counts = written(texts.mapInPandas(count, "doc_id long, label int, feature string, n int"))
    sizes = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    by = counts.groupBy("feature").agg(F.count_if(F.col("label") == 1).cast("double").alias("a"), F.count_if(F.col("label") == 0).cast("double").alias("b"))
    one, none = float(sizes[1]), float(sizes[0])
    gap = F.col("a") * (none - F.col("b")) - F.col("b") * (one - F.col("a"))
    chi = (one + none) * gap * gap / ((F.col("a") + F.col("b")) * (one + none - F.col("a") - F.col("b") + 1e-9) * one * none)
    top = by.where(F.col("a") + F.col("b") >= LEAST_DOCS).withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(features).collect()
    if not top:
        return None
    index = {r.feature: i for i, r in enumerate(top)}
    share = np.array([(r.a / one) / (r.a / one + r.b / none) for r in top])
    # from an Arrow table, as a list would start a second set of Python workers on the executors
    picked = docs.sparkSession.createDataFrame(pa.table({"feature": list(index), "i": pa.array(range(len(index)), pa.int32())}))
    held = counts.join(F.broadcast(picked), "feature").select("doc_id", "i", "n").toPandas()
    ids = counts.select("doc_id", "label").distinct().toPandas().sort_values("doc_id", ignore_index=True)
    x = np.zeros((len(ids), len(index)))
    np.maximum.at(x, (np.searchsorted(ids.doc_id.to_numpy(), held.doc_id.to_numpy()), held.i.to_numpy()), np.log1p(held.n.to_numpy()))
    toxic = ids.label.to_numpy() == 1
    amount = x[:, share >= TELLING].sum(1)
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(amount[toxic], [1 / 3, 2 / 3]), amount, side="left"), 0)
    _, grade = np.unique(grade, return_inverse=True)  # grades without a document are left out
    return Ordinal(index, *fit(x, grade))


def scores(text: Column, model: Ordinal) -> Column:
    """(p_toxic, severity) of a text that is not null."""

    @F.pandas_udf("struct<p_toxic double, severity double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        let_go()
        above = model.above(np.array([model.score(t) for t in texts]))
        return pd.DataFrame({"p_toxic": above[:, 0], "severity": above.sum(1)})

    return score(text)


def severity(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """docs with p_toxic (probability of a grade above 0) and severity (expected grade) at the end.

    Null and empty texts score like texts without any feature; repeated rows score alike; texts are read whole; without
    a model both are 0. Columns of docs that have these names are replaced.
    """
    small_batches(docs.sparkSession)
    rows = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("p_toxic", "severity")]
    if model is None:
        return docs.select(*rows, F.lit(0.0).alias("p_toxic"), F.lit(0.0).alias("severity"))
    found = docs.select(F.struct(*rows).alias("row"), scores(text_of(docs), model).alias("s"))
    return found.select("row.*", "s.p_toxic", "s.severity")


def as_json(model: Ordinal) -> str:
    """The model as text, for keeping it beside its results."""
    return json.dumps({"features": list(model.index), "weights": model.weights.tolist(), "thresholds": model.thresholds.tolist()})


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """docs without those whose probability of a grade above 0 reaches reject; all columns stay, whatever their names.

    Null and empty texts have no feature, and rows that repeat a text fare alike; an empty table gives an empty one. Without
    labels of both kinds there is no model, and all rows stay.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    return docs if model is None else docs.where(scores(text_of(docs), model)["p_toxic"] < reject)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = severity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", "p_toxic", "severity", (F.col("p_toxic") >= REJECT).alias("toxic"))
