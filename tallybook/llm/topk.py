"""Exact top-k search by inner product over norm buckets (operator 3).

Candidates are sorted by length into buckets of at most BUCKET vectors, longest first. A first pass over the bucket of
the longest vectors gives each query a score that its k-th best result cannot fall below. In every other bucket that
score, divided by the query's length and the bucket's greatest length, is the cosine that a vector there must reach:

* above one, the bucket is skipped;
* high (from COORDINATE on), vectors are pruned by the query's largest coordinate: a unit vector whose cosine with the
  query is at least t has that coordinate within q*t -+ sqrt((1-q*q)(1-t*t));
* lower, they are pruned by length alone: those at least as long as the score divided by the query's length, which in a
  bucket sorted by length are a prefix.

What is left is verified with exact integer products, and the k best of all buckets are ranked at the end. Queries go
against buckets in blocks; a block of queries and a bucket are one row each, so every task holds a bounded number of
vectors, and a vector that occurs very often fills buckets like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, written

BUCKET = 2048
QUERIES = 1024
COORDINATE = 0.9
#: Query blocks are broadcast only if they were counted and are at most so many; else they meet the buckets in a shuffle.
SENT = 16
SHARES = 64


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, vec array<long>, norm2): floor(256 * x) of every component of the usable vectors."""
    v = F.col("vec")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable)
    ints = ints.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 256).cast("long")))
    return ints.select("vec_id", F.size("vec").alias("dim"), "vec", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("norm2"))


BLOCK_SCHEMA = "dim int, block long, n int, longest double, ids binary, data binary"


def _bytes(rows: list) -> bytes:
    """The rows' components in the narrowest of 16, 32 and 64 bits that holds them all."""
    ints = np.array(rows, "<i8")
    top = np.abs(ints).max() if ints.size else 0
    return ints.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8").tobytes()


def matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    """The components, in as many bits as they are packed in."""
    return np.frombuffer(data, f"<i{len(data) // (n * dim) if n * dim else 8}").reshape(n, dim)


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in a type in which all of their inner products are exact: doubles, 64-bit integers or Python's."""
    top = lambda m: max(int(m.max()), -int(m.min())) if m.size else 0
    most = top(q) * top(x) * max(1, q.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return q.astype(kind), x.astype(kind)


def _blocks(size: int):
    """Packs the rows of a partition into blocks of one dimension and at most size vectors, in the order they come."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, dim = TaskContext.get().partitionId() << 32, [], None

        def close():
            nonlocal block, held
            block += 1
            row = (dim, block, len(held), max(r[2] for r in held) ** 0.5, np.array([r[0] for r in held], "<i8").tobytes(), _bytes([r[1] for r in held]))
            held = []
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for vec_id, d, vec, norm2 in zip(batch.vec_id, batch.dim, batch.vec, batch.norm2):
                if held and (d != dim or len(held) == size):
                    yield close()
                dim = d
                held.append((vec_id, vec, norm2))
        if held:
            yield close()

    return pack


def search_bucket(q_ids, q, floors, ids, x, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in one bucket (rows by length, longest first) not below its floor."""
    q, x = exact(q, x)
    q_norm, x_norm = np.linalg.norm(q.astype(float), axis=1), np.linalg.norm(x.astype(float), axis=1)
    out: list[tuple[int, int, int]] = []
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floors > -np.inf, floors, -np.inf)
        least = np.where(q_norm > 0, need / q_norm, np.where(need > 0, np.inf, -np.inf))  # length along the query
        cosine = np.where(x_norm[0] > 0, least / x_norm[0], np.where(least > 0, np.inf, -np.inf))
    live = cosine <= 1 + slack
    prefix = np.where(least > 0, np.searchsorted(-x_norm, -(least * (1 - slack)) , side="right"), len(x))
    by_coordinate = live & (cosine >= COORDINATE)
    unit = x.astype(float) / np.where(x_norm > 0, x_norm, 1)[:, None] if by_coordinate.any() else None

    def best(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        ok = (ids[rows] != q_ids[i]) & (scores >= floors[i])
        rows, scores = rows[ok], scores[ok]
        if len(rows) > k:
            edge = np.sort(scores)[len(scores) - k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= edge], scores[scores >= edge]
        order = np.lexsort((ids[rows], -scores))[:k]
        out.extend((int(q_ids[i]), int(ids[rows[o]]), int(scores[o])) for o in order)

    for i in np.flatnonzero(by_coordinate):
        t, f = min(1.0, float(cosine[i])), int(np.argmax(np.abs(q[i])))
        c = float(q[i, f]) / q_norm[i]
        around = np.sqrt(max(0.0, (1 - c * c) * (1 - t * t))) + slack
        low, high = -1 - slack if c <= -t else c * t - around, 1 + slack if c >= t else c * t + around
        x_f = unit[: prefix[i], f]
        rows = np.flatnonzero((x_f >= low) & (x_f <= high))
        best(i, rows, x[rows] @ q[i])
    rest = np.flatnonzero(live & ~by_coordinate)
    for at in range(0, len(rest), 256):
        some = rest[at : at + 256]
        top = int(prefix[some].max())
        scores = q[some] @ x[:top].T
        for i, row in zip(some, scores):
            best(i, np.arange(prefix[i]), row[: prefix[i]])
    return out


RESULT = "query_id long, vec_id long, score long"


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, bucket: int = BUCKET, sent: int = SENT) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with the rows of candidates.

    Both sides are (vec_id, dim, vec, norm2) as from quantised(). A query never meets rows with its own vec_id; ties go
    to the smaller vec_id; with fewer than k candidates all are returned. Vectors meet only vectors of their own
    dimension. Repeated candidate rows are candidates each; a vec_id repeated among the queries is answered for its
    smallest vector. Rows without an id are neither queries nor candidates. Empty tables give an empty result.
    """
    small_batches(candidates.sparkSession)
    candidates = candidates.where("vec_id is not null")
    ordered = candidates.repartitionByRange("dim", F.desc("norm2"), "vec_id").sortWithinPartitions("dim", F.desc("norm2"), "vec_id")
    buckets = written(ordered.mapInPandas(_blocks(bucket), BLOCK_SCHEMA))
    asked = queries.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "norm2")).alias("q")).select("vec_id", "q.*")
    blocks = asked.repartitionByRange("dim", "vec_id").sortWithinPartitions("dim", "vec_id").mapInPandas(_blocks(QUERIES), BLOCK_SCHEMA)
    blocks = written(blocks.select("dim", F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")))

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q_ids, found = np.frombuffer(r.q_ids, "<i8"), {}
                for query, _, score in search_bucket(q_ids, matrix(r.q_data, r.q_n, r.dim), np.full(r.q_n, -np.inf), np.frombuffer(r.ids, "<i8"), matrix(r.data, r.n, r.dim), k):
                    found.setdefault(query, []).append(score)
                low = np.array([min(found[i]) if len(found.get(i, ())) == k else -np.inf for i in q_ids.tolist()])
                norm = np.linalg.norm(matrix(r.q_data, r.q_n, r.dim).astype(float), axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(norm > 0, low / norm, np.where(low > 0, np.inf, -np.inf)).min()
                yield pd.DataFrame({"dim": [r.dim], "q_block": [r.q_block], "q_n": [r.q_n], "q_ids": [r.q_ids], "q_data": [r.q_data], "floors": [low.tobytes()], "least": [float(least)]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rows = search_bucket(np.frombuffer(r.q_ids, "<i8"), matrix(r.q_data, r.q_n, r.dim), np.frombuffer(r.floors), np.frombuffer(r.ids, "<i8"), matrix(r.data, r.n, r.dim), k)
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    longest = buckets.groupBy("dim").agg(F.max_by(F.struct("n", "ids", "data"), F.struct("longest", -F.col("block"))).alias("b")).select("dim", "b.*")
    first = blocks.join(longest, "dim")
    asked_of = "q_n", "q_ids", "q_data"
    ready = written(first.mapInPandas(floors, "dim int, q_block long, q_n int, q_ids binary, q_data binary, floors binary, least double"))
    # a bucket whose longest vector is shorter than what every query of a block needs does not meet that block
    worth = F.col("longest") >= F.col("least") - F.abs("least") * 1e-9
    if blocks.count() <= sent:
        todo = buckets.join(F.broadcast(ready), "dim").where(worth)
    else:
        # blocks meet by their numbers first; then the vectors of either side follow, those of a query block in shares
        share = F.pmod(F.xxhash64("block"), F.lit(SHARES))
        pairs = buckets.select("dim", "block", "longest").join(ready.select("dim", "q_block", "least"), "dim").where(worth).select("block", "q_block", share.alias("share"))
        shared = ready.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        todo = pairs.join(buckets.select("block", "n", "ids", "data"), "block").join(shared, ["q_block", "share"])
    found = todo.select("dim", *asked_of, "floors", "n", "ids", "data").mapInPandas(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id)::INT AS rank, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q) QUALIFY rank <= 5
"""
