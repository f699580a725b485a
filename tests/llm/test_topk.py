import math
import random

import numpy as np
import pytest

from tallybook.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, u in {i: v for i, v in reversed(good) if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in good if i != q and len(v) == len(u))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def rows(n, dim=8, spread=1.0, seed=1):
    rng = np.random.default_rng(seed)
    out = [(i, (rng.normal(size=dim) * math.exp(spread * rng.normal())).astype("f4").tolist(), "x") for i in range(n)]
    return out


@pytest.mark.parametrize("spread,bucket,sent", [(0.0, 64, 16), (2.0, 16, 16), (1.0, 32, 0)])
def test_as_brute_force(spark, spread, bucket, sent):
    data = rows(600, spread=spread)
    data += [(1000 + i, data[3][1], "copy") for i in range(120)]  # a very common vector, ties
    data += [(2000, None, ""), (2050, [1.0, None] * 4, ""), (2100, [float("nan")] * 8, ""), (2150, [float("inf")] * 8, ""), (2200, [0.0] * 8, ""), (2250, [1.0, 2.0], ""), (2251, [3.0, 1.0], ""), (None, [1.0] * 8, ""), (2300, [-1e-9] * 8, ""), (2350, [], ""), (2351, [], "")]
    random.Random(5).shuffle(data)
    vectors = topk.quantised(spark.createDataFrame(data, SCHEMA).repartition(3))
    got = {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), bucket=bucket, sent=sent).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(data)


def test_pruning_keeps_all_that_reach_the_floor():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.integers(-50, 50, size=(200, 4)).astype(float)
        x = x[np.argsort(-np.linalg.norm(x, axis=1), kind="stable")]
        q, ids = rng.integers(-50, 50, size=(5, 4)).astype(float), np.arange(200)
        full = q @ x.T
        floors = np.sort(full, axis=1)[:, -3]
        got = topk.search_bucket(np.arange(900, 905), q, floors, ids, x, 3)
        want = {(900 + i, int(j), int(full[i, j])) for i in range(5) for j in np.lexsort((ids, -full[i]))[:3]}
        assert set(got) == want


def test_large_components_and_empty(spark):
    data = [(0, [1e6, -1e6], ""), (1, [1e6, 3.0], ""), (2, [-1e6, 1.0], "")]
    vectors = topk.quantised(spark.createDataFrame(data, SCHEMA))
    assert {tuple(r) for r in topk.top_k(vectors, vectors).select("query_id", "rank", "vec_id", "score").collect()} == brute(data, every=1)
    none = vectors.limit(0)
    assert topk.top_k(none, none).collect() == []


def test_wide_and_narrow_components_meet_exactly(spark):
    rows = [(1, [2**40 + 1, 3]), (2, [2**15 + 1, 1]), (3, [-(2**20), 2**13]), (4, [7, 2**14 + 1])]
    df = spark.createDataFrame([(i, 2, v, float(sum(x * x for x in v))) for i, v in rows], "vec_id long, dim int, vec array<long>, norm2 double")
    for sent in (16, 0):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id < 1000"), df, 3, bucket=1, sent=sent).collect()}
        for i, q in rows:
            want = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i))
            assert [got[i, n] for n in (1, 2, 3)] == [(j, -s) for s, j in want]
