import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import similar


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similar_documents(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(3000)]
    docs, near, apart = [], [], []
    for k in range(40):
        words = [rng.choice(base) for _ in range(rng.randrange(60, 300))]
        copy = list(words)
        for _ in range(max(1, len(words) // 75)):
            copy[rng.randrange(len(words))] = "changed"
        half = words[: len(words) // 2] + [rng.choice(base) for _ in range(len(words) // 2)]
        for t, kind in ((words, None), (copy, near), (half, apart)):
            docs.append((len(docs), " ".join(t)))
            if kind is not None:
                kind.append((3 * k, docs[-1][0]))
    docs += [(500, docs[0][1]), (501, None), (502, " ")]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame([*docs, (None, "x")], "doc_id long, text string")).collect()}
    text = dict(docs)
    assert all(jaccard(text[a], text[b]) > 0.8 for a, b in near) and all(jaccard(text[a], text[b]) < 0.6 for a, b in apart)
    assert sum(got[b] == got[a] for a, b in near) >= 0.9 * len(near)
    assert all(got[a] != got[b] for a, b in apart)
    assert got[500] == got[0] == 0 and got[501] == got[502] == 501 and len(got) == len(docs)
    assert similar.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_large_group_stays_together(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 5)
    rng = random.Random(12)
    words = [f"w{rng.randrange(2000)}" for _ in range(300)]
    docs = [(i, " ".join([*words[: i % 290], "new", *words[i % 290 + 1 :]])) for i in range(200)]
    got = {r.component_id for r in similar.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0}


def brute_groups(texts):
    """The smallest number reachable by pairs of a shingle similarity of 0.8 or more, compared one with one."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def groups_found(spark, texts):
    rows = list(enumerate(texts))
    random.Random(14).shuffle(rows)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("paired, hot", [(64, 256), (3, 256), (3, 5)])
def test_interleaved_families_around_one_passage(spark, monkeypatch, paired, hot):
    monkeypatch.setattr(similar, "TILE", paired)
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "HUBS", 2)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(4000)]
    words = lambda n: [rng.choice(base) for _ in range(n)]
    shared, texts = words(90), []
    ends = [words(rng.randrange(18, 40)) for _ in range(12)]
    for k in range(120):
        end = list(ends[k % 12]) if k % 3 else words(30)
        end[rng.randrange(len(end))] = rng.choice(base)
        texts.append(" ".join(shared + end))
    assert groups_found(spark, texts) == brute_groups(texts)


def test_similarity_at_the_threshold(spark):
    rng = random.Random(15)
    base, texts = [f"w{i}" for i in range(4000)], []
    words = lambda n: [rng.choice(base) for _ in range(n)]
    for own in (96, 99, 100, 101, 104):  # 800 shared shingles and so many of each text's own
        both = words(804)
        texts += [" ".join(both + words(own)), " ".join(both + words(own))]
    for n in (8, 7):  # four shingles against five, which is 0.8, and three against four, which is less
        for _ in range(20):
            short = words(n)
            texts += [" ".join(short), " ".join([*short, "more"])]
    assert groups_found(spark, texts) == brute_groups(texts)


def test_families_whose_hubs_differ(spark, monkeypatch):
    """Two families of three around a shared part, so that a key's texts stay in several groups after both hubs."""
    monkeypatch.setattr(similar, "TILE", 2)
    rng = random.Random(16)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared, texts = words(100), []
    for k in range(24):
        own = words(40)
        texts += [" ".join(shared + own[:26]), " ".join(shared + own[:24] + words(4)), " ".join(shared[8:] + own[:26])]
    want = brute_groups(texts)
    assert len(set(want)) > 3 and groups_found(spark, texts) == want


def test_names_and_kinds_of_docs(spark):
    rows = [(None, None, 1), (None, "", 2), (3, "one two", 3), (3, "one two", 4), (4, "a " * 30_000, 5), (5, "a " * 29_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumn("key", F.col("node"))
    rows, groups = similar.near_groups(docs)
    found = {r["__whole"].node: r.root for r in rows.join(groups, ["__file", "__row"]).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6} and len(set(found.values())) == 3
    assert found[1] == found[2] and found[3] == found[4] and found[5] == found[6]
    assert similar.near_groups(docs.limit(0))[1].collect() == []


def test_sketches_never_say_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (1, 5, 900, 1100, 3000, 70_000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        for share in (0.0, 0.02, 0.3, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= share], rng.integers(0, 1 << 64, int(share * n) + 1, np.uint64)]))
            differ = len(np.setxor1d(a, b))
            assert similar.bits_apart(similar.wide_sketch(a), similar.wide_sketch(b)) <= differ
            assert sum(int(x).bit_count() for x in np.asarray(similar.sketch(a) ^ similar.sketch(b)).view("<u8")) <= differ


def test_shared_keys_are_counted_without_a_sort(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(similar, "written", lambda df, narrow=False, put=similar.written: plans.setdefault(tuple(df.columns), df._jdf.queryExecution().executedPlan().toString()) and put(df, narrow))
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    met = next(plan for columns, plan in plans.items() if columns[0] == "key" and "hub" in columns)
    assert got == {1: 1, 2: 1, 3: 3} and "HashAggregate" in met and "SortAggregate" not in met


def test_sets_are_made_once_by_one_python_worker(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(similar, "written", lambda df, narrow=False, put=similar.written: plans.setdefault(tuple(df.columns), df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]) and put(df, narrow))
    # two texts of one id, both asked for, and repeated rows of one of them
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (1, "k l m n o p q r s t"), (2, "a b c d e f g h i j k"), (3, "k l m n o p q r s t u"), (4, "x")]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = plans["node", "hashes"]
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert sum("Python" in x or "InPandas" in x for x in held.split("\n")) == 1
    for columns, plan in plans.items():
        assert sum("ArrowEvalPython" in x for x in plan.split("\n")) <= 1, columns
