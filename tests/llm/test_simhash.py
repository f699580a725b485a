import random

import pytest
import xxhash

from tallybook.llm import simhash


def brute_fp(text, n=3):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fp(t or "") for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {(doc_id, fps[i], least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


def texts():
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    out = [None, "", " \t", "A", "a", "One Two", "one two", "É É É", "x " * 30_000]
    for _ in range(6):
        words = [rng.choice(base) for _ in range(400)]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(400)] = rng.choice(base)
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("paired", [256, 1])
def test_as_brute_force(spark, paired):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    got = {(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, paired=paired).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("paired", [256, 1])
def test_links_of_chosen_fingerprints(spark, paired):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) for f in fps] + [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps] + [f ^ (7 << rng.randrange(60)) for f in fps]
    fps = sorted({f - 2**64 if f >> 63 else f for f in fps})
    got = simhash.links(spark.createDataFrame([(f, 0) for f in fps], "fp long, first_id long"), paired)
    from tallybook.llm.graph import components

    roots = {r.node: r.root for r in components(got).collect()}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                assert roots[a] == roots[b]
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 2 for r in got.collect()) and got.count()


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
