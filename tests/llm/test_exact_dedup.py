import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallybook.llm import exact_dedup

TEXTS = [None, "", " ", "\t\n", "a b", "a  b", "a\x0bb", " a b", "a b ", "A b", "x" * 50_000, "é b", "é b", "a b", "x" * 50_000]


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = groups[norm(t)]
        first = min((x for x in ids if x is not None), default=None)
        keep = i == first and norm(t) not in seen
        if keep:
            seen.add(norm(t))
        out.append((i, first, len(ids), keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(map(str, out))


def rows():
    return [*enumerate(TEXTS, 10), (3, "a b"), (10, None), (None, "null id"), (None, "a b"), *((100 + i, "very common") for i in range(400))]


def weak(text):
    return F.substring(F.md5(text), 1, 1)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_as_brute_force(spark, tmp_path, digest):
    spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, digest string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = exact_dedup.exact_dedup(docs, digest=digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows())
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == ["doc_id", "text", "digest"]
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t in rows()})


def test_rows_from_no_file_and_empty_table(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows())
    assert exact_dedup.exact_dedup(docs.limit(0)).collect() == []


def told(got):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got)


def expected(seen, last):
    """What the last rows of all seen get."""
    groups, out = {}, []
    for i, t in seen:
        groups.setdefault(norm(t), []).append(i)
    for i, t in last:
        own = groups[norm(t)]
        least = min((x for x in own if x is not None), default=None)
        out.append((str(i), str(least), len(own), i == least, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


PARTS = [
    [(i, f"t{i % 30}") for i in range(10, 60)],
    [(i, f"t {i % 40}".replace(" ", "")) for i in range(100, 140)] + [(3, "t5"), (None, "t1"), (200, None)],
    [(i, f"u{i}") for i in range(300, 340)] + [(1, "t5"), (2, "u2"), (400, "t39"), (401, "")],
]


def frames(spark, folder):
    for n, rows in enumerate(PARTS):
        path = f"{folder}/docs{n}"
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
        yield spark.read.parquet(path)


@pytest.mark.parametrize("weak", [False, True])
def test_later_calls_go_on_with_the_state(spark, tmp_path, weak):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    state, seen, got = f"file://{tmp_path}/state", [], []
    for n, (docs, rows) in enumerate(zip(frames(spark, tmp_path), PARTS)):
        seen += rows
        got.append(told(exact_dedup.exact_dedup(docs, digest=digest, state=state, call=f"c{n}").collect()))
        assert got[-1] == expected(seen, rows)
    for n in (1, 2):  # a call that ended gives the same again
        docs = spark.read.parquet(f"{tmp_path}/docs{n}")
        assert told(exact_dedup.exact_dedup(docs, digest=digest, state=state, call=f"c{n}").collect()) == got[n]
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs, state=state)


def test_a_failed_call_is_repeated(spark, tmp_path, monkeypatch):
    state, seen = f"file://{tmp_path}/state", []
    for n, (docs, rows) in enumerate(zip(frames(spark, tmp_path), PARTS)):
        seen += rows
        run = lambda name: exact_dedup.exact_dedup(docs, state=state, call=name)  # noqa: B023, E731
        with monkeypatch.context() as broken:  # once before the stream runs, once after it
            broken.setattr(exact_dedup, "_streamed", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                run(f"c{n}")
            with pytest.raises(ValueError, match="has not ended"):
                run("another")
        with monkeypatch.context() as broken:
            broken.setattr(exact_dedup, "small", lambda df: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                run(f"c{n}")
        assert told(run(f"c{n}").collect()) == expected(seen, rows)
