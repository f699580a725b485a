"""Components, recent words and files, on their own."""

import random

import numpy as np
import public_tokenizers
import pytest

from tallybook.llm import bpe, common, graph, words


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components_as_union_find(spark, kind):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(110)], "chain": [(i + 1, i) for i in range(200)], "star": [(7, i) for i in range(300)], "none": [(4, 4)]}[kind]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges * 2, "u long, v long").repartition(3)).collect()}
    assert got == {x: find(x) for x in linked}


def test_recent_words_over_generations():
    asked = []

    def make(new):
        asked.extend(new)
        return [np.array([len(w), sum(w)], "<i4").tobytes() for w in new]

    recent = words.RecentWords(make, generation=3)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bb", "c,", "D.", "e<|f", "́x", ""]) for _ in range(rng.randrange(6))) for _ in range(60)]
    for i in range(0, 60, 4):
        got = recent.encode(texts[i : i + 4])
        for ids, text in zip(got, texts[i : i + 4]):
            keys = words.word_keys(text)
            assert ids.tolist() == [x for w in keys for x in (len(w), sum(w))]
        assert len(recent.young) <= 12 and len(recent.old) <= 12
    assert words.word_keys("Ab, c.\nD! 1, E,f") == [b"ab", b",", b"c", b".", b"d!", b"1,", b"e,f"]
    assert words.word_keys("A, <|x|>") == [b"A,", b"<|x|>"]


def test_files(tmp_path):
    path = common.uri(f"{tmp_path}/a/b")
    assert common.mapped(path) is None
    common.put(path, b"one")
    common.put(path, b"two")
    assert common.mapped(path).tobytes() == b"two" and [p.name for p in (tmp_path / "a").iterdir()] == ["b"]


def test_a_shared_folder_is_asked_for(spark):
    assert common.shared_dir(spark) != common.shared_dir(spark)


def test_what_another_operator_left_in_a_worker_goes():
    """Workers are handed on with their caches: the tokens of one stage are not held through the next one's tasks."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    bpe.vocabulary(path).encode(["some words"])
    assert bpe.vocabulary.cache_info().currsize
    common.let_go()
    assert not bpe.vocabulary.cache_info().currsize
    assert bpe.vocabulary(path).decode(bpe.vocabulary(path).encode(["some words"])[0])
