"""Operator 13 against plain loops over whole sequences of turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallybook.llm import trie


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        found = [node]
        for x in found:
            found += children[x]
        return found

    out = []
    for node, all_of in members.items():
        inside = below(node)
        ends = ",".join(str(c) for c in sorted(all_of) if paths[c] == node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in inside if x)
        out.append((min(all_of), len(node), min(members[node[:-1]]) if node else None, len(all_of), len(children[node]), sum(not children[x] for x in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, d1 int")


def got(spark, rows):
    return sorted(repr(tuple(r)) for r in trie.prefix_trie(table(spark, rows).repartition(3)).collect())


def random_rows(seed, convs, longest, words):
    pick = random.Random(seed)
    return [(c, t, pick.choice(["user", "bot", None]), pick.choice([*words, "é" * 3, "", None])) for c in pick.sample(range(-10, 60), convs) for t in pick.sample([None, *range(longest)], pick.randint(1, longest))]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("most", [200_000, 1])
def test_rows(spark, seed, most, monkeypatch):
    monkeypatch.setattr("tallybook.llm.common.BROADCAST_ROWS", most)
    rows = random_rows(seed, 30, (4, 11, 18)[seed - 1], "ab"[: seed % 2 + 1])
    assert got(spark, rows) == expected(rows)


def test_nulls_ties_copies_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    monkeypatch.setattr(trie, "ROWS", 3)
    copies = [(c, t, "user", "same") for c in range(100, 400) for t in range(3)]
    long_one = [(5, t, "user", f"turn {t % 7}") for t in range(150)]
    ties = [(3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "bot", "z"), (3, None, None, None), (3, 0, "user", "a"), (None, 1, "user", "no id"), (7, 0, "user", "only taken")]
    rows = copies + long_one + ties
    assert got(spark, rows) == expected(rows)


def test_turnless_root_and_nothing(spark):
    short = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(short, 0, "user", "skipped, and no first conversation to take it from")]
    assert got(spark, rows) == expected(rows) == [repr((short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest()))]
    assert trie.prefix_trie(table(spark, rows).limit(0)).collect() == []
    assert trie.prefix_trie(table(spark, [(None, 0, "user", "x")])).collect() == []
