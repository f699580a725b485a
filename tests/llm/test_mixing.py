import hashlib
import random
from collections import Counter

import duckdb
import pytest

from tallybook.llm import mixing


def slot_by_slot(a, blocks):
    """The schedule run one slot after the other: (source, block) of each slot, None where the slot stays empty."""
    ran, out = [0] * len(a), []
    while any(b > r for b, r in zip(blocks, ran)):
        now = [x if b > r else 0 for x, b, r in zip(a, blocks, ran)]
        total, k, left = sum(now), [0] * len(a), [b - r for b, r in zip(blocks, ran)]
        due = lambda s, j: -((j + 1) * total // -now[s])
        ends = [due(s, left[s] - 1) if x else None for s, x in enumerate(now)]
        end = min(e for e in ends if e and 2 * sum(x for x, y in zip(now, ends) if y and y <= e) >= total)
        for t in range(end):
            s = min((s for s, x in enumerate(now) if x and k[s] * total // x <= t), key=lambda s: (due(s, k[s]), s))
            assert due(s, k[s]) > t
            out.append((s, ran[s] + k[s]) if k[s] < left[s] else None)
            k[s] += 1
            assert all(abs(k[i] * total - (t + 1) * x) < total for i, x in enumerate(now))
        ran = [r + min(n, j) for r, n, j in zip(ran, left, k)]
    return out


def cases():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 8)
        yield mixing.whole([rng.choice([1, rng.randrange(1, 9), rng.random(), 10.0 ** -rng.randrange(3)]) for _ in range(n)]), [rng.randrange(0, 40) for _ in range(n)]


def test_stretches_are_the_schedule_run_slot_by_slot():
    for a, blocks in cases():
        rows = [max(0, 3 * b - 1) for b in blocks]
        want, got = slot_by_slot(a, blocks), {}
        for phase in mixing.phases(a, blocks):
            for t in range(0, phase.slots, 7):
                got |= {slot: (s, k, first) for s, k, slot, first in mixing.stretch(phase, rows, 3, t, min(phase.slots, t + 7))}
        assert {t: x[:2] for t, x in got.items()} == {t: x for t, x in enumerate(want) if x}
        first = 0
        for t in sorted(got):
            assert got[t][2] == first
            first += min(3, rows[got[t][0]] - 3 * got[t][1])


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 1 - 1e-4, "b": 1e-4}, {str(i): 1 / (i + 1) for i in range(25)}, {"big": 1000, "tiny": 0.001, "other": 1}])
def test_target_weights_hold_however_many_blocks(weights):
    a, total = mixing.whole(list(weights.values())), sum(weights.values())
    for t in [*range(1, 400), 10**5 + 7, 10**9 + 1, 10**11 + 12_345]:
        done = mixing.state(a, t)
        assert sum(done) == t and all(abs(k - t * w / total) < 1 + 1e-12 * t for k, w in zip(done, weights.values()))


def test_a_stretch_far_out_goes_on_from_its_state():
    a = mixing.whole([3, 2.5, 1, 0.01])
    phase = mixing.Phase(0, 1 << 50, a, [0] * 4, [1 << 50] * 4)
    t = 10**9 + 3
    ran = Counter(s for s, *_ in mixing.stretch(phase, [1 << 56] * 4, 1, t, t + 5000))
    assert [x + ran[s] for s, x in enumerate(mixing.state(a, t))] == mixing.state(a, t + 5000)


def test_bad_weights():
    for w in ([0], [-1, 2], [float("nan")]):
        with pytest.raises(ValueError):
            mixing.whole(w)


@pytest.mark.parametrize("weights", [None, {"a": 6, "b": 3, "": 1}])
def test_positions_as_brute_force(spark, weights):
    rows = [(i, "a" if i % 3 else "b", f"t{i}") for i in range(300)] + [(i, None, None) for i in range(300, 320)] + [(None, "a", "x"), (None, "a", None), (7, "a", "t7"), (7, "a", "other")]
    docs = spark.createDataFrame([(*r, 0, "f") for r in rows], "doc_id long, source string, text string, slot int, __hash string").repartition(5)
    got = sorted(mixing.mix(docs, weights, block=4).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    sizes = Counter(s or "" for _, s, _ in rows)
    names = sorted(sizes)
    plan = slot_by_slot(mixing.whole([(weights or {s: n**mixing.FLATTEN for s, n in sizes.items()})[s] for s in names]), [-(-sizes[s] // 4) for s in names])
    order = {names[s] + str(k): t for t, x in enumerate(plan) if x for s, k in [x]}
    assert all(order[(r.source or "") + str(r.block)] == r.slot for r in got)
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    for s in names:  # in the order of the ids' hashes; rows without an id anywhere
        own = [hashlib.md5(str(r.doc_id).encode()).hexdigest() for r in got if (r.source or "") == s and r.doc_id is not None]
        assert own == sorted(own)
    ordered = mixing.mixed(docs.select("doc_id", "source", "text"), weights)
    assert ordered.columns == ["doc_id", "source", "text"] and ordered.count() == len(rows)
    one = docs.where("doc_id is not null and doc_id != 7").select("doc_id", "source", "text")
    assert [r.doc_id for r in mixing.mixed(one, weights).collect()] == [r.doc_id for r in mixing.mix(one, weights).orderBy("position").collect()]


def test_empty_table_and_missing_weight(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"b": 1})


def test_sql_twin_over_phases(spark, tmp_path):
    rows = [(i, f"s{min(i % 7, 3)}" if i < 5000 else None) for i in range(5100)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.sql(mixing.OP7_SQL).fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in mixing.op7_mixing(spark, str(tmp_path)).collect()}
    assert got == want
