import hashlib
import math
import random
import re

import pytest

from tallybook.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    tests = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (r, ok) in tests.items() for m in r.finditer(text or "") if ok(m)]


def texts():
    rng = random.Random(8)
    parts = ["a@b.c", "x.y_z@mail-1.example.com", "@", "a@b", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "001.02.3.255.9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (988) 555-2485", "+1", "+49.30.123456", "ÉÀ", "😀", " ", "  ", "\n", ".", "word", "12", "5", "-", "_", "x"]
    out = [None, "", "@", "1.2.3.4", "+1 (988) 555-2485", "😀 a@b.c 😀 1.1.1.1", "x" * 60_000 + "@", "9" * 20_000 + ".1 @", "1.2.3.4." * 3_000, "a@b" + ".c" * 9_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(300)]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, base int").repartition(4)
    got = {r.doc_id: r for r in pii.personal_data(docs).select("doc_id", pii._listed(pii.F.col("base")).alias("base"), pii._listed(pii.F.col("spans")).alias("spans")).collect()}
    for i, t in rows:
        assert got[i].base == ",".join(brute(t)), t
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))


def test_a_trusted_context_finds_what_the_base_patterns_miss(spark):
    seeds = [f"please ring me on +1 (988) 555-{1000 + i} today" for i in range(20)]
    unseen = "so please ring me on 988 555 2485 today"
    other = [f"the code {i} of 77{i} items" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate([*seeds, unseen, *other])), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs).collect()}
    begin = unseen.index("988")
    assert got[20] == [(3, begin, begin + 12)]
    assert all(got[21 + i] == [] for i in range(20)) and all(len(got[i]) == 1 for i in range(20))


def test_secrets_of_a_trusted_context(spark):
    rng = random.Random(5)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows = [f'{word()} {word()}\n token = "{key()}" {word()}' for _ in range(20)]
    rows += [f'{word()} TOKEN = "{key().upper()}"### {word()}', f"{word()} token =  'pass-4711'. {word()}", 'token = "zz9"']
    alone = [f"{word()} {key()} {word()}" for _ in range(8)] + [f"{word()} {rng.randrange(10**6)} {word()}" for _ in range(20)]
    far = [f"secretkey={key(32)} {'x' * 30_000}" for _ in range(12)] + [f"secretkey=abc-1 {'x' * 30_000}"]
    texts = [*rows, *alone, *far]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    named = {i: [texts[i][a:b] for k, a, b in got[i].spans if k == 4] for i in got}
    assert [named[i] for i in range(len(rows))] == [[re.search(r"= +[\"']([\w-]+)", t)[1]] for t in rows]
    assert all(named[i] == [] for i in range(len(rows), len(rows) + len(alone)))
    assert [named[len(texts) - len(far) + i] for i in range(len(far))] == [[t.split()[0].split("=")[1]] for t in far]
    assert all(got[i].base == [] for i in range(len(rows)))


def graph_by_hand(occurrences, trusted, support, added):
    """Spans that bootstrapping adds, from (rid, start, end, instance, base, kind, patterns)."""
    edges, seeds = {}, {}
    for _, _, _, instance, _, kind, patterns in occurrences:
        for p in patterns:
            edges.setdefault(p, set()).add(instance)
        if kind is not None and patterns:
            seeds[instance] = min(kind, seeds.get(instance, 99))
    known = {i: (k, 1.0) for i, k in seeds.items()}
    while True:
        scored = {}
        for p, instances in edges.items():
            for kind in {known[i][0] for i in instances if i in known}:
                own = [known[i][1] for i in instances if i in known and known[i][0] == kind]
                if len(own) >= support and sum(own) / len(instances) >= trusted:
                    for i in instances:
                        scored.setdefault(i, []).append((sum(own) / len(instances), -kind))
        scored = {i: (-max(f)[1], 1 - math.prod(max(1e-12, 1 - c) for c, _ in f)) for i, f in scored.items()}
        more = {i: x for i, x in scored.items() if i not in known and x[1] >= added}
        if not more:
            break
        known |= more
    return {(rid, known[i][0], a, b) for rid, a, b, i, base, _, _ in occurrences if not base and i in scored and scored[i][1] >= added}


def test_bootstrap_as_by_hand(spark):
    rng = random.Random(9)
    sizes = set()
    for case in range(3):
        kind_of = {f"i{n}": rng.choice([0, 0, 1, 4, None, None]) for n in range(60)}
        rows = []
        for rid in range(400):
            i = f"i{rng.randrange(60)}"
            kind = kind_of[i] if rng.random() < 0.8 else None
            own = {f"p{rng.randrange(30)}"} | ({f"k{kind_of[i]}"} if rng.random() < 0.5 else set())
            rows.append((rid, 0, 3, i, kind is not None and kind < 4, kind, sorted(own)))
        docs = spark.createDataFrame(rows, "rid long, start int, end int, instance string, base boolean, kind int, patterns array<string>")
        got = {(r.rid, r.kind, r.start, r.end) for r in pii.bootstrap(docs, 0.6, 2, 0.7).collect()}
        assert got == graph_by_hand(rows, 0.6, 2, 0.7)
        sizes.add(len(got))
    assert max(sizes) > 10


def test_unseen_shapes_from_context_to_context(spark):
    """Telephone numbers that no pattern describes, each context learned from the one before; decoys share words and shapes."""
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    cues = ["ring me on", "our hotline is", "fax it to", "mobile number is", "call back at", "reach us via"]
    shapes = [lambda: f"+44 20 {digits(4)} {digits(4)}", lambda: f"0{digits(2)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}-{digits(4)}x{digits(2)}", lambda: f"(0{digits(3)}) {digits(5)}", lambda: f"{digits(3)}/{digits(6)}", lambda: f"t{digits(3)}.{digits(4)}"]
    rows, right, pool = [], [], [(shapes[0](), False) for _ in range(60)]
    for k, cue in enumerate(cues):  # what the contexts before have taught, and a few numbers of the next shape
        new = [(shapes[(k + 1) % 5 + 1](), True) for _ in range(6)]
        rows += [(f"{word()} {word()} {cue} ", value, unseen) for value, unseen in [*pool[-60:], *new]]
        pool += new
    rows += [(f"{word()} {rng.choice(['order', 'page', 'is', 'to', 'at'])} {word()} ", rng.choice(shapes[1:])(), None) for _ in range(200)]
    texts = [f"{before}{value} {word()}" for before, value, _ in rows]
    for i, (before, value, unseen) in enumerate(rows):
        if unseen:
            right.append((i, len(before), len(before) + len(value)))
    found = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    added = {(r.doc_id, a, b) for r in found for k, a, b in set(map(tuple, r.spans)) - set(map(tuple, r.base))}
    hit = {(i, a) for i, a, _ in added} & {(i, a) for i, a, _ in right}
    precision, recall = len({x for x in added if x[0] in {i for i, _, _ in right}}) / max(1, len(added)), len(hit) / len(right)
    assert precision > 0.95 and recall > 0.8


def test_many_matches_in_a_text(spark):
    text = "é 1.2.3.4 a@b.c, " * 3000
    docs = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    got = pii.personal_data(docs).select("doc_id", pii._listed(pii.F.col("base")).alias("base")).collect()
    assert sorted(r.base for r in got) == sorted(["", *[",".join(brute(text))] * 2])


def test_empty_table_and_digest(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(none).collect() == []
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(pii.F.sha2(pii.F.lit(""), 256)).first()[0]
