"""Reversals in large groups, several grains at once, the dictionary and the literals of patterns."""

import random
import re
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.functions.literals import required
from tallybook.functions.scalars import merchant
from tallybook.operators import classify, pnl
from tallybook.plans import queries
from tallybook.plans.book import Book
from tallybook.sources import adapters

SCHEMA = "account_id int, statement_id string, statement_dt date, post_dt date, sequence int, description string, amount decimal(18,2), is_credit boolean, business_category string, is_transfer boolean, is_owner_related boolean, is_loan boolean, is_fixed_asset boolean, include_in_pnl boolean"
BASE = date(2010, 1, 1)


def ledger(spark, rows):
    """rows: (day, cents, is reversal), of one merchant of one account, in list order."""
    data = [(1, f"s{d // 30:03d}", BASE + timedelta(d // 30 * 30), BASE + timedelta(d), n, "SHOP", Decimal(c) / 100, back, "Payment Reversal" if back else "Fuel", False, False, False, False, True) for n, (d, c, back) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def by_hand(rows, once):
    """(reversal, debit, cents) as one walk over the whole list gives them."""
    used, out = set(), set()
    for n, (day, c, back) in enumerate(rows):
        if back:
            scored = [(-(min(c, x) / max(c, x) - (day - d) / 36500 if c and x else -(day - d) / 36500), k, min(c, x)) for k, (d, x, b) in enumerate(rows) if not b and k not in used and 0 <= day - d <= 90 and not (c < x and c / x < 0.8)]
            if scored:
                _, k, cents = min(scored)
                out.add((n, k, cents))
                if once:
                    used.add(k)
    return out


@pytest.fixture(scope="module")
def ten_years():
    """A row every day for ten years, and a reversal now and then."""
    rng = random.Random(4)
    rows = [(d, rng.choice([0, 999, 1000, 1250, 5000, 90_000]) + rng.randrange(3), False) for d in range(3650) for _ in range(2)]
    rows += [(d, rng.choice([999, 1000, 5000]), True) for at in range(60, 3650, 210) for d in [at + i for i in range(0, 30, 7)] if d < 3650]
    return sorted(rows, key=lambda r: (r[0] // 30, r[0], r[2]))


def test_a_busy_merchant_is_cut_by_reach(spark, ten_years):
    tx = ledger(spark, ten_years)
    parts = pnl.in_reach(tx, pnl.total_period()).groupBy("part").agg(F.count("*").alias("n"), F.count_if("is_reversal").alias("back")).collect()
    with_both = [r for r in parts if r.back and r.back < r.n]
    assert len(with_both) == 18 and max(r.n for r in parts) < 300
    got = {(r.reversal_sequence, r.debit_sequence, r.cents) for r in pnl.match_reversals(tx, pnl.total_period()).collect()}
    assert got == by_hand(ten_years, True) and len(got) > 60


def test_debits_far_above_every_reversal_cut_as_well(spark):
    rows = [(d, 100_000, False) for d in range(0, 700, 10)] + [(d, 1000, back) for d in range(5, 700, 170) for back in (False, True)]
    rows = sorted(rows)
    found = pnl.in_reach(ledger(spark, rows), pnl.total_period()).collect()
    assert len(found) == 10 and len({r.part for r in found}) == 5


def test_best_candidates_look_at_few_debits(spark):
    rng = random.Random(5)
    rows = sorted((rng.randrange(180), rng.randrange(100, 100_000_00), rng.random() < 0.02) for _ in range(3000))
    got = {(r.r_sequence, r.d_sequence, r.applied_cents) for r in pnl.best_candidates(ledger(spark, rows), pnl.total_period()).collect()}
    assert got == by_hand(rows, False)
    cents, day = np.array([r[1] for r in rows if not r[2]]), np.array([r[0] for r in rows if not r[2]])
    debits = pnl.Debits(np.arange(len(cents)), cents, day)
    back = [r for r in rows if r[2]]
    for d, c, _ in back:
        debits.best(float(c), d)
    assert debits.looked_at < 0.1 * len(back) * len(cents)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.sampled_from([-300, 0, 1, 79, 80, 100, 101, 125, 126, 1000]) | st.integers(1, 2000)), max_size=90), st.integers(0, 250), st.integers(-5, 2500), st.integers(1, 4))
def test_the_search_as_over_all(debits, day, cents, step):
    found = pnl.Debits(np.arange(len(debits)), np.array([c for _, c in debits], int), np.array([d for d, _ in debits], int))
    found.STEP = step
    scores = found.scores(np.arange(len(debits)), float(cents), day)
    want = min(((-s, found.place[i]) for i, s in enumerate(scores) if s > -np.inf), default=None)
    got = found.best(float(cents), day)
    assert (None if got is None else found.place[got]) == (want and want[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.sampled_from([1, 79, 80, 100, 101, 125, 126, 1000]) | st.integers(1, 2000), st.booleans()), max_size=90), st.booleans())
def test_in_turn_as_by_the_search(rows, once):
    """Reversals in the order of days find what a search over all debits of the group finds for each."""
    rows = sorted(rows, key=lambda r: r[0])
    day, cents, back = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((int, int, bool)))
    place = np.arange(len(rows))
    debits, want = pnl.Debits(place[~back], cents[~back], day[~back]), []
    for r in place[back]:
        if (i := debits.best(float(cents[r]), int(day[r]))) is not None:
            want.append((r, debits.place[i], debits.scores(np.array([i]), float(cents[r]), int(day[r]))[0]))
            debits.used[i] = once
    got = pnl.in_turn(list(zip(day[~back].tolist(), (-place[~back]).tolist(), cents[~back].astype(float).tolist())), list(zip(place[back].tolist(), cents[back].astype(float).tolist(), day[back].tolist())), once)
    assert got == want


def test_profit_and_loss_without_numbers(spark):
    """Lines of the ledger before its rows are numbered are those of the numbered one; numbering, and its shuffle, is left out."""
    b = Book(spark, "/root/testdata/sf0.001")
    numbered = sorted(map(tuple, pnl.lines(b.dated, F.array(pnl.total_period(), pnl.month_period())).collect()))
    plain = Book(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, plain.pl(F.array(pnl.total_period(), pnl.month_period())).collect())) == numbered and "dated" not in plain.__dict__
    plan = adapters.unnumbered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and len(numbered) > 100


def test_only_merchants_with_reversals_are_matched(spark, ten_years):
    """Debits of other merchants are left out before periods and days are worked out for them."""
    tx = ledger(spark, ten_years[:300]).withColumn("merchant", F.when(F.col("sequence") % 2 == 0, F.lit("A")).otherwise(F.lit("B")))
    tx = tx.where((F.col("merchant") == "A") | ~F.col("is_credit"))
    found = pnl.in_reach(tx, F.array(pnl.total_period(), pnl.month_period()))
    assert {r.merchant for r in found.select("merchant").distinct().collect()} == {"A"}
    scans = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in scans and scans.index("LeftSemi") > scans.index("Generate")


def test_aliases_read_the_ledger_once(spark):
    """The rules are tried on the texts of the parts, so that the lines are not read and joined a second time for theirs."""
    plan = queries.QUERIES["c04_aliases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and len(re.findall(r"Relation \[[^\]]*l_linenumber", plan)) == 1


def test_numbering_shuffles_no_texts(spark):
    """Rows are numbered by what their order needs; statement ids and descriptions are made afterwards."""
    plan = adapters.raw_ledger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("statement_id") < plan.index("Window [") and "concat" not in plan[plan.index("Window [") :]


def test_grains_in_one_run_as_alone(spark, ten_years):
    tx = ledger(spark, ten_years[:900])
    grains = [pnl.total_period(), pnl.month_period(), pnl.quarter_period(10)]
    alone = [r for g in grains for r in map(tuple, pnl.lines(tx, g).collect())]
    assert sorted(map(tuple, pnl.lines(tx, F.array(*grains)).collect())) == sorted(alone) and len(alone) > 20


@pytest.mark.parametrize("rules", [classify.default_rules(), [classify.Rule(p, c) for p, c in classify.personal_patterns()]], ids=["business", "personal"])
def test_what_a_pattern_matches_holds_its_literals(rules):
    """Texts made from the patterns' own words, joined in many ways."""
    rng = random.Random(6)
    words = sorted({w for r in rules for w in re.findall(r"[A-Za-z']+", re.sub(r"\\.|\(\?[:!=<]*", " ", r.pattern))})
    texts = [rng.choice(["", "#1 "]) + rng.choice([" ", "", " 12 "]).join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(4000)]
    texts += [" ".join(re.findall(r"[A-Za-z']+", re.sub(r"\\.|\(\?[:!=<]*", " ", r.pattern))) for r in rules]
    found = 0
    for r in rules:
        held = required(r.pattern)
        assert held == [x.upper() for x in held]
        for t in texts:
            if re.search(r.pattern, t, re.I):
                found += 1
                assert not held or any(x in t.upper() for x in held), (r.pattern, t)
    assert found > 1000


@pytest.mark.parametrize("pattern, held", [("ab(?:cd|efg)h?", ["AB", ]), ("x*yz+", ["Y"]), ("[ab]|c", []), ("(?:one|two)+ three", [" THREE"]), ("(?=look)a.b", ["A"]), (r"\bA\s+LONG\b", ["LONG"]), ("", [])])
def test_literals(pattern, held):
    found = required(pattern)
    assert found == held or (found and held and min(map(len, found)) >= min(map(len, held)))


def test_dictionary(spark):
    texts = ["WEB XFER 1", "XX1234 DEBIT CARD 01/05 13:02 PILOT 12", "APEX CAPITAL FUNDING", "WEB XFER 1", "", None, "NETFLIX", "été PILOT"]
    rows = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "n int, description string, is_credit boolean")
    rules = classify.ordered()
    words = classify.dictionary(rows, rules)
    assert words.count() == len(set(texts)) and words.select("text_id").distinct().count() == len(set(texts))
    got = {r.n: r for r in classify.ruled(classify.with_dictionary(rows, words), rules).select("*", merchant(F.col("description")).alias("own")).collect()}
    assert len(got) == len(texts) and all(r.merchant == r.own for r in got.values() if r.description)
    assert got[0].text_id == got[3].text_id and got[5].rule_id == 0 and got[5].business_category == "Uncategorized"
    plain = {r.n: r.business_category for r in classify.categorise(rows.where("description is not null"), rules).collect()}
    assert all(got[n].business_category == c for n, c in plain.items())
    assert got[6].category == "Subscriptions" and got[1].category == "Fuel & Gas" or got[1].category != "Other"
