"""Operators on small hand-made ledgers."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions import scalars as S
from tallybook.plans.book import Book
from tallybook.operators import classify, export, insights, periods, pnl, project, reconcile, redact

D = Decimal
TX = "account_id int, statement_id string, statement_dt date, month date, sequence int, post_dt date, description string, amount decimal(18,2), is_credit boolean, balance decimal(18,2), business_category string, tax_category string, deductibility string, include_in_pnl boolean, is_transfer boolean, is_owner_related boolean, is_fixed_asset boolean, is_loan boolean, cpa_review boolean, review_reason string"
PLAIN = dict(account_id=1, statement_id="S1", statement_dt=date(2023, 1, 31), month=date(2023, 1, 1), post_dt=date(2023, 1, 15), description="TEST", amount=100, is_credit=True, balance=500, business_category="Uncategorized", tax_category="CPA Review", deductibility="unknown", include_in_pnl=False, is_transfer=False, is_owner_related=False, is_fixed_asset=False, is_loan=False, cpa_review=True, review_reason="")


def ledger(spark, *rows):
    full = [{**PLAIN, "sequence": i, **r} for i, r in enumerate(rows, 1)]
    names = [c.split()[0] for c in TX.replace("decimal(18,2)", "decimal").split(", ")]
    return spark.createDataFrame([tuple(D(r[n]) if n in ("amount", "balance") else r[n] for n in names) for r in full], TX)


def cost(amount, day, category="Fuel", text="VENDOR A", **more):
    return dict(amount=amount, post_dt=day, business_category=category, description=text, is_credit=False, include_in_pnl=True, **more)


def back(amount, day, text="VENDOR A"):
    return dict(amount=amount, post_dt=day, business_category="Payment Reversal", description=text)


def totals(spark, *rows):
    pl = pnl.lines(ledger(spark, *rows), pnl.total_period())
    return {(r.section, r.category): r.amount for r in pl.collect()}


J = lambda d, m=1: date(2023, m, d)
REVERSALS = [
    ("nearest", [cost(900, J(1), "Materials and Supplies"), cost(150, J(2), "Materials and Supplies"), back(150, J(3))], "Materials and Supplies", 900, 0),
    ("no reuse", [cost(150, J(1)), back(150, J(2)), back(150, J(3))], "Fuel", 0, 150),
    ("alone", [back(50, J(3))], "Fuel", None, 50),
    ("future debit", [cost(150, J(20)), back(150, J(3))], "Fuel", 150, 150),
    ("larger reversal", [cost(150, J(1)), back(200, J(2))], "Fuel", 0, 50),
    ("too long ago", [cost(150, J(1)), back(150, J(1, 5))], "Fuel", 150, 150),
    ("too small", [cost(150, J(1)), back(100, J(2))], "Fuel", 150, 100),
    ("other merchant", [cost(150, J(1)), back(150, J(2), "VENDOR B")], "Fuel", 150, 150),
    ("first of equals", [cost(150, J(1), "Fuel"), cost(150, J(1), "Travel"), back(150, J(2))], "Fuel", 0, 0),
    ("no section", [cost(150, J(1), "Refund"), back(150, J(2))], "Refund", 150, 150),
]


@pytest.mark.parametrize("name,rows,category,left,over", REVERSALS, ids=[r[0] for r in REVERSALS])
def test_reversals(spark, name, rows, category, left, over):
    got = totals(spark, *rows)
    assert got.get((f"{pnl_section(category)}", category)) == (None if left is None else D(left))
    assert got.get(("payment_reversal_credits", ""), D(0)) == over


def test_redaction_next_to_other_letters(spark):
    """Ends of words are those of ASCII, a vertical tab is no blank, the long s is an S and a dotted capital I no I, as in the SQL."""
    place = "[ADDRESS REDACTED]"
    cases = {"\u00e912 MAIN ST": "\u00e9" + place, "12 MAIN ST\u00e9": place + "\u00e9", "5\x0bOAK ST": "5\x0bOAK ST", "7 soho \u017ft": place, "6 a \u0130 st": "6 a \u0130 st", "555\x0b123-4567": "555\x0b123-4567"}
    cases |= {"L\u0130CENSED": "L\u0130CENSED", "l\u0131censed": "l\u0131censed", "LICEN\u017fED": "Entity 001"}
    rows = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert [(r.got, r.want) for r in rows.select(redact.redact(F.col("text"), ["licensed"]).alias("got"), "want").collect() if r.got != r.want] == []


def test_statements_from_the_ledger_that_is_written(spark, tmp_path):
    """A query that has written its classified ledger takes statements and daily balances from it; no table is read again."""
    ledger(spark, cost(900, J(1)), back(150, J(3))).withColumn("merchant", F.lit("M")).write.parquet(str(tmp_path / "tx"))
    b = Book(spark, str(tmp_path))
    b.dated = spark.read.parquet(str(tmp_path / "tx"))
    assert (b.st.first().total_debits, b.st.first().ending_balance) == (900, -750)
    assert [r.balance for r in b.db.orderBy("bal_dt").collect()] == [-900, -750]


def test_lines_are_worked_out_once(spark, tmp_path):
    """A report that reads the lines of profit and loss several times reads them as written, not as a plan of its own each time."""
    ledger(spark, cost(900, J(1)), back(150, J(3))).withColumn("merchant", F.lit("M")).write.parquet(str(tmp_path / "tx"))
    b = Book(spark, str(tmp_path))
    b.dated = spark.read.parquet(str(tmp_path / "tx"))
    pl = b.pl()
    plan = export.profit_and_loss(pl, pnl.summary(pl))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "Join" not in plan


def pnl_section(category):
    return "direct_costs" if category in pnl.DIRECT else "operating_expenses"


def test_no_debit_is_used_twice(spark):
    rows = [cost(100 + i % 3, J(1 + i % 20), text=f"V{i % 4}") for i in range(60)] + [back(100 + i % 3, J(2 + i % 25), f"V{i % 4}") for i in range(60)]
    found = pnl.match_reversals(ledger(spark, *rows).repartition(5), pnl.total_period()).collect()
    assert len({r.debit_sequence for r in found}) == len({r.reversal_sequence for r in found}) == len(found) > 20


def test_profit_and_loss(spark):
    sale = dict(business_category="Sales Revenue", include_in_pnl=True, amount=1000)
    got = totals(spark, sale, cost(200, J(2)), cost(150, J(3), "Business Insurance"), dict(amount=50, business_category="Interest Income", include_in_pnl=True), cost(30, J(4), "Loan Interest", is_loan=True))
    assert got == {("revenue", "Sales Revenue"): 1000, ("direct_costs", "Fuel"): 200, ("operating_expenses", "Business Insurance"): 150, ("other_income", "Interest Income"): 50, ("other_expense", "Loan Interest"): 30}
    wide = pnl.summary(pnl.lines(ledger(spark, sale, cost(200, J(2)), cost(150, J(3), "Business Insurance")), pnl.total_period())).first()
    assert (wide.gross_profit, wide.operating_profit, wide.net_profit, wide.gross_margin) == (800, 650, 650, "80.0%")


def test_routing_order(spark):
    got = totals(
        spark,
        dict(is_transfer=True, is_owner_related=True, amount=1),
        dict(is_transfer=True, is_credit=False, business_category="Credit Card Payment", amount=2),
        dict(is_owner_related=True, is_loan=True, is_credit=False, amount=4),
        dict(is_loan=True, amount=8),
        dict(is_fixed_asset=True, is_credit=False, amount=16, include_in_pnl=True),
        dict(amount=32),
        dict(is_credit=False, amount=64, business_category="Refund", include_in_pnl=True),
        dict(is_credit=True, amount=128, business_category="Fuel", include_in_pnl=True),
    )
    assert got == {("account_transfers_credits", ""): 1, ("credit_card_transfers", ""): 2, ("owner_distributions", ""): 4, ("loan_proceeds", ""): 8, ("fixed_asset_purchases", ""): 16, ("uncategorized_non_pnl_credits", ""): 32, ("operating_expenses", "Refund"): 64, ("direct_costs", "Fuel"): -128}


def test_bridge_is_the_change_of_cash(spark):
    tx = ledger(spark, dict(is_transfer=True, amount=7), cost(200, J(2)), dict(amount=1000, business_category="Sales Revenue", include_in_pnl=True), back(200, J(3)), dict(is_owner_related=True, is_credit=False, amount=11), dict(amount=5, is_credit=False))
    wide = pnl.summary(pnl.lines(tx, pnl.total_period()))
    change = tx.agg(F.sum(S.signed(F.col("amount"), F.col("is_credit")))).first()[0]
    assert insights.bridge(wide).where("line = 'Net Cash Change'").first().amount == change


def test_categorise(spark):
    rules = classify.ordered([classify.Rule(r"\bPILOT\b", "Travel", "Travel", direction="debit", priority=9)])
    rows = [("WEB XFER TO SAVINGS", False), ("Pilot 12", False), ("Pilot 12", True), ("what is this", True), ("FREIGHT", True), ("Incoming Wire Transfer Fee", False)]
    tx = ledger(spark, *(dict(description=t, is_credit=c) for t, c in rows))
    got = {r.sequence: r for r in classify.mark_deposits(classify.categorise(tx, rules)).collect()}
    assert [got[i].business_category for i in range(1, 7)] == ["Account Transfer", "Travel", "CPA Review Required", "CPA Review Required", "Freight Revenue", "Bank and Merchant Fees"]
    assert got[1].cpa_review and got[1].is_transfer and not got[2].cpa_review and got[4].review_reason.startswith("Uncategorized deposit")


def test_rule_tables():
    rules = classify.default_rules()
    assert len(rules) == 160 and sum(r.tax_category == "non-pl" for r in rules) == 19 and sum(r.is_income for r in rules) == 13
    (rule,) = classify.configured_rules([{"pattern": "X", "category": "Owner Contribution"}])
    assert rule.is_owner_related and not rule.include_in_pnl and rule.priority == 0 and rule.tax_category == "CPA Review"
    with pytest.raises(Exception):
        classify.configured_rules([{"pattern": "(", "category": "Fuel"}])
    assert len(classify.option_issues({"fiscal_year_start": 13, "projection_months": 0, "tax_reserve_pct": 2, "rules": [{"direction": "up", "deductibility": "?"}], "aliases": {" ": "x"}})) == 6
    assert classify.option_issues({}) == []


def test_personal(spark):
    rows = ["NETFLIX", "SALES TAX PILOT", "PAYPAL PURCHASE HIDIVE", "GOOGLE  THINGS", "GOOGLE DramaBox", "SQ HOSHI", "SQ STORE", "nothing"]
    df = spark.createDataFrame([(r,) for r in rows], "description string")
    got = {r.description: r.category for r in classify.categorise_personal(df).collect()}
    assert [got[r] for r in rows] == ["Subscriptions", "Bank Fees", "Subscriptions", "Subscriptions", "Subscriptions", "Other", "Shopping", "Other"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    amounts = {"$1,234.56": D("1234.56"), "-$500.00": D(-500), "": D(0), "-": D(0), "42.75": D("42.75"), "$ 1.00": D(1), "($9.99)": D("-9.99"), "x": None}
    for text, want in amounts.items():
        assert one(spark, S.parse_amount(F.lit(text))) == want
    assert one(spark, S.us_date(F.lit("2/30/2023"))) is None and one(spark, S.us_date(F.lit("1/5/2023"))) == date(2023, 1, 5)
    assert one(spark, S.percent(F.lit(1), F.lit(0))) == "N/A" and one(spark, S.percent(F.lit(1), F.lit(8))) == "12.5%"
    merchant = one(spark, S.merchant(F.lit("XX5326 DEBIT CARD 01/01 13:02 STORE NAME IA 52001 AB12")))
    assert merchant == "STORE NAME AB12" and one(spark, S.merchant(F.lit("12345678"))) == "12345678"
    assert one(spark, S.glob(F.lit("ABC"), "AB*BC")) and not one(spark, S.glob(F.lit("ABC"), "B*")) and one(spark, S.glob(F.lit("XAYBZ"), "X*A*B*Z"))
    assert one(spark, S.mask_account(F.lit("12345678 123"))) == "XXXX5678 123"
    assert one(spark, S.iso_week(F.lit("2021-01-03").cast("date"))) == "2020-W53"
    for text, want in {"=SUM(A1:A10)": "'=SUM(A1:A10)", "+BAD": "'+BAD", "@INJECT": "'@INJECT", "-EXPLOIT": "'-EXPLOIT", "fine": "fine"}.items():
        assert one(spark, S.csv_safe(F.lit(text))) == want
    assert one(spark, S.share_label(F.lit(1.0), F.lit(10000.0))) == "<0.1%"


def test_redact(spark):
    text = "Acme Corp at 123 Main St, call (319) 555-1234 or a.b@c.org XXXX2136, PO 7"
    got = one(spark, redact.redact(F.lit(text), ["acme corp"], ["PO 7"]))
    assert got == "Entity 001 at [ADDRESS REDACTED], call [PHONE] or [EMAIL] [ACCOUNT], [ADDRESS REDACTED]"
    assert one(spark, redact.redact(F.lit(text), mask=False)) == text
    df = spark.createDataFrame([(1, "B", 1), (1, "a", 2), (1, "b", 3), (2, "A", 9)], "account_id int, v string, n int")
    got = {(r.account_id, r.key): r.pseudonym for r in redact.pseudonyms(df, F.col("v"), [F.col("n")], "Person").collect()}
    assert got == {(1, "b"): "Person 001", (1, "a"): "Person 002", (2, "a"): "Person 001"}


def statements(spark, *rows):
    schema = "account_id int, statement_id string, statement_dt date, beginning_balance decimal(18,2), ending_balance decimal(18,2), total_credits decimal(18,2), total_debits decimal(18,2), credit_count int, debit_count int"
    return spark.createDataFrame([(1, f"S{i}", d, *map(D, m), c, n) for i, (d, m, c, n) in enumerate(rows, 1)], schema)


def test_reconcile(spark):
    tx = ledger(spark, dict(amount=200), dict(amount=150, is_credit=False))
    good = statements(spark, (J(31), (100, 150, 200, 150), 1, 1))
    assert reconcile.reconcile(good, tx).first().passed and reconcile.reconcile_personal(good, tx).first().passed
    bad = reconcile.reconcile(statements(spark, (J(31), (100, 150, 200, 150), 5, 1)), tx).first()
    assert not bad.passed and bad.warnings == ["Credit mismatch: parsed 1/200.00 vs expected 5/200.00"]
    off = statements(spark, (J(31), (100, "150.01", 200, 150), 1, 1))
    assert reconcile.reconcile(off, tx).first().passed and not reconcile.reconcile(off, tx, "0.00").first().passed
    three = statements(spark, (J(31), (0, 1, 1, 0), 1, 0), (date(2023, 2, 28), (2, 3, 1, 0), 1, 0), (date(2023, 4, 30), (3, 3, 0, 0), 0, 0))
    assert [r.gap for r in reconcile.continuity(three).collect()] == [1]
    assert [r.label for r in reconcile.missing_months(three).collect()] == ["Gap: Feb 2023 -> Apr 2023"]
    none = three.limit(0)
    assert reconcile.reconcile(none, tx).collect() == reconcile.continuity(none).collect() == []


def test_periods(spark):
    first, last = periods.quarter_range(F.lit(2025), F.lit(2), 10)
    assert (one(spark, first), one(spark, last)) == (date(2026, 1, 1), date(2026, 3, 31))
    for start, d, want in ((10, "2025-10-01", (2025, 1)), (10, "2025-09-30", (2024, 4)), (2, "2025-01-31", (2024, 4)), (1, "2025-12-31", (2025, 4))):
        y, q = pnl.fiscal(F.lit(d).cast("date"), start)
        assert (one(spark, y), one(spark, q)) == want
    year = periods.calendar(spark, 2023).collect()
    assert len(year) == 16 and year[1].last_dt == date(2023, 2, 28) and year[12].label == "Q1 2023"


def test_project(spark):
    history = spark.createDataFrame([(1, f"2023-0{i}", D(r), D(e)) for i, (r, e) in enumerate(((10000, 7000), (11000, 7200), (10500, 7100)), 1)], "account_id int, period string, revenue decimal(18,2), expenses decimal(18,2)")
    cash = spark.createDataFrame([(1, D(5000), date(2023, 4, 1))], "account_id int, starting_cash decimal(18,2), start_dt date")
    options = project.Options(6, 3, 0.03, 0.02, 0.30, 0.25, 1000.0, {}, {"conservative": 0.01, "growth": 0.06})
    rows = project.project(history, cash, options).orderBy("scenario", "month_idx").collect()
    assert len(rows) == 18 and rows[0].month_dt == date(2023, 4, 1)
    base = [r for r in rows if r.scenario == "base"]
    assert base[0].revenue == D("10815.00") and base[0].expenses == D("7242.00") and base[0].net_income == D("328.50") and base[0].ending_cash == D("5328.50")
    assert base[-1].tax_reserve > 0 and all(x.revenue < y.revenue for x, y in zip(base, base[1:]))
    assert project.assumptions(options, "growth")["revenue_growth_rate"] == "6.0%"


def test_extracts_and_files(spark, tmp_path):
    tx = ledger(spark, dict(description="=1+1", include_in_pnl=True), cost(600, J(3), text="LOAN TOOL"))
    parts = export.extracts(tx)
    assert parts["revenue_detail"].first().Description == "'=1+1" and parts["loan_activity"].count() == 1 and parts["fixed_assets"].count() == 1
    export.write_csv(export.audit(tx), str(tmp_path / "audit"))
    with pytest.raises(Exception):
        export.write_csv(export.audit(tx), str(tmp_path / "audit"))
    export.write_csv(export.audit(tx), str(tmp_path / "audit"), overwrite=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "audit")).count() == 2


def test_fiscal_quarter_months(spark):
    got = spark.range(1, 5).select(*(periods.quarter_months(F.col("id").cast("int"), start).alias(f"m{start}") for start in (1, 10, 2))).orderBy("m1").collect()
    assert {tuple(r.m1) for r in got} == {(1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12)}
    assert {tuple(r.m10) for r in got} == {(10, 11, 12), (1, 2, 3), (4, 5, 6), (7, 8, 9)}
    assert {tuple(r.m2) for r in got} == {(2, 3, 4), (5, 6, 7), (8, 9, 10), (11, 12, 1)}


# What fits each pattern, of these texts.
GLOB_TEXTS = ["ABC", "ABBC", "AC", "A.C", "AXBYC", "CBA", "", "A\nB\nC", "BC", "AB"]
GLOBS = {
    "AB*BC": ["ABC", "ABBC"],
    "*": GLOB_TEXTS,
    "A*": ["ABC", "ABBC", "AC", "A.C", "AXBYC", "A\nB\nC", "AB"],
    "*C": ["ABC", "ABBC", "AC", "A.C", "AXBYC", "A\nB\nC", "BC"],
    "A*B*C": ["ABC", "ABBC", "AXBYC", "A\nB\nC"],
    "ABC": ["ABC"],
    "A**C": ["ABC", "ABBC", "AC", "A.C", "AXBYC", "A\nB\nC"],
    "*B*": ["ABC", "ABBC", "AXBYC", "CBA", "A\nB\nC", "BC", "AB"],
    "A.C": ["A.C"],
    "": [""],
}


@pytest.mark.parametrize("pattern", GLOBS)
def test_globs(spark, pattern):
    df = spark.createDataFrame([(t,) for t in GLOB_TEXTS], "t string").where(S.glob(F.col("t"), pattern))
    assert sorted(r.t for r in df.collect()) == sorted(GLOBS[pattern])


def test_matching_by_parts_as_in_one_group(spark):
    """Many rows of one merchant over two years, with gaps: pairs as one walk over the whole list gives them."""
    rng = random.Random(7)
    rows = []
    for day in sorted(rng.sample([*range(0, 200), *range(320, 500), *range(620, 640)], 150)):
        back = rng.random() < 0.3
        rows.append((1, f"s{day // 30:03d}", day, len(rows), "SHOP", rng.choice([100, 500, 900, 1000]) + rng.randrange(3), back))
    base = date(2020, 1, 1)
    data = [(a, s, base + timedelta(d // 30 * 30), base + timedelta(d), n, desc, D(c) / 100, back, "Payment Reversal" if back else "Fuel", False, False, False, False, True) for a, s, d, n, desc, c, back in rows]
    schema = "account_id int, statement_id string, statement_dt date, post_dt date, sequence int, description string, amount decimal(18,2), is_credit boolean, business_category string, is_transfer boolean, is_owner_related boolean, is_loan boolean, is_fixed_asset boolean, include_in_pnl boolean"
    got = {(r.reversal_sequence, r.debit_sequence, r.cents) for r in pnl.match_reversals(spark.createDataFrame(data, schema).repartition(3), pnl.total_period()).collect()}
    used, want = set(), set()
    for _, _, day, n, _, c, back in rows:
        if back:
            scored = []
            for _, _, d, k, _, x, b in rows:
                if not b and k not in used and 0 <= day - d <= 90 and not (c < x and c / x < 0.8):
                    scored.append((-(min(c, x) / max(c, x) - (day - d) / 36500), k, min(c, x)))
            if scored:
                _, k, cents = min(scored)
                used.add(k)
                want.add((n, k, cents))
    assert got == want and len(want) > 15
