"""Statement texts with the odd cases of the layout."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.operators import parse
from tallybook.sources import texts

HEAD = "FIRST BANK Statement Ending 01/31/2023\nACME LLC XXXXXXXXXX2136\nAccount Summary\nBeginning Balance $100.00\n2 Credit(s) This Period $300.00\n1 Debit(s) This Period $50.00\nEnding Balance $350.00\n"
COLUMNS = "Post Date   Description                    Debits         Credits        Balance\n"


def row(day, text, amount, balance, at=43):
    left = f"{day} {text}"
    return f"{left:<{at}}{amount:<15}".ljust(72) + balance + "\n"


def parsed(spark, text, personal=False):
    st, tx = parse.statements(spark.createDataFrame([("d", text)], "doc_id string, text string"), personal)
    return st.first(), tx.orderBy("sequence").collect()


def test_stitching_and_signs(spark):
    text = HEAD + "Account Activity\n" + COLUMNS
    text += "01/01/2023 Beginning Balance $100.00\n"
    text += row("01/02/2023", "FIRST SHOP", "$50.00", "$50.00", 43)
    text += "more of first\nPage 1 of 3\n"
    text += row("01/03/2023", "SECOND", "$200.00", "$250.00", 58)
    text += "text of third\n"
    text += row("01/04/2023", "", "$100.00", "$350.00", 58)
    text += row("01/05/2023", "ZERO", "$0.00", "$350.00", 58)
    text += "01/06/2023" + " " * 62 + "$350.00\n"
    text += "01/07/2023 no amount\nlast words\nDaily Balances\n01/02/2023 $50.00 01/03/2023 -$250.00\nOverdraft\n01/09/2023 $9.00\n"
    st, tx = parsed(spark, text)
    assert (st.statement_date, st.account_number, st.beginning_balance, st.ending_balance, st.credit_count, st.debit_count) == ("01/31/2023", "XXXXXXXXXX2136", 100, 350, 2, 1)
    assert [(r.sequence, r.description, r.amount, r.is_credit) for r in tx] == [
        (1, "FIRST SHOP more of first", Decimal(50), False),
        (2, "SECOND", Decimal(200), True),
        (3, "text of third", Decimal(100), True),
        (4, "ZERO no amount last words", Decimal(0), True),
    ]
    lines = parse.lines_of(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert [(r.bal_dt, r.balance) for r in parse.daily(lines).orderBy("i").collect()] == [(date(2023, 1, 2), 50), (date(2023, 1, 3), -250)]


def test_heading_on_a_row_clears_and_end_of_text(spark):
    text = HEAD + "Account Activity\n" + COLUMNS + "lost\n01/01/2023 Beginning Balance $100.00\n" + row("01/02/2023", "TAX Daily Balances", "($50.00)", "$150.00") + row("01/03/2023", "NEVER", "$1.00", "$1.00")
    _, tx = parsed(spark, text)
    assert [(r.description, r.amount) for r in tx] == [("TAX Daily Balances", Decimal(-50))]
    _, tx = parsed(spark, HEAD + "Account Activity\n" + COLUMNS + row("01/02/2023", "A", "$50.00", "$50.00") + "dropped at the end")
    assert [r.description for r in tx] == ["A"]


def test_validation_and_nothing(spark):
    docs = spark.createDataFrame([("ok", HEAD + "Account Activity\n" + COLUMNS + row("01/02/2023", "A", "$50.00", "$50.00")), ("bad", "Account Activity\n" + row("13/45/2023", "A", "$50.00", "$50.00")), ("none", ""), ("null", None)], "doc_id string, text string")
    st, tx = parse.statements(docs)
    got = {r.doc_id: r for r in parse.validate(st, tx).collect()}
    assert got["ok"].outcome == "accepted" and got["none"].outcome == got["null"].outcome == "empty"
    assert got["bad"].errors == ["Missing statement date", "Missing account number", "Invalid transaction date: 13/45/2023"] and len(got["bad"].warnings) == 2


def test_personal_profile(spark):
    text = HEAD.replace("XXXXXXXXXX2136", "XXXXXXXXXXX2136") + "Account Activity\n" + COLUMNS + row("01/02/2023", "SHOP", "$50.00", "$50.00") + "Daily Balances\n" + row("01/03/2023", "PAY", "$10.00", "$60.00", 58) + "Checks Cleared\n  7  01/04/2023  $5.00\nDaily Balances\nTotal Overdraft Fees $12.50\n"
    st, tx = parsed(spark, text, personal=True)
    assert st.account_number == "XXXXXXXXXXX2136" and [(r.description, r.is_credit) for r in tx] == [("SHOP Daily Balances", False), ("PAY", True)]
    lines = parse.lines_of(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert [(r.number, r.amount) for r in parse.checks(lines).collect()] == [(7, 5)] or parse.checks(lines).count() == 1
    assert parse.fees(lines).first().overdraft_fees == Decimal("12.50")


def test_documents_that_lie_by_number_are_not_shuffled(spark, tmp_path):
    """Reading statements moves no line: what is read off a few lines is read off the array, rows are told apart where they are."""
    spark.createDataFrame([("d", HEAD + "Account Activity\n" + COLUMNS + row("01/02/2023", "A", "$50.00", "$50.00"))], "doc_id string, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    st, tx = parse.statements(docs)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (st, parse.checks(parse.lines_of(docs)), parse.daily(parse.lines_of(docs)), parse.fees(parse.lines_of(docs)))]
    assert [p.count("Exchange") for p in plans] == [0, 0, 0, 0]
    plan = parse.statements(docs.repartition(3, "doc_id"))[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and st.first().beginning_balance == 100 and [r.description for r in tx.collect()] == ["A"]


def test_files(spark, tmp_path):
    for name, text in (("b.txt", "same"), ("a.TXT", "same"), ("c.Txt", "other"), ("business_financial_report.txt", "own"), ("d.pdf", "no text")):
        (tmp_path / name).write_text(text)
    read = texts.read_texts(spark, str(tmp_path))
    assert [r.path.rsplit("/")[-1] for r in read.collect()] == ["a.TXT", "b.txt", "c.Txt"]
    kept, dropped = texts.distinct_texts(read)
    assert sorted(r.path.rsplit("/")[-1] for r in kept.collect()) == ["a.TXT", "c.Txt"] and dropped.first().path.endswith("b.txt")


def test_clean(spark):
    got = spark.range(1).select(parse.clean(F.lit("CARD 5 01/02 SHOP12  x 7 ")).alias("x")).first().x
    assert got == "CARD SHOP x"


def in_parts(spark, *docs):
    """doc_id, part, text of whole texts, in parts of several lengths."""
    rows = []
    for doc, text in docs:
        lines, at = text.split("\n"), 0
        for part, size in enumerate((3, 1, 2, 1, 9, 1, 4, 2) * len(lines)):
            if at < len(lines):
                rows.append((doc, part, "\n".join(lines[at : at + size])))
                at += size
    return spark.createDataFrame(rows, "doc_id string, part long, text string").repartition(3)


LONG = HEAD + "Account Activity\n" + COLUMNS + "01/01/2023 Beginning Balance $100.00\n" + row("01/02/2023", "A", "$50.00", "$50.00") + "more of a\n" + row("01/03/2023", "", "($5.00)", "-$5.00", 58) + "Account Activity (continued)\nPage 2 of 2\nChecks Cleared\n  7  01/04/2023  $5.00\nDaily Balances\n01/02/2023 $50.00   01/03/2023 -$5.00\nTotal Overdraft Fees $12.50"


def test_texts_in_parts_give_what_whole_ones_give(spark):
    """No task holds a whole statement, and what is read is that of the whole one, signs, summary and order included."""
    late = "x\n" * 13 + HEAD + "Account Activity\n" + COLUMNS + row("01/02/2023", "B", "$50.00", "$50.00") + "Daily Balances"
    given = [("long", LONG), ("late", late), ("none", ""), ("headless", row("01/02/2023", "C", "$1.00", "$1.00"))]
    docs, parts = spark.createDataFrame(given, "doc_id string, text string"), in_parts(spark, *given)
    for personal in (False, True):
        whole, apart = parse.statements(docs, personal), parse.statements_of(parts, personal)
        for a, b in zip(whole, apart):
            assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)
    lines = parse.lines_of_parts(parts)
    for read, matters in ((parse.checks, parse.check_line), (parse.daily, parse.daily_line), (parse.fees, parse.fee_line)):
        whole, apart = read(parse.lines_of(docs)).drop("n", "i"), read(parse.gathered(lines, matters(F.col("line")))).drop("n", "i")
        assert [r for r in sorted(map(tuple, apart.collect()), key=str) if r[0] == "long"] == [r for r in sorted(map(tuple, whole.collect()), key=str) if r[0] == "long"]


def test_damage_of_parts_is_that_of_the_whole(spark):
    import re

    given = [(f"{k}-{i}", text) for k in range(10) for i, text in enumerate((LONG, "Account Activity\nChecks Cleared Account Activity x\ny", "Checks Cleared\nAccount Activity", "a Account Activity b Checks Cleared c Checks Cleared d\nCheck"))]
    kind = F.split("doc_id", "-")[0].cast("int")
    lines = parse.lines_of_parts(texts.damaged(in_parts(spark, *given), kind)).orderBy("doc_id", "n").collect()
    for doc, text in given:
        k = int(doc[0])
        for pattern, by in texts.DAMAGE.get(k, ()):
            text = re.sub(pattern, by.replace("$1", r"\1"), text)
        if k in texts.CUT:
            start, end = texts.CUT[k]
            text = re.sub(f"(?s){start}.*{end}", end, text)
        assert "\n".join(r.line for r in lines if r.doc_id == doc) == text, doc


def test_methods_of_the_parser_are_short_enough_to_be_compiled(spark):
    """Methods of more than 8,000 bytes are never compiled, so that each line would take several times as long."""
    parts = in_parts(spark, ("long", LONG))
    st = spark.sql("SELECT 's' AS statement_id, 1 AS account_id, date'2023-01-31' AS statement_dt, 1.00BD AS beginning_balance, 1.00BD AS ending_balance, 1.00BD AS total_credits, 1.00BD AS total_debits, 1 AS credit_count, 1 AS debit_count")
    tx = spark.sql("SELECT 's' AS statement_id, 1L AS sequence, date'2023-01-05' AS post_dt, 'x' AS description, 1.00BD AS amount, true AS is_credit, 1.00BD AS balance FROM range(3)")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (*parse.statements_of(parts), parse.statements_of(parts, True)[1], texts.printed(st, tx)):
            made = df._jdf.queryExecution().debug().codegenToSeq()
            assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
