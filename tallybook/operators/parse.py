"""Statement text to rows: what holds for a document is read off its lines as an array, what holds for a line where it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import AMOUNT, MONEY, parse_amount, us_date

# Headings and marks of the statements' layout.
SECTION_ENDINGS = ("Checks Cleared", "Daily Balances", "Service Charges", "Overdraft", "Total Overdraft Fees", "Managing Your Accounts", "Client Contact")
ARTIFACT_WORDS = ("Checking Account Statements", "Account Activity", "Managing Your Accounts", "Client Contact", "RETURN SERVICE REQUESTED")
ARTIFACT_STARTS = (r"^[0-9A-F]{32}", r"^Page \d+ of \d+", r"^\d{8}\s+Checking Account Statements", r"^#\d+\s+", r"^\d{1,2}\s*$")
BUSINESS_WORDS = ("Summary of Accounts", "Average Ledger", "Service Charges")
BUSINESS_STARTS = (r"^[A-Z\s]+LLC\s+X+", r"^(?:CLASSIC|BASIC|BUSINESS)\s+CHECKING")
UNSIGNED = r"\$[\d,]+\.\d{2}"
DATED = r"^\d{2}/\d{2}/\d{4}"
HEADER_LINES = 15
# What is taken out of a description, in this order.
DESCRIPTION_NOISE = ((r"\d\s+\d{2}/\d{2}", ""), (r"\s+\d{1,2}\s*$", ""), (r"\b\w{50,}\b", ""), (r"\b([A-Za-z]+)\d{1,2}\b", "$1"), (r"\s+", " "))

any_of = lambda tests: reduce(Column.__or__, tests)


#: What \s stands for in a pattern.
BLANKS = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """text without blanks at its ends. A pattern would try the rest of each run of blanks from each of its blanks; most are plain ones, which alone go faster."""
    return F.btrim(F.trim(text), F.lit(BLANKS))


def held(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text holds one of words. As one expression: a chain of tests makes methods that are too long to be compiled."""
    return F.exists(F.array(*map(F.lit, words)), text.contains)


def clean(text: Column) -> Column:
    """A description without references, stray page numbers and overlong words."""
    for pattern, by in DESCRIPTION_NOISE:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def section_ending(line: Column) -> Column:
    return held(line, SECTION_ENDINGS)


def page_artifact(line: Column, personal: bool = False) -> Column:
    """Whether a line is part of a page's head or foot, not of a description."""
    s = strip(line)
    tests = [s == "", line.contains("\f"), (s.rlike(r"^[A-Z]{2}\s+\d{5}")) & (F.length(s) < 20)]
    tests += [held(s, ARTIFACT_WORDS), s.rlike("|".join(ARTIFACT_STARTS))]
    if personal:
        tests += [s.contains("Statement Ending"), s.contains("continued"), s.contains("Post Date"), s.rlike(r"^BASIC CHECKING\s*-\s*X+")]
    else:
        tests += [s.contains("Statement Ending") & ~s.contains("Page"), F.lower(s).contains("continued"), s.contains("Post Date") & line.contains("Description"), s.contains("BASIC CHECKING") & s.contains("XXXX")]
        tests += [held(s, BUSINESS_WORDS), s.rlike("|".join(BUSINESS_STARTS))]
    return any_of(tests)


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with lines, an array, for text: what is read off a few lines moves no others."""
    return docs.withColumn("lines", F.split("text", "\n")).drop("text")


def _first(found: Column) -> Column:
    """Place (from 1) of the first true of an array, 0 if there is none."""
    return F.array_position(found, True)


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def _part(lines: DataFrame, heading: str, stops, with_stop: bool = False) -> DataFrame:
    """lines with part, an array: the lines after the first that holds heading, up to one that stops (a function of a line); null without heading."""
    start = _first(F.transform("lines", lambda x: x.contains(heading)))
    rows = lines.withColumn("start", start)
    rows = rows.withColumn("part", F.when(F.col("start") > 0, F.filter(F.slice("lines", F.col("start") + 1, F.size("lines")), lambda x: ~x.contains(heading))))
    rows = rows.withColumn("stop", _first(F.transform("part", stops)))
    end = F.col("stop") if with_stop else F.col("stop") - 1
    return rows.withColumn("part", F.when(F.col("stop") > 0, F.slice("part", F.lit(1), end)).otherwise(F.col("part"))).drop("start", "stop")


def header(lines: DataFrame, personal: bool = False) -> DataFrame:
    """lines with statement_date (text), account_number: the first of each in the first lines."""
    account = r"(XXXXXXXXXXX\d{4})" if personal else r"(XXXXXXXXXXX?\d{4})"

    def first(pattern: str) -> Column:
        found = F.transform(F.slice("lines", 1, HEADER_LINES), lambda x: F.regexp_extract(x, pattern, 1))
        return F.when(F.col("lines").isNotNull(), F.coalesce(F.get(F.filter(found, lambda x: x != ""), F.lit(0)), F.lit("")))

    return lines.withColumns({"statement_date": first(r"Statement Ending\s+(\d{2}/\d{2}/\d{4})"), "account_number": first(account)})


def summary(lines: DataFrame, personal: bool = False) -> DataFrame:
    """lines with balances, totals and counts of the account summary; of repeated lines the last counts."""

    def kind(line: Column) -> Column:
        credit, debit = (line.contains(w) & line.contains("This Period") for w in ("Credit", "Debit"))
        named = F.when(line.contains("Beginning Balance"), "beginning").when(credit, "credit").when(debit, "debit").when(line.contains("Ending Balance"), "ending")
        return named if personal else F.when(section_ending(line), "stop").otherwise(named)

    rows = _part(lines, "Account Summary", lambda x: kind(x).isin("stop", "ending"), with_stop=True)
    of = lambda k, pattern, group: _last(F.filter(F.transform(F.filter("part", lambda x: kind(x) == k), lambda x: F.regexp_extract(x, pattern, group)), lambda x: x != ""))
    money = lambda k: F.coalesce(parse_amount(of(k, UNSIGNED if personal else AMOUNT, 0)), F.lit(0)).cast(MONEY)
    count = lambda k, word: F.coalesce(of(k, rf"(\d+)\s+{word}", 1).try_cast("int"), F.lit(0))
    return rows.withColumns({"beginning_balance": money("beginning"), "ending_balance": money("ending"), "total_credits": money("credit"), "total_debits": money("debit"), "credit_count": count("credit", "Credit"), "debit_count": count("debit", "Debit")}).drop("part")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, n, line of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def lines_of_parts(parts: DataFrame) -> DataFrame:
    """doc_id, n, line of texts in parts (doc_id, part, text), each some whole lines: no text is ever in one piece. n goes by the order of the lines."""
    rows = parts.select("doc_id", "part", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("doc_id", (F.col("part") * F.lit(2**31) + F.col("i")).alias("n"), "line")


def counted_lines(parts: DataFrame) -> DataFrame:
    """As lines_of_parts(), n being the place of a line in its document, from 0."""
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.select("doc_id", "part", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)))
    return rows.select("doc_id", "at", F.posexplode("lines").alias("i", "line")).select("doc_id", (F.col("at") + F.col("i")).alias("n"), "line")


def gathered(lines: DataFrame, matters: Column) -> DataFrame:
    """lines (doc_id, n, line) as doc_id, lines (an array): of each document those that matter."""
    found = lines.where(matters).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return found.withColumn("lines", F.transform("lines", lambda x: x["line"]))


def printed_amount(text: Column) -> Column:
    """parse_amount() of what AMOUNT or UNSIGNED found."""
    digits = F.translate(text, "$,()-", "").try_cast(MONEY)
    return F.when(text.startswith("(") | text.startswith("-"), -digits).otherwise(digits)


def _told(lines: DataFrame, personal: bool) -> DataFrame:
    """What a line (doc_id, n, line) says by itself: kind, said, date, amounts and their places, headings.

    Kinds: TX, CLEAR, END, BUF (text), ONE (text or nothing, by the columns' places) or none. Lines without one are not left out
    here: a filter on what was worked out would work it out once more.
    """
    line = F.col("line")
    money = UNSIGNED if personal else AMOUNT
    has = line.contains
    credit, debit = (has(w) & has("This Period") for w in ("Credit", "Debit"))
    words = F.struct(
        (has("Checks Cleared") if personal else section_ending(line)).alias("ends"), has("Beginning Balance").alias("begins"), has("Ending Balance").alias("closes"), (credit | debit).alias("total"),
        has("Account Activity").alias("opens"), has("Account Summary").alias("sums"), has("Post Date").alias("names"),
    )
    # all of these have small letters, and most lines have none
    rows = lines.withColumns({"dated": line.rlike(DATED), "words": F.when(line.rlike("[a-z]"), words)})
    word = lambda w: F.coalesce(F.col(f"words.{w}"), F.lit(False))
    dated, ends = F.col("dated"), word("ends")
    rows = rows.withColumn("amounts", F.when(dated, F.regexp_extract_all(line, F.lit(money), F.lit(0))))
    size = F.coalesce(F.size("amounts"), F.lit(0))
    at = lambda back: F.try_element_at("amounts", F.when(size > back, size - back))
    rows = rows.withColumns({"size": size, "last": at(0), "other": at(1)}).drop("amounts")
    # an amount holds one sign of the currency and is no part of a later one, so the last place of its text is its own
    place = lambda text, amount: F.length(text) - F.length(F.call_function("substring_index", text, amount, F.lit(-1))) - F.length(amount)
    rows = rows.withColumn("single_at", place(line, F.col("last")))
    rows = rows.withColumn("amount_at", place(F.substring("line", F.lit(1), F.col("single_at")), F.col("other")))
    size = F.col("size")
    marker = word("begins") | word("closes")
    stops = ends if personal else ends & ~dated
    alone = F.lit(None) if personal else F.lit("ONE")
    kind = F.when(stops, "END").when(dated & marker, "CLEAR").when(dated & (size == 0), "BUF").when(dated & (size == 1), alone).when(dated, "TX").when(~page_artifact(line, personal), "BUF")
    named = F.when(word("begins"), "beginning").when(word("total"), "total").when(word("closes"), "stop")
    rows = rows.withColumns({
        "kind": kind,
        "stop": stops | (ends & dated & (size > 1) & ~marker),
        "summary": named if personal else F.when(ends, "stop").otherwise(named),
        "opens": word("opens"),
        "sums": word("sums"),
        "names": word("names"),
    })
    place = lambda w: F.when(F.instr(line, w) > 0, F.instr(line, w) - 1).alias(f"{w.lower()}_at")
    columns = ("Debits", "Credits", "Balance")
    until = F.when(size > 1, F.col("amount_at")).when(size == 1, F.col("single_at")).otherwise(F.length("line"))
    said = F.when(dated, F.substring("line", F.lit(11), F.greatest(F.lit(0), until - 10))).otherwise(line)
    return rows.select(
        "doc_id", "n", "kind", strip(said).alias("said"), F.when(dated, F.substring("line", 1, 10)).alias("post_date"), "other", "last", "single_at", "amount_at", "stop", "summary", "opens", "sums", "names",
        F.when(F.col("names") & any_of(line.contains(w) for w in columns), F.struct(*map(place, columns))).alias("places"),
        F.when(F.col("summary") == "beginning", F.nullif(F.regexp_extract("line", money, 0), F.lit(""))).alias("begun"),
    )


def activity(lines: DataFrame, personal: bool = False) -> DataFrame:
    """doc_id, sequence, post_date (text), description, amount, is_credit, balance of the account activity of lines (doc_id, n, line).

    Text lines between two transactions belong to the earlier one if the later has
    a text of its own, else to the later; before a heading they belong to the last one; at the end of the text they go.
    Lines are told apart where they are; what holds from a line on is handed down a document's lines in their order, so that no
    document is ever in memory, and documents that lie by doc_id already are not shuffled. A document's segments, each a
    transaction with the text before it, are what is left for the second pass.
    """
    rows = _told(lines, personal)
    order = Window.partitionBy("doc_id").orderBy("n")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = lambda c: F.coalesce(F.max(c).over(before), F.lit(False))
    rows = rows.withColumns({"opened": seen("opens"), "summed": seen("sums")})
    told = F.col("summed") & ~F.col("sums")
    rows = rows.withColumns({"head": F.first(F.when(F.col("opened"), F.col("places")), ignorenulls=True).over(before), "told": seen(told & (F.col("summary") == "stop"))})
    headed = F.col("head").isNotNull()
    skipped = (F.col("kind") == "ONE") & headed & (F.col("single_at") >= F.coalesce("head.balance_at", F.lit(9999)) - 3)
    kind = F.when(F.col("opened") & (headed | ~F.col("names")) & ~skipped, F.when(F.col("kind") == "ONE", "BUF").otherwise(F.col("kind")))
    rows = rows.select("doc_id", "n", kind.alias("kind"), "said", "post_date", "other", "last", "amount_at", "stop", "head", F.when(F.col("summed") & ~F.col("sums") & ~F.col("told"), F.col("begun")).alias("begun"))
    some = F.col("kind").isNotNull()
    closes = F.when(F.col("kind").isin("TX", "CLEAR"), 1).otherwise(0)
    rows = rows.withColumns({"stopped": seen(F.when(some, F.col("stop"))), "seg": F.coalesce(F.sum(closes).over(before), F.lit(0)), "begun": F.last("begun", ignorenulls=True).over(whole)})
    rows = rows.where(some & ~F.col("stopped"))
    event = F.when(F.col("kind").isin("TX", "END"), F.struct("kind", "said", "post_date", "other", "last", "amount_at", "head", "begun"))
    text = F.when((F.col("kind") == "BUF") & (F.col("said") != ""), F.struct("n", "said"))
    segs = rows.groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(text)).alias("texts"), F.first(event, ignorenulls=True).alias("event"))
    joined = F.trim(F.array_join(F.transform("texts", lambda x: x["said"]), " "))
    events = segs.where("event is not null").select("doc_id", "seg", joined.alias("buffer"), "event.*")
    events = events.withColumns({"amount": printed_amount(F.col("other")), "balance": printed_amount(F.col("last")), "own": clean(F.when((F.col("kind") == "TX") & (F.col("said") != ""), F.col("said")).otherwise(F.col("buffer")))})
    order = Window.partitionBy("doc_id").orderBy("seg")
    following = lambda c: F.lead(c).over(order)
    # a heading's own text is what stands before it, cleaned
    events = events.withColumns({"next_kind": following("kind"), "next_said": following("said"), "next_buffer": following("buffer"), "next_own": following("own"), "prev": F.lag("balance").over(order), "sequence": F.row_number().over(order)})
    tx = events.where("kind = 'TX'")
    extra = F.when((F.col("next_kind") == "TX") & (F.col("next_said") != ""), F.col("next_buffer")).when(F.col("next_kind") == "END", F.col("next_own"))
    tx = tx.withColumn("extra", F.coalesce(extra, F.lit(""))).withColumn("description", F.when(F.col("extra") != "", clean(F.concat_ws(" ", "own", "extra"))).otherwise(F.col("own")))
    zero = F.lit(0).cast(MONEY)
    tx = tx.withColumn("beginning_balance", F.coalesce(printed_amount(F.col("begun")), zero)).withColumn("from", F.coalesce("prev", "beginning_balance", zero))
    near = lambda x: F.abs(x - F.col("balance")) <= F.lit("0.01").cast(MONEY)
    credited, debited = near(F.col("from") + F.col("amount")), near(F.col("from") - F.col("amount"))
    rising = F.when(F.col("prev").isNotNull() | (F.col("beginning_balance") != 0), F.col("balance") > F.col("from")).otherwise(False)
    credits_at, debits_at, headed = F.coalesce("head.credits_at", F.lit(9999)), F.coalesce("head.debits_at", F.lit(0)), F.col("head").isNotNull()
    placed = F.when(headed & (F.col("amount_at") >= credits_at - 2), True).when(headed & (F.col("amount_at") < debits_at + 10) & (F.col("amount_at") + 6 < credits_at), False).otherwise(rising)
    is_credit = placed if personal else F.when(credited & ~debited, True).when(debited & ~credited, False).otherwise(placed)
    return tx.select("doc_id", "sequence", "post_date", "description", "amount", is_credit.alias("is_credit"), "balance")


#: A cleared check: number, date, amount. A day's balance: date, amount.
CHECK = r"^\s*(\d+)\s+(\d{2}/\d{2}/\d{4})\s+\$([\d,]+\.\d{2})"
DAY = r"(\d{2}/\d{2}/\d{4})\s+(-?\$[\d,]+\.\d{2})"
FEES = ("Total Overdraft Fees", "Total Returned Item Fees")


def summary_line(line: Column) -> Column:
    """Whether a line matters to header() or summary()."""
    return held(line, (*SECTION_ENDINGS, "Account Summary", "Beginning Balance", "This Period", "Ending Balance"))


def check_line(line: Column) -> Column:
    """Whether a line matters to checks()."""
    return held(line, ("Checks Cleared", "Daily Balances")) | line.rlike(CHECK)


def daily_line(line: Column) -> Column:
    """Whether a line matters to daily()."""
    return section_ending(line) | line.rlike(DAY)


def fee_line(line: Column) -> Column:
    """Whether a line matters to fees()."""
    return held(line, FEES)


def checks(lines: DataFrame) -> DataFrame:
    """doc_id, n, number, check_dt, amount of the cleared checks."""
    get = lambda i: F.regexp_extract("line", CHECK, i)
    rows = _part(lines, "Checks Cleared", lambda x: x.contains("Daily Balances")).select("doc_id", F.posexplode("part").alias("n", "line")).where(F.col("line").rlike(CHECK))
    return rows.select("doc_id", "n", get(1).cast("long").alias("number"), us_date(get(2)).alias("check_dt"), parse_amount(get(3)).alias("amount"))


def daily(lines: DataFrame) -> DataFrame:
    """doc_id, n, i, bal_dt, balance: all pairs of a date and an amount, several to a line."""
    line = F.col("line")
    rows = _part(lines, "Daily Balances", lambda x: x.contains("Overdraft") | section_ending(x)).select("doc_id", F.posexplode("part").alias("n", "line"))
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(DAY), F.lit(1)).alias("d"), F.regexp_extract_all(line, F.lit(DAY), F.lit(2)).alias("b"))
    return rows.select("doc_id", "n", F.posexplode(pairs).alias("i", "p")).select("doc_id", "n", "i", us_date(F.col("p.d")).alias("bal_dt"), parse_amount(F.col("p.b")).alias("balance"))


def fees(lines: DataFrame) -> DataFrame:
    """doc_id, overdraft_fees, returned_item_fees: the last printed amount of each."""

    def last(words: str) -> Column:
        found = F.transform(F.filter("lines", lambda x: x.contains(words)), lambda x: F.regexp_extract(x, UNSIGNED, 0))
        return F.coalesce(parse_amount(_last(F.filter(found, lambda x: x != ""))), F.lit(0)).cast(MONEY)

    return lines.where("lines is not null").select("doc_id", *(last(w).alias(name) for w, name in zip(FEES, ("overdraft_fees", "returned_item_fees"))))


def statements(docs: DataFrame, personal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(statements, transactions) of docs (doc_id, text)."""
    return summary(header(lines_of(docs), personal), personal).drop("lines"), activity(numbered(docs), personal)


def statements_of(parts: DataFrame, personal: bool = False) -> tuple[DataFrame, DataFrame]:
    """statements() of texts in parts (doc_id, part, text), of whatever length."""
    few = gathered(counted_lines(parts), (F.col("n") < HEADER_LINES) | summary_line(F.col("line")))
    return summary(header(few, personal), personal).drop("lines"), activity(lines_of_parts(parts), personal)


def validate(parsed: DataFrame, tx: DataFrame) -> DataFrame:
    """parsed with errors and warnings (arrays) and outcome: accepted, rejected (an error) or empty (no transactions)."""
    bad = us_date(F.col("post_date")).isNull()
    found = tx.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min_by("post_date", F.when(bad, F.col("sequence"))).alias("first_bad"), F.count_if(bad).alias("bad"))
    rows = parsed.join(found, "doc_id", "left")
    some = F.coalesce("rows", F.lit(0)) > 0
    date = F.coalesce("statement_date", F.lit(""))
    errors = F.array_compact(F.array(
        F.when(F.trim(date) == "", "Missing statement date").when(us_date(date).isNull(), F.concat(F.lit("Invalid statement date: "), date)),
        F.when(F.coalesce("account_number", F.lit("")) == "", "Missing account number"),
        F.when(F.col("bad") > 0, F.concat(F.lit("Invalid transaction date: "), "first_bad")),
    ))
    warnings = F.array_compact(F.array(
        F.when((F.col("beginning_balance") == 0) & (F.col("ending_balance") == 0) & some, "Summary balances not found (beginning/ending)"),
        F.when((F.col("credit_count") == 0) & (F.col("debit_count") == 0) & some, "Credit/debit counts not found in summary"),
    ))
    rows = rows.withColumns({"errors": errors, "warnings": warnings})
    return rows.withColumn("outcome", F.when(~some, "empty").when(F.size("errors") > 0, "rejected").otherwise("accepted")).drop("rows", "first_bad", "bad")
