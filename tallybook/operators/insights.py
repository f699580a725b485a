"""Figures and lists of an account's report. tx is the classified ledger, st the statements, db the daily balances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.document_values import DOCUMENTS, STATUS
from ..functions.scalars import MONEY, divided, dollars, iso_week, merchant_of, month_label, percent, ratio, share_label
from .ranks import falling, numbered

# Categories with lists and figures of their own.
VEHICLE = ("Fuel", "Vehicle Expense", "Equipment Maintenance", "Repairs and Maintenance", "Tolls and Scale Fees")
STAFF = ("Payroll", "Payroll Taxes", "Employee Benefits", "Contract Labor", "Subcontractors")
LOANS = ("Loan Proceeds", "Loan Principal Payment", "Loan Interest", "Credit Card Payment")
OWNER = ("Owner Contribution", "Owner Draw or Distribution")
TAXES = ("Tax Payment", "Taxes and Fees", "Payroll Taxes", "Licenses and Permits")
OPEN = ("Uncategorized", "CPA Review Required")
NO_ASSET = (
    "Payroll", "Payroll Taxes", "Bank and Merchant Fees", "Business Insurance", "Rent or Lease", "Software and Cloud Services", "Telephone and Internet",
    "Account Transfer", "Credit Card Payment", "Loan Proceeds", "Loan Principal Payment", "Owner Contribution", "Owner Draw or Distribution",
)
PERSONAL_OUT = ("Deposit", "Payroll", "Transfers", "Bank Fees", "Loan/Credit Payment")


def top(df: DataFrame, k: int, order: list, by: tuple[str, ...] = ("account_id",), tail: tuple[str, ...] = ("month", "sequence")) -> DataFrame:
    """The first k rows of each group, numbered by rank; tail breaks ties as the ledger is ordered."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order, *tail))).where(F.col("rank") <= k)


def _sum(when: Column, what: str = "amount") -> Column:
    return F.sum(F.when(when, F.col(what)).otherwise(0)).cast(MONEY)


def upper_has(word: str) -> Column:
    return F.upper("description").contains(word)



# Figures of an account


def kpis(wide: DataFrame, tx: DataFrame, st: DataFrame, db: DataFrame) -> DataFrame:
    """One row per account; wide is the profit-and-loss summary of the whole period. Averages are per statement."""
    months = st.groupBy("account_id").agg(F.count("*").alias("months"), F.max_by("ending_balance", "statement_dt").alias("last_balance"))
    amounts = tx.groupBy("account_id").agg(F.sum("amount").alias("s"), F.count("*").alias("n"), F.max(F.when(F.col("is_credit"), F.col("amount"))).alias("largest_income"), F.max(F.when(~F.col("is_credit"), F.col("amount"))).alias("largest_expense"))
    balances = st.select("account_id", F.col("ending_balance").alias("b")).unionByName(db.select("account_id", F.col("balance").alias("b"))).groupBy("account_id").agg(F.min("b").alias("min_balance"), F.max("b").alias("max_balance"))
    rows = wide.join(months, "account_id").join(amounts, "account_id").join(balances, "account_id")
    rows = rows.withColumn("total_expenses", (F.col("total_direct_costs") + F.col("total_operating_expenses")).cast(MONEY))
    per = lambda c: F.round(F.col(c).cast("double") / F.col("months"), 2)
    rows = rows.withColumn("avg_expenses", F.col("total_expenses").cast("double") / F.col("months"))
    runway = F.when((F.col("avg_expenses") > 0) & (F.col("last_balance") > 0), F.round(F.col("last_balance").cast("double") / F.col("avg_expenses"), 4))
    return rows.select(
        "account_id", "gross_ratio", "operating_ratio", "net_ratio", ratio(F.col("total_expenses"), F.col("total_revenue")).alias("expense_ratio"), "total_revenue", "total_expenses", F.col("net_profit").alias("net_income"),
        per("total_revenue").alias("avg_monthly_revenue"), per("total_expenses").alias("avg_monthly_expenses"), per("net_profit").alias("avg_monthly_net"), F.round(F.col("s").cast("double") / F.col("n"), 2).alias("avg_transaction"),
        F.coalesce("largest_income", F.lit(0)).alias("largest_income"), F.coalesce("largest_expense", F.lit(0)).alias("largest_expense"), "min_balance", "max_balance", runway.alias("runway_months"),
    )


def classification(tx: DataFrame) -> DataFrame:
    review = F.col("cpa_review")
    found = tx.groupBy("account_id").agg(F.count("*").alias("total"), F.count_if(review).alias("review"), _sum(review & F.col("is_credit")).alias("review_credits"), _sum(review & ~F.col("is_credit")).alias("review_debits"))
    pct = (F.col("total") - F.col("review")) / F.greatest("total", F.lit(1)) * 100
    words = F.when(pct < 50, "Highly Preliminary — majority unclassified").when(pct < 80, "Preliminary — classification incomplete").otherwise("Substantially classified")
    return found.withColumns({"classified_pct": F.round(pct, 4), "pnl_status": words})


def executive(wide: DataFrame, tx: DataFrame, st: DataFrame) -> DataFrame:
    cash = st.groupBy("account_id").agg(F.sum("total_credits").cast(MONEY).alias("cash_in"), F.sum("total_debits").cast(MONEY).alias("cash_out"), F.min_by("beginning_balance", "statement_dt").alias("start_balance"), F.max_by("ending_balance", "statement_dt").alias("end_balance"), F.count("*").alias("statements"))
    counts = tx.groupBy("account_id").agg(F.count("*").alias("transactions"), F.count_if(F.col("cpa_review") | (F.col("business_category") == "Uncategorized")).alias("to_review"))
    rows = cash.join(counts, "account_id").join(wide.select("account_id", "net_profit"), "account_id")
    change = (F.col("end_balance") - F.col("start_balance")).cast(MONEY)
    return rows.select("account_id", "cash_in", "cash_out", "start_balance", "end_balance", change.alias("net_change"), (change - F.col("net_profit")).cast(MONEY).alias("change_less_profit"), "transactions", "to_review", F.greatest(F.lit(0), 12 - F.col("statements")).alias("months_missing"))


BRIDGE = (
    ("Net Profit/Loss", {"net_profit": 1}),
    ("Payment Reversal Credits", {"payment_reversal_credits": 1}),
    ("Payment Reversal Debits", {"payment_reversal_debits": -1}),
    ("Loan Proceeds", {"loan_proceeds": 1}),
    ("Loan Principal Payments", {"loan_principal_payments": -1}),
    ("Owner Contributions", {"owner_contributions": 1}),
    ("Owner Distributions", {"owner_distributions": -1}),
    ("Fixed Asset Purchases", {"fixed_asset_purchases": -1}),
    ("Net Account Transfers", {"account_transfers_credits": 1, "account_transfers_debits": -1, "credit_card_transfers": -1}),
    ("Net Unclassified Activity", {"uncategorized_non_pnl_credits": 1, "uncategorized_non_pnl_debits": -1}),
)


def bridge(wide: DataFrame) -> DataFrame:
    """From net profit to the change of cash, line by line, and the total."""
    value = lambda parts: reduce(Column.__add__, (F.col(c) * s for c, s in parts.items())).cast(MONEY)
    every = [*BRIDGE, ("Net Cash Change", {c: s for _, parts in BRIDGE for c, s in parts.items()})]
    items = F.array(*(F.struct(F.lit(n).alias("ord"), F.lit(name).alias("line"), value(parts).alias("amount")) for n, (name, parts) in enumerate(every, 1)))
    return wide.select("account_id", F.explode(items).alias("x")).select("account_id", "x.ord", "x.line", "x.amount")


def tax_summary(wide: DataFrame, quality: DataFrame, st: DataFrame, reserve_pct: float = 0.25) -> DataFrame:
    """The reserve, or why it is withheld."""
    n = st.groupBy("account_id").agg(F.count("*").alias("statements"))
    rows = wide.join(quality.select("account_id", "total", "review"), "account_id").join(n, "account_id")
    credits = F.col("uncategorized_non_pnl_credits") > F.col("total_revenue") * 2
    debits = F.col("uncategorized_non_pnl_debits") > (F.col("total_direct_costs") + F.col("total_operating_expenses")) * 2
    partial, low = F.col("statements") < 12, F.col("review") / F.greatest("total", F.lit(1)) * 100 > 50
    reasons = F.array_compact(F.array(F.when(partial, "partial-year report"), F.when(low, "classification incomplete"), F.when(credits, "unclassified credits exceed classified revenue"), F.when(debits, "unclassified debits exceed classified expenses")))
    held = partial | low | (F.col("net_profit") <= 0) | credits | debits
    return rows.select("account_id", "total_revenue", "net_profit", F.when(held, 0.0).otherwise(F.round(F.col("net_profit").cast("double") * reserve_pct, 2)).alias("reserve"), F.when(~held, "").when(F.size(reasons) == 0, "net loss — no reserve needed").otherwise(F.array_join(reasons, "; ")).alias("withheld"))


def owner_questions(tx: DataFrame) -> DataFrame:
    r = F.col("cpa_review")
    return tx.groupBy("account_id").agg(F.count_if(r & F.col("is_credit")).alias("deposits"), F.count_if(r & ~F.col("is_credit")).alias("debits"), F.count_if(r & F.col("is_transfer")).alias("transfers"), F.count_if(r & F.col("is_loan")).alias("loans"), F.count_if(is_asset_candidate()).alias("large_purchases"))


def factoring_like(tx: DataFrame) -> DataFrame:
    return tx.groupBy("account_id").agg(F.bool_or(F.col("is_credit") & (upper_has("APEX") | upper_has("FACTOR"))).alias("factoring_like"))


# Groups


def by_tax_category(tx: DataFrame) -> DataFrame:
    kept = tx.where(~F.col("is_credit") & ~F.col("is_transfer") & ~F.col("is_fixed_asset") & ~F.col("is_owner_related") & ~(F.col("is_loan") & ~F.col("include_in_pnl")))
    return kept.groupBy("account_id", "tax_category").agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"), F.array_join(F.array_sort(F.collect_set("business_category")), ", ").alias("categories"), F.bool_or("cpa_review").alias("review"))


def merchant_totals(tx: DataFrame, kept: Column) -> DataFrame:
    return tx.where(kept).groupBy("account_id", merchant_of(tx).alias("merchant")).agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"))


def income_sources(tx: DataFrame, k: int = 20) -> DataFrame:
    return top(merchant_totals(tx, F.col("is_credit") & F.col("include_in_pnl")), k, [F.desc("total")], tail=("merchant",))


def vendors(tx: DataFrame, k: int = 20) -> DataFrame:
    return top(merchant_totals(tx, ~F.col("is_credit") & F.col("include_in_pnl")), k, [F.desc("total")], tail=("merchant",))


def merchant_template(tx: DataFrame) -> DataFrame:
    first = F.struct("month", "sequence")
    rows = tx.groupBy("account_id", merchant_of(tx).alias("merchant")).agg(F.min_by("business_category", first).alias("category"), F.min_by("tax_category", first).alias("tax_category"), F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("total"))
    return numbered(rows, ["account_id"], falling(F.col("total")), [F.desc("total"), "merchant"], "rank")


def top_with_other(lines: DataFrame, k: int, other: str = "Other") -> DataFrame:
    """(account_id, category, amount): the k largest lines, and the sum of the rest."""
    ranked = lines.withColumn("n", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("amount"), "category")))
    return ranked.groupBy("account_id", F.when(F.col("n") <= k, F.col("category")).otherwise(other).alias("category")).agg(F.sum("amount").cast(MONEY).alias("amount"))


def expense_lines(pl: DataFrame, other: bool = False) -> DataFrame:
    """Expense lines above zero; direct costs are marked."""
    kept = pl.where(F.col("section").isin("direct_costs", "operating_expenses", *(["other_expense"] if other else [])) & (F.col("amount") > 0))
    return kept.select("account_id", F.when(F.col("section") == "direct_costs", F.concat(F.lit("[COGS] "), "category")).otherwise(F.col("category")).alias("category"), "amount")


def expense_pie(pl: DataFrame) -> DataFrame:
    return top_with_other(expense_lines(pl, other=True), 10)


def revenue_pie(pl: DataFrame) -> DataFrame:
    kept = pl.where((F.col("section") == "revenue") & (F.col("amount") > 0) | (F.col("section") == "other_income"))
    return top(kept.select("account_id", "category", "amount"), 8, [F.desc("amount")], tail=("category",))


def expense_analysis(pl: DataFrame) -> DataFrame:
    rows = expense_lines(pl)
    of = F.sum("amount").over(Window.partitionBy("account_id"))
    return rows.withColumns({"of_total": percent(F.col("amount"), of), "rank": F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("amount"), "category"))})


def vehicle_costs(tx: DataFrame) -> DataFrame:
    kept = tx.where(F.col("business_category").isin(*VEHICLE) & ~F.col("is_credit"))
    return kept.rollup("account_id", "business_category").agg(F.sum("amount").cast(MONEY).alias("amount")).where("account_id is not null").select("account_id", F.coalesce("business_category", F.lit("Total Vehicle Costs")).alias("category"), "amount")


def cash_by_month(st: DataFrame) -> DataFrame:
    return st.select("account_id", "month", "total_credits", "total_debits", (F.col("total_credits") - F.col("total_debits")).cast(MONEY).alias("net_flow"), "beginning_balance", "ending_balance")


def profit_by_month(wide: DataFrame) -> DataFrame:
    """The series of months: revenue and expenses, gross and net profit, direct costs and operating expenses. wide: by month."""
    expenses = (F.col("total_direct_costs") + F.col("total_operating_expenses")).cast(MONEY)
    return wide.select("account_id", "period", "total_revenue", expenses.alias("total_expenses"), "gross_profit", "net_profit", "total_direct_costs", "total_operating_expenses")


def statement_table(st: DataFrame) -> DataFrame:
    return st.select("account_id", "statement_id", month_label(F.col("statement_dt")).alias("label"), "beginning_balance", "ending_balance", "total_credits", "total_debits", (F.col("ending_balance") - F.col("beginning_balance")).cast(MONEY).alias("net_change"))


def count_totals(st: DataFrame, tx: DataFrame) -> DataFrame:
    printed = st.groupBy("account_id").agg(F.sum("total_credits").cast(MONEY).alias("credits"), F.sum("total_debits").cast(MONEY).alias("debits"), F.sum(F.col("credit_count") + F.col("debit_count")).alias("expected"))
    return printed.join(tx.groupBy("account_id").agg(F.count("*").alias("parsed")), "account_id")


def weekly_balance(db: DataFrame) -> DataFrame:
    return db.groupBy("account_id", iso_week(F.col("bal_dt")).alias("week")).agg(F.round(F.sum("balance").cast("double") / F.count("*"), 4).alias("avg_balance"))


def daily_series(db: DataFrame) -> DataFrame:
    return db.groupBy("account_id", "bal_dt").agg(F.max_by("balance", "statement_id").alias("balance"))


# Lists


def is_asset_candidate(least: int = 500) -> Column:
    return ~F.col("is_credit") & (F.col("amount") >= least) & ~F.col("is_transfer") & ~F.col("is_loan") & ~F.col("is_owner_related") & ~F.col("business_category").isin(*NO_ASSET) & ~upper_has("RETURNED ITEM")


def large_deposits(tx: DataFrame) -> DataFrame:
    return top(tx.where(F.col("is_credit") & (F.col("amount") >= 1000)), 20, [F.desc("amount")])


def deductions(tx: DataFrame) -> DataFrame:
    return top(tx.where(~F.col("is_credit") & F.col("include_in_pnl") & (F.col("amount") > 0)), 100, [F.desc("amount")]).withColumns({"merchant": merchant_of(tx), "review_note": F.when(F.col("cpa_review"), F.substring("review_reason", 1, 30)).otherwise("")})


def purchase_reason() -> Column:
    c = F.col("business_category")
    return (
        F.when(F.col("is_loan") | c.isin("Loan Proceeds", "Loan Principal Payment", "Loan Interest"), "Loan/Financing")
        .when(F.col("is_owner_related") | c.isin(*OWNER), "Owner Activity")
        .when(c.contains("Insurance") | upper_has("PROG"), "Insurance Payment")
        .when(c == "Fuel", "Fuel Purchase")
        .when(c.contains("Rent") | c.contains("Lease"), "Rent/Lease")
        .when(c.isin("Repairs and Maintenance", "Equipment Maintenance", "Vehicle Expense"), "Repair/Maintenance")
        .when(F.col("is_transfer") | c.isin("Account Transfer", "Credit Card Payment"), "Account Transfer")
        .when(c.isin("Payroll", "Payroll Taxes"), "Payroll")
        .when(c == "Bank and Merchant Fees", "Bank Fees")
        .when(c.isin("Software and Cloud Services", "Telephone and Internet"), "Technology/Utilities")
        .otherwise("Unidentified — CPA review")
    )


def fixed_assets(tx: DataFrame) -> DataFrame:
    """The 30 largest candidates that a rule marks as assets, and the 30 largest others with a likely reason."""
    rows = top(tx.where(is_asset_candidate()), 30, [F.desc("amount")], by=("account_id", "is_fixed_asset"))
    return rows.withColumns({"reason": F.when(F.col("is_fixed_asset"), "Review needed").otherwise(purchase_reason()), "note": F.when(F.col("is_fixed_asset"), "Flagged by category rule - verify asset treatment").when(F.col("amount") >= 2500, "CPA review").otherwise("Review")})


def payroll(tx: DataFrame) -> DataFrame:
    rows = top(tx.where(~F.col("is_credit") & F.col("business_category").isin(*STAFF)), 50, [F.desc("amount")])
    return rows.withColumn("note", F.when(F.col("business_category").isin("Contract Labor", "Subcontractors"), "Verify worker classification / 1099 requirement").otherwise(""))


def loan_type() -> Column:
    c = F.col("business_category")
    return F.when(c == "Loan Proceeds", "Proceeds").when(c == "Loan Principal Payment", "Principal").when(c == "Loan Interest", "Interest").when(F.col("is_credit"), "Proceeds").otherwise("Payment")


def loans(tx: DataFrame) -> DataFrame:
    kept = tx.where(F.col("is_loan") | upper_has("LOAN") | F.col("business_category").isin(*LOANS))
    return top(kept, 50, [F.desc("post_dt")]).withColumn("type", loan_type())


def owner_activity(tx: DataFrame) -> DataFrame:
    kept = tx.where(F.col("is_owner_related") | F.col("business_category").isin(*OWNER))
    return top(kept, 50, [F.desc("post_dt")]).withColumn("type", F.when(F.col("is_credit"), "Contribution").otherwise("Draw/Distribution"))


def taxes(tx: DataFrame) -> DataFrame:
    return top(tx.where(F.col("business_category").isin(*TAXES) | upper_has("TAX")), 50, [F.desc("post_dt")])


def to_review(tx: DataFrame) -> DataFrame:
    """All of them, however many; sort on writing by account_id and the date, newest first."""
    kept = tx.where(F.col("cpa_review") | F.col("business_category").isin(*OPEN))
    return kept.withColumn("reason", F.coalesce(F.nullif("review_reason", F.lit("")), F.lit("Uncategorized")))


def newest(tx: DataFrame, k: int | None = 50) -> DataFrame:
    """The newest rows of each statement; k None: all."""
    return tx if k is None else top(tx, k, [F.desc("post_dt")], by=("statement_id",), tail=("sequence",))


def transaction_detail(tx: DataFrame, k: int | None = 50) -> DataFrame:
    """The rows as they are listed for a statement, newest first; k None: all."""
    order = [F.desc("post_dt"), "sequence"]
    rows = numbered(tx, ["statement_id"], -F.unix_date("post_dt"), order, "rank") if k is None else top(tx, k, order[:1], by=("statement_id",), tail=("sequence",))
    amount = F.concat(F.when(F.col("is_credit"), "+").otherwise("-"), dollars(F.col("amount")))
    return rows.select("account_id", "statement_id", "rank", F.date_format("post_dt", "MM/dd/yyyy").alias("date"), F.substring("description", 1, 50).alias("description"), F.substring("business_category", 1, 18).alias("category"), amount.alias("amount"), dollars(F.col("balance")).alias("balance"), F.when(F.col("cpa_review"), "Yes").otherwise("").alias("review"))


# The personal profile: one category per row


def personal_payees(tx: DataFrame, k: int = 15, by: tuple[str, ...] = ("account_id",)) -> DataFrame:
    kept = tx.where(~F.col("is_credit") & ~F.col("category").isin(*PERSONAL_OUT))
    rows = kept.groupBy(*by, merchant_of(tx).alias("merchant")).agg(F.sum("amount").cast(MONEY).alias("total"))
    return top(rows, k, [F.desc("total")], by=by, tail=("merchant",))


def category_shares(tx: DataFrame, by: tuple[str, ...] = ("account_id",)) -> DataFrame:
    rows = tx.where(~F.col("is_credit")).groupBy(*by, "category").agg(F.sum("amount").cast(MONEY).alias("total"))
    return rows.withColumn("share", share_label(F.col("total"), F.sum("total").over(Window.partitionBy(*by))))


def category_pie(tx: DataFrame) -> DataFrame:
    rows = tx.where(~F.col("is_credit")).groupBy("account_id", "category").agg(F.sum("amount").cast(MONEY).alias("total"))
    share = divided(F.col("total").cast("double"), F.sum("total").over(Window.partitionBy("account_id")).cast("double"))
    return rows.withColumn("category", F.when(share >= 0.03, F.col("category")).otherwise("Other (<3% each)")).groupBy("account_id", "category").agg(F.sum("total").cast(MONEY).alias("total"))


def category_cells(tx: DataFrame, k: int = 8) -> DataFrame:
    """account_id, category, period, amount: an account's k largest categories by each of its months, 0 where nothing was paid."""
    sums = tx.where(~F.col("is_credit")).groupBy("account_id", "category", F.date_format("post_dt", "yyyy-MM").alias("period")).agg(F.sum("amount").alias("amount"))
    largest = top(sums.groupBy("account_id", "category").agg(F.sum("amount").alias("total")), k, [F.desc("total")], tail=("category",)).select("account_id", "category")
    grid = largest.join(sums.select("account_id", "period").distinct(), "account_id")
    return grid.join(sums, ["account_id", "category", "period"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)).cast(MONEY))


def category_by_month(tx: DataFrame, months: list[str], k: int = 8) -> DataFrame:
    """category_cells as columns, for given months."""
    wide = category_cells(tx, k).groupBy("account_id", "category").pivot("period", months).agg(F.sum("amount"))
    return wide.select("account_id", "category", *(F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast(MONEY).alias(f"m_{m.replace('-', '_')}") for m in months))


def document_status(accounts: DataFrame, given: DataFrame) -> DataFrame:
    """account_id, document, label, status of every required document; given: account_id, document, status."""
    spark = accounts.sparkSession
    required = spark.createDataFrame(list(DOCUMENTS.items()), "document string, label string")
    shown = spark.createDataFrame(list(STATUS.items()), "status string, shown string")
    rows = accounts.select("account_id").distinct().crossJoin(F.broadcast(required)).join(given, ["account_id", "document"], "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("not-provided"))).join(F.broadcast(shown), "status", "left")
    return rows.select("account_id", "document", "label", F.coalesce("shown", F.concat(F.lit("[ ] "), "status")).alias("status"))


def personal_audit(tx: DataFrame, text: Column | None = None) -> DataFrame:
    """Seven columns per row of the personal ledger (with statement_dt)."""
    text = F.col("description") if text is None else text
    signed_amount = F.when(F.col("is_credit"), F.col("amount")).otherwise(-F.col("amount")).cast(MONEY)
    return tx.select("account_id", month_label(F.col("statement_dt")).alias("Statement"), F.date_format("post_dt", "MM/dd/yyyy").alias("PostDate"), text.alias("Description"), signed_amount.alias("Amount"), F.when(F.col("is_credit"), "Credit").otherwise("Debit").alias("Type"), F.col("balance").alias("Balance"), F.col("category").alias("Category"))
