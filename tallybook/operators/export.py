"""Tables as they are handed out: audit, profit and loss, and the seven extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, csv_safe, merchant_of, month_label, signed, yes_no
from .insights import is_asset_candidate, upper_has

DATE = "MM/dd/yyyy"


def audit(tx: DataFrame, text: Column | None = None) -> DataFrame:
    """18 columns, one row per transaction (tx with statement_dt); text: the description as it may be shown."""
    text = F.col("description") if text is None else text
    flags = {"P&LIncluded": "include_in_pnl", "CPAReview": "cpa_review", "IsTransfer": "is_transfer", "IsOwnerRelated": "is_owner_related", "IsFixedAsset": "is_fixed_asset", "IsLoan": "is_loan"}
    return tx.select(
        "account_id",
        month_label(F.col("statement_dt")).alias("Statement"),
        F.date_format("post_dt", DATE).alias("PostDate"),
        csv_safe(text).alias("Description"),
        signed(F.col("amount"), F.col("is_credit")).cast(MONEY).alias("Amount"),
        F.when(F.col("is_credit"), "Credit").otherwise("Debit").alias("Type"),
        F.col("balance").alias("Balance"),
        csv_safe(F.col("business_category")).alias("BusinessCategory"),
        csv_safe(F.col("tax_category")).alias("TaxCategory"),
        csv_safe(F.col("deductibility")).alias("Deductibility"),
        csv_safe(F.col("review_reason")).alias("ReviewReason"),
        csv_safe(merchant_of(tx)).alias("Merchant"),
        csv_safe(F.col("statement_id")).alias("SourceStatement"),
        *(yes_no(F.col(c)).alias(name) for name, c in flags.items()),
    )


def profit_and_loss(pl: DataFrame, wide: DataFrame) -> DataFrame:
    """account_id, ord, category, type, amount: lines by section and name, then six totals."""
    kinds = (("revenue", "Revenue"), ("direct_costs", "COGS/Direct Cost"), ("operating_expenses", "Operating Expense"))
    lines = [pl.where(F.col("section") == s).select("account_id", F.lit(i).alias("ord"), csv_safe(F.col("category")).alias("category"), F.lit(t).alias("type"), "amount") for i, (s, t) in enumerate(kinds, 1)]
    totals = (("Total Revenue", "Revenue", "total_revenue"), ("Total COGS", "COGS", "total_direct_costs"), ("Gross Profit", "Profit", "gross_profit"), ("Total OpEx", "Expense", "total_operating_expenses"), ("Operating Profit", "Profit", "operating_profit"), ("Net Profit", "Profit", "net_profit"))
    items = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("category"), F.lit(t).alias("type"), F.col(c).alias("amount")) for i, (n, t, c) in enumerate(totals, 11)))
    out = wide.select("account_id", F.explode(items).alias("x")).select("account_id", "x.*")
    for part in lines:
        out = out.unionByName(part)
    return out


def extracts(tx: DataFrame) -> dict[str, DataFrame]:
    """The extracts of transactions by name. Every cell is guarded, amounts as well."""
    date, text, amount = F.date_format("post_dt", DATE).alias("Date"), csv_safe(F.col("description")).alias("Description"), csv_safe(F.col("amount")).alias("Amount")
    category, kind = csv_safe(F.col("business_category")).alias("Category"), F.when(F.col("is_credit"), "Credit").otherwise("Debit").alias("Type")
    credit, pnl = F.col("is_credit"), F.col("include_in_pnl")
    return {
        "revenue_detail": tx.where(credit & pnl).select("account_id", date, text, category, amount),
        "expense_detail": tx.where(~credit & pnl).select("account_id", date, text, category, F.col("tax_category").alias("TaxCategory"), amount, F.col("deductibility").alias("Deductibility"), yes_no(F.col("cpa_review")).alias("CPAReview")),
        "fixed_assets": tx.where(is_asset_candidate()).select("account_id", date, csv_safe(merchant_of(tx)).alias("Vendor"), text, amount),
        "loan_activity": tx.where(F.col("is_loan") | upper_has("LOAN")).select("account_id", date, text, category, amount, kind),
        "owner_activity": tx.where(F.col("is_owner_related") | F.col("business_category").isin("Owner Contribution", "Owner Draw or Distribution")).select("account_id", date, text, category, amount, F.when(credit, "Contribution").otherwise("Draw").alias("Type")),
        "uncategorized": tx.where(F.col("cpa_review")).select("account_id", date, text, amount, kind, csv_safe(F.col("review_reason")).alias("ReviewReason")),
    }


def reconciliation(results: DataFrame) -> DataFrame:
    return results.select("account_id", F.col("label").alias("Statement"), F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("Status"), "parsed_credit_count", "credit_count", "parsed_debit_count", "debit_count", "parsed_credits", "total_credits", "parsed_debits", "total_debits", "beginning_balance", "ending_balance", "calculated_ending", yes_no(F.col("balance_ok")).alias("BalanceOK"), F.array_join("warnings", "; ").alias("Warnings"))


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder of CSV files; an existing one is only replaced if asked for, and a failed write leaves none: to replace one only by a whole one, publish it (sources.publish)."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
