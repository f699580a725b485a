"""Periods and the filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, month_label, signed
from .pnl import fiscal


def of_year(statements: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Statements of a year and month. With a month alone, of the latest year that each account has for it."""
    kept = statements if month is None else statements.where(F.month("statement_dt") == month)
    if year is not None:
        return kept.where(F.year("statement_dt") == year)
    if month is None:
        return kept
    last = kept.groupBy("account_id").agg(F.max(F.year("statement_dt")).alias("y"))
    return kept.join(last, "account_id").where(F.year("statement_dt") == F.col("y")).drop("y")


def quarter_range(year: Column, quarter: Column, start: int = 1) -> tuple[Column, Column]:
    """First and last day of a fiscal quarter."""
    first = F.add_months(F.make_date(year, F.lit(start), F.lit(1)), 3 * (quarter - 1))
    return first, F.last_day(F.add_months(first, F.lit(2)))


def quarter_months(quarter: Column, start: int = 1) -> Column:
    """The three calendar months of a fiscal quarter, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.lit(start - 1) + 3 * (quarter - 1) + i) % 12 + 1)


def of_quarter(statements: DataFrame, quarter: int, year: int | None = None, start: int = 1) -> DataFrame:
    """Statements whose date lies in a fiscal quarter; without a year, the latest fiscal year of each account."""
    fiscal_year, _ = fiscal(F.col("statement_dt"), start)
    rows = statements.withColumn("fy", fiscal_year)
    if year is None:
        rows = rows.join(rows.groupBy("account_id").agg(F.max("fy").alias("want")), "account_id")
    else:
        rows = rows.withColumn("want", F.lit(year))
    first, last = quarter_range(F.col("want"), F.lit(quarter), start)
    return rows.where(F.col("statement_dt").between(first, last)).drop("fy", "want")


def between(statements: DataFrame, tx: DataFrame, daily: DataFrame, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions of a date range, and the statements and daily balances rebuilt for them; empty statements go."""
    inside = lambda c: (F.lit(True) if start is None else F.col(c) >= F.lit(start).cast("date")) & (F.lit(True) if end is None else F.col(c) <= F.lit(end).cast("date"))
    rows = tx.where(inside("post_dt"))
    at, credit = F.struct("post_dt", "sequence"), F.col("is_credit")
    built = rows.groupBy("account_id", "statement_id").agg(
        F.sum(F.when(credit, F.col("amount")).otherwise(0)).cast(MONEY).alias("total_credits"),
        F.sum(F.when(~credit, F.col("amount")).otherwise(0)).cast(MONEY).alias("total_debits"),
        F.count_if(credit).alias("credit_count"),
        F.count_if(~credit).alias("debit_count"),
        F.min_by(F.col("balance") - signed(F.col("amount"), credit), at).cast(MONEY).alias("beginning_balance"),
        F.max_by("balance", at).alias("ending_balance"),
    )
    rebuilt = built.join(statements.select("statement_id", "statement_dt"), "statement_id")
    return rebuilt, rows, daily.where(inside("bal_dt")).join(built.select("statement_id"), "statement_id", "left_semi")


def calendar(spark: SparkSession, year: int) -> DataFrame:
    """Twelve months and four quarters of a year: kind, label, first_dt, last_dt, months."""
    months = spark.range(1, 13).select(F.lit("month").alias("kind"), F.make_date(F.lit(year), F.col("id").cast("int"), F.lit(1)).alias("first_dt"), F.lit(1).alias("months"))
    quarters = spark.range(0, 4).select(F.lit("quarter").alias("kind"), F.make_date(F.lit(year), (F.col("id") * 3 + 1).cast("int"), F.lit(1)).alias("first_dt"), F.lit(3).alias("months"))
    label = F.when(F.col("kind") == "month", month_label(F.col("first_dt"))).otherwise(F.format_string("Q%d %d", F.quarter("first_dt"), F.year("first_dt")))
    return months.unionByName(quarters).select("kind", label.alias("label"), "first_dt", F.last_day(F.add_months("first_dt", F.col("months") - 1)).alias("last_dt"), "months")


def search(tx: DataFrame, text: str, rows: int = 500) -> DataFrame:
    """The first rows whose description holds text in any case, per account, with the number of all that do."""
    found = tx.where(F.lower("description").contains(text.lower()))
    of = Window.partitionBy("account_id")
    total = found.groupBy("account_id").agg(F.count("*").alias("matches"))
    top = found.withColumn("n", F.row_number().over(of.orderBy("post_dt", "statement_id", "sequence"))).where(F.col("n") <= rows)
    return top.join(total, "account_id")


def gates(reconciled: DataFrame, quality: DataFrame, revenue: DataFrame, allow_mismatch: bool = False, strict: bool = False, allow_review: bool = False) -> DataFrame:
    """account_id, may_report, projections: what an account's reports are held back for.

    reconciled: account_id, all_passed; quality: account_id, review_count, statements; revenue: account_id, total_revenue.
    """
    rows = reconciled.join(quality, "account_id").join(revenue, "account_id", "left")
    blocked = ~F.col("all_passed") & F.lit(not allow_mismatch) | (F.col("review_count") > 0) & F.lit(strict and not allow_review)
    held = F.when(F.coalesce("total_revenue", F.lit(0)) == 0, "no revenue").when(F.col("review_count") > 5 * F.col("statements"), "too much to review").otherwise("")
    return rows.select("account_id", (~blocked).alias("may_report"), held.alias("projections_held"))
