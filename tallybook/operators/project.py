"""Projections of revenue, expenses and cash by scenario and month."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONEY

SCENARIOS = ("conservative", "base", "growth")


@dataclass(frozen=True)
class Options:
    projection_months: int = 12
    lookback_months: int = 6
    monthly_revenue_growth: float = 0.02
    monthly_expense_inflation: float = 0.02
    cogs_percentage: float = 0.0
    tax_reserve_pct: float = 0.25
    min_cash_balance: float = 0.0
    seasonal: dict[str, float] = field(default_factory=dict)
    scenarios: dict[str, float] = field(default_factory=dict)


def lookback(history: DataFrame, months: int) -> DataFrame:
    """account_id, base_revenue, base_expenses: means over the last months that are there."""
    last = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("period")))
    kept = history.withColumn("n", last).where(F.col("n") <= months)
    return kept.groupBy("account_id").agg((F.sum("revenue").cast("double") / F.count("*")).alias("base_revenue"), (F.sum("expenses").cast("double") / F.count("*")).alias("base_expenses"))


def project(history: DataFrame, cash: DataFrame, options: Options, scenarios: tuple[str, ...] = SCENARIOS) -> DataFrame:
    """One row per account, scenario and month (month_idx from 1).

    history: account_id, period (yyyy-MM), revenue, expenses; cash: account_id, starting_cash, start_dt (first day of the
    first projected month). Cash and reserve add up unrounded; every output is rounded half up.
    """
    spark = history.sparkSession
    growth = spark.createDataFrame([(s, float(options.scenarios.get(s, options.monthly_revenue_growth))) for s in scenarios], "scenario string, g double")
    base = lookback(history, options.lookback_months).join(cash, "account_id")
    i = F.col("month_idx")
    rows = base.crossJoin(F.broadcast(growth)).withColumn("month_idx", F.explode(F.sequence(F.lit(1), F.lit(options.projection_months))))
    rows = rows.withColumn("month_dt", F.add_months("start_dt", i - 1))
    factor = F.lit(1.0)
    if options.seasonal:
        table = F.create_map(*(x for k, v in options.seasonal.items() for x in (F.lit(k), F.lit(float(v)))))
        factor = F.coalesce(F.try_element_at(table, F.month("month_dt").cast("string")), F.lit(1.0))
    rows = rows.withColumns({"rev": F.col("base_revenue") * F.pow(1 + F.col("g"), i) * factor, "exp": F.col("base_expenses") * F.pow(F.lit(1 + options.monthly_expense_inflation), i) * factor})
    rows = rows.withColumn("gross", F.col("rev") * (1 - options.cogs_percentage)).withColumn("net", F.col("gross") - F.col("exp"))
    upto = Window.partitionBy("account_id", "scenario").orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"cash": F.col("starting_cash").cast("double") + F.sum("net").over(upto), "reserve": F.sum(F.greatest("net", F.lit(0.0)) * options.tax_reserve_pct).over(upto)})
    two = lambda c, name: F.round(c, 2).cast(MONEY).alias(name)
    low = F.lit(options.min_cash_balance > 0) & (F.col("cash") < options.min_cash_balance)
    return rows.select("account_id", "scenario", "month_idx", "month_dt", two("rev", "revenue"), two("exp", "expenses"), two("gross", "gross_profit"), two("net", "net_income"), two("cash", "ending_cash"), two("reserve", "tax_reserve"), low.alias("low_cash"))


def low_months(projected: DataFrame) -> DataFrame:
    """account_id, scenario, months: the numbers of the months with too little cash, in order."""
    return projected.groupBy("account_id", "scenario").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("low_cash"), F.col("month_idx")))), ",").alias("months"))


def compare(projected: DataFrame, scenarios: tuple[str, ...] = SCENARIOS) -> DataFrame:
    """Net income of each month, a column for each scenario."""
    return projected.groupBy("account_id", "month_idx").pivot("scenario", list(scenarios)).agg(F.sum("net_income"))


def assumptions(options: Options, scenario: str) -> dict[str, str]:
    rate = lambda x: f"{x * 100:.1f}%"
    return {
        "revenue_growth_rate": rate(options.scenarios.get(scenario, options.monthly_revenue_growth)),
        "expense_inflation": rate(options.monthly_expense_inflation),
        "cogs_percentage": rate(options.cogs_percentage),
        "tax_reserve_pct": rate(options.tax_reserve_pct),
        "lookback_months": str(options.lookback_months),
        "scenario": scenario,
        "min_cash_balance": f"${options.min_cash_balance:,.2f}",
    }
