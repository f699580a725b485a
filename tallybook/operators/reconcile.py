"""Checks of statements against their transactions and against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, month_label, yes_no

TOLERANCE = "0.01"


def parsed(tx: DataFrame) -> DataFrame:
    credit = F.col("is_credit")
    return tx.groupBy("statement_id").agg(
        F.sum(F.when(credit, F.col("amount")).otherwise(0)).cast(MONEY).alias("parsed_credits"),
        F.sum(F.when(~credit, F.col("amount")).otherwise(0)).cast(MONEY).alias("parsed_debits"),
        F.count_if(credit).alias("parsed_credit_count"),
        F.count_if(~credit).alias("parsed_debit_count"),
    )


def _plain(c: str):
    return F.col(c).cast("string")


def reconcile(statements: DataFrame, tx: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """One row per statement: parsed and printed figures, what fits, and the warnings in words."""
    rows = statements.join(parsed(tx), "statement_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast(MONEY if c.endswith("s") else "long") for c in ("parsed_credits", "parsed_debits", "parsed_credit_count", "parsed_debit_count")})
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(tolerance).cast(MONEY)
    rows = rows.withColumn("calculated_ending", (F.col("beginning_balance") + F.col("parsed_credits") - F.col("parsed_debits")).cast(MONEY))
    rows = rows.withColumns({
        "balance_ok": near("calculated_ending", "ending_balance"),
        "credits_ok": near("parsed_credits", "total_credits") & (F.col("parsed_credit_count") == F.col("credit_count")),
        "debits_ok": near("parsed_debits", "total_debits") & (F.col("parsed_debit_count") == F.col("debit_count")),
        "label": month_label(F.col("statement_dt")),
    })
    side = lambda name, one: F.concat(F.lit(f"{name} mismatch: parsed "), _plain(f"parsed_{one}_count"), F.lit("/"), _plain(f"parsed_{one}s"), F.lit(" vs expected "), _plain(f"{one}_count"), F.lit("/"), _plain(f"total_{one}s"))
    warnings = F.array_compact(F.array(
        F.when(~F.col("credits_ok"), side("Credit", "credit")),
        F.when(~F.col("debits_ok"), side("Debit", "debit")),
        F.when(~F.col("balance_ok"), F.concat(F.lit("Balance mismatch: calculated="), _plain("calculated_ending"), F.lit(" vs ending="), _plain("ending_balance"))),
    ))
    return rows.withColumns({"passed": F.col("balance_ok") & F.col("credits_ok") & F.col("debits_ok"), "warnings": warnings})


def _pairs(statements: DataFrame) -> DataFrame:
    by = Window.partitionBy("account_id").orderBy("statement_dt", "statement_id")
    return statements.select("account_id", "statement_id", "statement_dt", "beginning_balance", F.lag("ending_balance").over(by).alias("prev_ending"), F.lag("statement_dt").over(by).alias("prev_dt")).where("prev_dt is not null")


def continuity(statements: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """account_id, label, prev_ending, beginning_balance, gap where a statement does not begin as the one before ended."""
    gap = (F.col("beginning_balance") - F.col("prev_ending")).cast(MONEY)
    label = F.concat(F.lit("Continuity: "), month_label(F.col("prev_dt")), F.lit(" -> "), month_label(F.col("statement_dt")))
    warning = F.concat(F.lit("Balance discontinuity: prev ending="), _plain("prev_ending"), F.lit(", curr beginning="), _plain("beginning_balance"), F.lit(", gap="), gap.cast("string"))
    return _pairs(statements).where(F.abs(gap) > F.lit(tolerance).cast(MONEY)).select("account_id", label.alias("label"), "prev_ending", "beginning_balance", gap.alias("gap"), warning.alias("warning"))


def missing_months(statements: DataFrame) -> DataFrame:
    """account_id, label, prev_dt, statement_dt where the next statement is not of the next month."""
    step = F.months_between(F.trunc("statement_dt", "MM"), F.trunc("prev_dt", "MM"))
    label = F.concat(F.lit("Gap: "), F.date_format("prev_dt", "MMM yyyy"), F.lit(" -> "), F.date_format("statement_dt", "MMM yyyy"))
    return _pairs(statements).where(step != 1).select("account_id", label.alias("label"), "prev_dt", "statement_dt")


def status(results: DataFrame, breaks: DataFrame, allow_mismatch: bool = False) -> DataFrame:
    """account_id, results, passed_count, all_passed, forced, status (PASSED, FORCED, FAILED); breaks are from continuity."""
    every = results.select("account_id", "passed").unionByName(breaks.select("account_id", F.lit(False).alias("passed")))
    found = every.groupBy("account_id").agg(F.count("*").alias("results"), F.count_if("passed").alias("passed_count"), F.bool_and("passed").alias("all_passed"))
    forced = ~F.col("all_passed") & F.lit(allow_mismatch)
    return found.withColumns({"forced": forced, "status": F.when(F.col("all_passed"), "PASSED").when(forced, "FORCED").otherwise("FAILED")})


def statement_status(statements: DataFrame, results: DataFrame) -> DataFrame:
    found = results.select("statement_id", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"))
    return statements.join(found, "statement_id", "left").select("account_id", "statement_id", F.coalesce("status", F.lit("N/A")).alias("status"))


def detail(results: DataFrame, breaks: DataFrame, gaps: DataFrame) -> DataFrame:
    """account_id, item, status, detail: one row per warning, one per statement that passes, breaks and gaps."""
    said = F.when(F.col("passed"), F.array(F.lit("All counts and balances match"))).otherwise(F.col("warnings"))
    one = results.select("account_id", F.col("label").alias("item"), F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"), F.explode(said).alias("detail"))
    two = breaks.select("account_id", F.col("label").alias("item"), F.lit("FAIL").alias("status"), F.col("warning").alias("detail"))
    three = gaps.select("account_id", F.col("label").alias("item"), F.lit("GAP").alias("status"), F.lit("Missing statement(s) detected").alias("detail"))
    return one.unionByName(two).unionByName(three)


def data_quality(results: DataFrame) -> DataFrame:
    """Status and Yes/No for the counts and the balance of a statement, with the warnings cut to 80 characters."""
    word = yes_no
    return results.select("account_id", "statement_id", "label", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"), word(F.col("parsed_credit_count") == F.col("credit_count")).alias("credits"), word(F.col("parsed_debit_count") == F.col("debit_count")).alias("debits"), word(F.col("balance_ok")).alias("balance"), F.substring(F.array_join("warnings", "; "), 1, 80).alias("warnings"))


def reconcile_personal(statements: DataFrame, tx: DataFrame) -> DataFrame:
    """Exact equality of the number of all rows, credits and debits; balances are not tested."""
    rows = statements.join(parsed(tx), "statement_id", "left")
    n = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    same = (n("parsed_credit_count", "parsed_debit_count") == F.col("credit_count") + F.col("debit_count")) & (F.coalesce("parsed_credits", F.lit(0)) == F.col("total_credits")) & (F.coalesce("parsed_debits", F.lit(0)) == F.col("total_debits"))
    return rows.select("account_id", "statement_id", n("parsed_credit_count", "parsed_debit_count").alias("parsed_count"), (F.col("credit_count") + F.col("debit_count")).alias("expected_count"), same.alias("passed"))
