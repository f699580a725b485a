"""A ledger, statements and daily balances of many accounts, derived from the star-schema tables.

An account is a nation; a transaction is a line item. Statements are the months of an account with their printed totals;
some months are left out and some totals are wrong, so that the checks on them have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, signed

#: What is printed after the part's name, by part number.
PHRASES = (
    "PILOT TRAVEL CENTER", "PROGRESSIVE INS", "WEB XFER SAVINGS", "OWNER DRAW", "APEX CAPITAL FUNDING", "TRUCK PURCHASE", "PAYROLL", "MCDONALD",
    "STAPLES", "CAPITAL ONE", "MOTEL", "ACME CO", "TAX PAYMENT", "RETURNED ITEM INSUFFICIENT FUNDS", "DIRECT LABOR", "REFUND",
    "INVOICE", "FREIGHT", "OWNER CONTRIBUTION", "LOAN PROCEEDS", "INTEREST PAID", "CONTRACT PAY", "EQUIPMENT RENTAL", "SHOP12",
)
CARD = "XX1234 DEBIT CARD 01/05 13:02 "
#: Rules of the derived accounts, before the default ones.
CUSTOM = (
    {"pattern": r"\bGIZMO\b", "category": "Payment Reversal", "tax_category": "non-pl", "direction": "credit", "priority": 1},
    {"pattern": r"\bWIDGET\b", "category": "Materials and Supplies", "tax_category": "Materials & Supplies", "deductibility": "likely-deductible", "direction": "debit", "priority": 2},
    {"pattern": r"\bROD\b", "category": "Loan Interest", "tax_category": "Interest", "direction": "debit", "priority": 3},
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """description of every part: all that the ledger can have."""
    part = table(spark, sf_dir, "part")
    return part.select(described("p_partkey", "p_name").alias("description")).distinct()


def described(number: str, name: str, upper: bool = False) -> Column:
    """What is printed of a part; upper: the name is in capital letters already."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col(number) % len(PHRASES) + 1).cast("int"))
    return F.concat(F.lit(CARD), F.col(name) if upper else F.upper(name), F.lit(" "), phrase)


ORDER = ("post_dt", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, month, l_linestatus, p_name (in capital letters, made for the parts and not for the lines) and the columns of ORDER: few and short ones, as every row is shuffled with them.

    Orders find their customers first, so that the lines, of which there are several for each order, meet them all at once.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_linestatus", F.to_date("l_shipdate").alias("post_dt"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("account_id"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("p_name"))
    accounts = orders.join(customer, "o_custkey").drop("o_custkey")
    return line.join(part, "l_partkey").join(accounts, "l_orderkey").withColumn("month", F.trunc("post_dt", "MM"))


def _entry(*more: str) -> list:
    return [
        "account_id",
        F.concat_ws("-", F.col("account_id").cast("string"), (F.year("month") * 100 + F.month("month")).cast("string")).alias("statement_id"),
        "month",
        *more,
        "post_dt",
        described("l_partkey", "p_name", upper=True).alias("description"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        (F.col("l_linestatus") == "O").alias("is_credit"),
    ]


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, statement_id, month, sequence (in the statement), post_dt, description, amount, is_credit."""
    place = F.row_number().over(Window.partitionBy("account_id", "month").orderBy(*ORDER))
    # what is printed is made of the numbered rows, so that the numbering does not shuffle it
    return _joined(spark, sf_dir).withColumn("sequence", place).select(*_entry("sequence"))


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_ledger() with the columns of ORDER in place of sequence: their order is that of the numbers, and costs no shuffle."""
    return _joined(spark, sf_dir).select(*_entry(), *ORDER[1:])


def month_totals(ledger: DataFrame) -> DataFrame:
    """One row per account and month: totals, counts, and balances before and after it by a sum over the months."""
    credit = F.col("is_credit")
    sums = ledger.groupBy("account_id", "statement_id", "month").agg(
        F.sum(F.when(credit, F.col("amount")).otherwise(0)).cast(MONEY).alias("total_credits"),
        F.sum(F.when(~credit, F.col("amount")).otherwise(0)).cast(MONEY).alias("total_debits"),
        F.count_if(credit).alias("credit_count"),
        F.count_if(~credit).alias("debit_count"),
    )
    upto = Window.partitionBy("account_id").orderBy("month")
    net = F.col("total_credits") - F.col("total_debits")
    return sums.withColumn("true_ending", F.sum(net).over(upto).cast(MONEY)).withColumn("beginning_balance", (F.col("true_ending") - net).cast(MONEY))


def statements(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    """account_id, statement_id, month, statement_dt, balances, printed totals and counts.

    Months whose number plus the account's leaves no remainder by 17 are missing; accounts divisible by 7 print one
    credit too many, accounts divisible by 11 an ending balance that is 5 too high.
    """
    sums = month_totals(raw_ledger(spark, sf_dir) if ledger is None else ledger)
    number = F.year("month") * 12 + F.month("month") + F.col("account_id")
    return sums.where(number % 17 != 0).select(
        "account_id",
        "statement_id",
        "month",
        F.last_day("month").alias("statement_dt"),
        "beginning_balance",
        (F.col("true_ending") + F.when(F.col("account_id") % 11 == 0, 5).otherwise(0)).cast(MONEY).alias("ending_balance"),
        "total_credits",
        "total_debits",
        (F.col("credit_count") + F.when(F.col("account_id") % 7 == 0, 1).otherwise(0)).alias("credit_count"),
        "debit_count",
    )


def transactions(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's rows with the balance after each. Months without a statement have their rows all the same.

    The months, a row for each statement, are what is hashed, so that the rows stay in their order.
    """
    ledger = raw_ledger(spark, sf_dir) if ledger is None else ledger
    months = month_totals(ledger).select("statement_id", "beginning_balance")
    inside = Window.partitionBy("statement_id").orderBy("sequence")
    moved = F.sum(signed(F.col("amount"), F.col("is_credit"))).over(inside)
    return ledger.withColumn("moved", moved).join(months.hint("shuffle_hash"), "statement_id").withColumn("balance", (F.col("beginning_balance") + F.col("moved")).cast(MONEY)).drop("moved", "beginning_balance")


def daily_balances(tx: DataFrame) -> DataFrame:
    """account_id, statement_id, bal_dt, balance: the last balance of each day."""
    return tx.groupBy("account_id", "statement_id", F.col("post_dt").alias("bal_dt")).agg(F.max_by("balance", "sequence").alias("balance"))


LEDGER_SQL = f"""
raw AS (
  SELECT c_nationkey AS account_id, date_trunc('month', l_shipdate)::DATE AS month, l_shipdate::DATE AS post_dt,
         row_number() OVER (PARTITION BY c_nationkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sequence,
         '{CARD}' || upper(p_name) || ' ' || (['{"', '".join(PHRASES)}'])[l_partkey % {len(PHRASES)} + 1] AS description,
         l_extendedprice::DECIMAL(18,2) AS amount, l_linestatus = 'O' AS is_credit
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), raw2 AS (
  SELECT *, account_id || '-' || strftime(month, '%Y%m') AS statement_id, (year(month) * 12 + month(month) + account_id) % 17 = 0 AS missing FROM raw
), sums AS (
  SELECT account_id, statement_id, month, missing, sum(CASE WHEN is_credit THEN amount ELSE 0 END) AS total_credits, sum(CASE WHEN is_credit THEN 0 ELSE amount END) AS total_debits,
         count(*) FILTER (is_credit) AS credit_count, count(*) FILTER (NOT is_credit) AS debit_count
  FROM raw2 GROUP BY ALL
), months AS (
  SELECT *, sum(total_credits - total_debits) OVER (PARTITION BY account_id ORDER BY month) AS true_ending FROM sums
), st AS (
  SELECT account_id, statement_id, month, last_day(month) AS statement_dt, true_ending - total_credits + total_debits AS beginning_balance,
         true_ending + CASE WHEN account_id % 11 = 0 THEN 5 ELSE 0 END AS ending_balance, total_credits, total_debits,
         credit_count + CASE WHEN account_id % 7 = 0 THEN 1 ELSE 0 END AS credit_count, debit_count
  FROM months WHERE NOT missing
), led AS (
  SELECT r.account_id, r.statement_id, r.month, r.sequence, r.post_dt, r.description, r.amount, r.is_credit,
         m.true_ending - m.total_credits + m.total_debits + sum(CASE WHEN is_credit THEN amount ELSE -amount END) OVER (PARTITION BY r.statement_id ORDER BY r.sequence) AS balance
  FROM raw2 r JOIN months m USING (statement_id)
), db AS (
  SELECT account_id, statement_id, post_dt AS bal_dt, arg_max(balance, sequence) AS balance FROM led GROUP BY ALL
)"""
