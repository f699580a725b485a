"""Cash-basis profit and loss: routing, reversal matching, totals, periods."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rule_values import EXPENSE, INCOME
from ..functions.scalars import MONEY, merchant_of, percent, ratio
from ..sources.shared import written

# The sections' categories and the names of what lies outside profit and loss.
OTHER_INCOME = ("Interest Income", "Other Income")
OTHER_EXPENSE = ("Loan Interest",)
DIRECT = ("Fuel", "Freight and Shipping", "Subcontractors", "Direct Labor", "Materials and Supplies", "Equipment Rental", "Tolls and Scale Fees", "Other Direct Costs")
REVENUE = tuple(c for c in INCOME if c not in OTHER_INCOME)
OPERATING = tuple(c for c in EXPENSE if c not in DIRECT + OTHER_EXPENSE)
SECTIONS = ("revenue", "direct_costs", "operating_expenses", "other_income", "other_expense")
BUCKETS = (
    "owner_contributions", "owner_distributions", "loan_proceeds", "loan_principal_payments", "payment_reversal_credits", "payment_reversal_debits",
    "fixed_asset_purchases", "account_transfers_credits", "account_transfers_debits", "credit_card_transfers", "uncategorized_non_pnl_credits", "uncategorized_non_pnl_debits",
)
CREDITS_OUT = ("owner_contributions", "loan_proceeds", "payment_reversal_credits", "account_transfers_credits", "uncategorized_non_pnl_credits")
DEBITS_OUT = tuple(b for b in BUCKETS if b not in CREDITS_OUT)
#: A reversal finds debits of the days before it, up to so many.
DAYS = 90
#: A reversal below the debit has to make up this part of it.
LEAST_RATIO = 0.8


def section_of(category: Column) -> Column:
    """The section of a category; null for one that no table has."""
    names = dict(zip(SECTIONS, (REVENUE, DIRECT, OPERATING, OTHER_INCOME, OTHER_EXPENSE)))
    return reduce(lambda c, x: c.when(category.isin(*x[1]), x[0]), list(names.items())[1:], F.when(category.isin(*REVENUE), "revenue"))


#: What routing goes by; rows that share these only differ by their amounts.
ROUTED_BY = ("is_credit", "business_category", "include_in_pnl", "is_transfer", "is_owner_related", "is_fixed_asset", "is_loan")
#: Sums of many amounts.
SUMS = "decimal(28,2)"


def route(tx: DataFrame, kind: str = MONEY) -> DataFrame:
    """tx with section (one of SECTIONS, or of BUCKETS with an empty category), line and moved (amount with its sign).

    The order of the tests is part of the meaning: transfers, owners, loans outside profit and loss, reversals, fixed
    assets, what else is left out, then the section of the category.
    """
    credit, category = F.col("is_credit"), F.col("business_category")
    either = lambda a, b: F.when(credit, a).otherwise(b)
    bucket = (
        F.when(F.col("is_transfer"), either("account_transfers_credits", F.when(category == "Credit Card Payment", "credit_card_transfers").otherwise("account_transfers_debits")))
        .when(F.col("is_owner_related"), either("owner_contributions", "owner_distributions"))
        .when(F.col("is_loan") & ~F.col("include_in_pnl"), either("loan_proceeds", "loan_principal_payments"))
        .when(category == "Payment Reversal", either("payment_reversal_credits", "payment_reversal_debits"))
        .when(F.col("is_fixed_asset"), "fixed_asset_purchases")
        .when(~F.col("include_in_pnl"), either("uncategorized_non_pnl_credits", "uncategorized_non_pnl_debits"))
    )
    section = section_of(category)
    income = section.isin("revenue", "other_income")
    known = F.when(income == credit, F.col("amount")).otherwise(-F.col("amount"))
    return tx.withColumns({
        "section": F.coalesce(bucket, section, either("revenue", "operating_expenses")),
        "line": F.when(bucket.isNull(), category).otherwise(""),
        "moved": F.when(bucket.isNull() & section.isNotNull(), known).otherwise(F.col("amount")).cast(kind),
    })


class Debits:
    """The debits of a group by amount, to find the best one for a reversal near its own amount.

    The score is the ratio of the smaller amount to the larger, less a little for each day between them. No debit scores
    above its ratio, so the search goes outward from the reversal's amount and ends where ratios are below the best score.
    """

    STEP = 32

    def __init__(self, place: np.ndarray, cents: np.ndarray, day: np.ndarray):
        order = np.argsort(cents, kind="stable")
        self.place, self.cents, self.day = place[order], cents[order].astype(float), day[order]
        self.used = np.zeros(len(order), bool)
        self.looked_at = 0

    def scores(self, near: np.ndarray, cents: float, day: int) -> np.ndarray:
        of, days = self.cents[near], day - self.day[near]
        high = np.maximum(of, cents)
        part = np.where((of == 0) | (cents == 0), 0.0, np.minimum(of, cents) / np.where(high == 0, 1, high))
        ok = ~self.used[near] & (days >= 0) & (days <= DAYS) & ~((cents < of) & (part < LEAST_RATIO))
        self.looked_at += len(near)
        return np.where(ok, part - days / 36500, -np.inf)

    def best(self, cents: float, day: int) -> int | None:
        """Index of the debit of highest score, the first in the list of several; None if none may be undone."""
        n = len(self.cents)
        low = high = int(np.searchsorted(self.cents, cents))
        if n and (cents <= 0 or self.cents[0] <= 0):  # ratios do not fall from here on both ways: all are looked at
            low, high, step = 0, 0, n
        else:
            step = self.STEP
        top, found, first = -np.inf, None, 0
        while low > 0 or high < n:
            near = np.concatenate([np.arange(max(0, low - step), low), np.arange(high, min(n, high + step))])
            score = self.scores(near, cents, day)
            if (most := score.max()) >= top and most > -np.inf:
                i = near[score == most]
                i = i[np.argmin(self.place[i])]
                if most > top or self.place[i] < first:
                    top, found, first = most, int(i), self.place[i]
            low, high, step = max(0, low - step), min(n, high + step), 2 * step
            if high < n and cents / self.cents[high] < LEAST_RATIO:
                high = n
            if max(self.cents[low - 1] / cents if low else -1.0, cents / self.cents[high] if high < n else -1.0) < top:
                break
        return found


def in_turn(debits: list[tuple], reversals: list[tuple], once: bool) -> list[tuple]:
    """(place of reversal, place of debit, score) as Debits finds them, for reversals in the order of days.

    debits: (day, -place, cents), reversals: (place, cents, day), all amounts above zero. Only debits of the last DAYS days are
    held, by amount. Of one amount the last debit of the latest day scores highest, so one of each amount is looked at.
    """
    debits = sorted(debits)
    held: dict[float, deque] = {}
    amounts: list[float] = []
    come = gone = 0
    out = []

    def drop(amount: float) -> None:
        del held[amount], amounts[bisect_left(amounts, amount)]

    for r, cents, today in reversals:
        while come < len(debits) and debits[come][0] <= today:
            d = debits[come]
            come += 1
            if d[2] in held:
                held[d[2]].append(d)
            else:
                held[d[2]] = deque([d])
                insort(amounts, d[2])
        while gone < come and debits[gone][0] < today - DAYS:
            d = debits[gone]
            gone += 1
            same = held.get(d[2])
            if same and same[0] is d:
                same.popleft()
                if not same:
                    drop(d[2])
        top, found = -np.inf, None
        high = bisect_left(amounts, cents)
        for near in (range(high, len(amounts)), range(high - 1, -1, -1)):
            for i in near:
                of = amounts[i]
                part = cents / of if of > cents else of / cents
                if part < top or (of > cents and part < LEAST_RATIO):
                    break
                d = held[of][-1]
                score = part - (today - d[0]) / 36500
                if score > top or (score == top and -d[1] < -found[1]):
                    top, found = score, d
        if found:
            out.append((r, -found[1], top))
            if once:
                held[found[2]].pop()
                if not held[found[2]]:
                    drop(found[2])
    return out


KEY = ["account_id", "period", "merchant"]
#: The columns by which reversals choose in list order.
LISTED = ("statement_dt", "statement_id", "sequence")
PART, STRETCH = [*KEY, "part"], [*KEY, "stretch"]


def _pairs(place: np.ndarray, cents: np.ndarray, day: np.ndarray, back: np.ndarray, once: bool) -> list[tuple]:
    """(place of reversal, place of debit, score) of one group in list order."""
    of, days = cents[back], day[back]
    if len(of) == len(back) or not len(of):
        return []
    if cents.min() > 0 and (days[1:] >= days[:-1]).all():
        amounts = cents.astype(float)
        return in_turn(list(zip(day[~back].tolist(), (-place[~back]).tolist(), amounts[~back].tolist())), list(zip(place[back].tolist(), amounts[back].tolist(), days.tolist())), once)
    debits, out = Debits(place[~back], cents[~back], day[~back]), []
    for r, c, d in zip(place[back], of, days):
        if (i := debits.best(float(c), int(d))) is not None:
            out.append((r, debits.place[i], debits.scores(np.array([i]), float(c), int(d))[0]))
            debits.used[i] = once
    return out


#: What is told of a reversal and its debit, and what profit and loss needs of that.
FOUND = "account_id int, period string, merchant string, reversal_statement string, reversal_sequence int, debit_statement string, debit_sequence int, debit_category string, cents long, score double, debit_dt string"
APPLIED = "account_id int, period string, debit_category string, cents long"


def _found(rows: pd.DataFrame, key: list[str], once: bool, named: bool) -> pd.DataFrame:
    """A row per reversal that finds a debit, of rows sorted by group and list order. once: a debit is found once at most. named: as FOUND, else as APPLIED."""
    same = np.ones(len(rows), bool)
    for c in key:
        x = rows[c].to_numpy()
        same[1:] &= x[1:] == x[:-1]
    same[:1] = False
    edges = [*np.flatnonzero(~same), len(rows)]
    cents, day, back = rows["cents"].to_numpy(), rows["day"].to_numpy(), rows["is_reversal"].to_numpy(bool)
    place, pairs = np.arange(len(rows)), []
    for a, b in zip(edges, edges[1:]):
        pairs += _pairs(place[a:b], cents[a:b], day[a:b], back[a:b], once)
    r, d = (rows.iloc[[p[k] for p in pairs]].reset_index(drop=True) for k in (0, 1))
    applied = np.minimum(r.cents, d.cents)
    if not named:
        return r[["account_id", "period"]].assign(debit_category=d.business_category, cents=applied)
    out = r[[*KEY, "statement_id", "sequence"]].rename(columns={"statement_id": "reversal_statement", "sequence": "reversal_sequence"})
    return out.assign(debit_statement=d.statement_id, debit_sequence=d.sequence, debit_category=d.business_category, cents=applied, score=[p[2] for p in pairs], debit_dt=d.statement_dt)


def _by_group(rows: DataFrame, key: list[str], once: bool, order: tuple[str, ...] = LISTED, named: bool = True) -> DataFrame:
    """Rows are dealt by groups and sorted, so that a task goes through its groups one after the other and holds one at a time."""

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = np.ones(len(batch), bool)
            for c in key:
                last &= batch[c].to_numpy() == batch[c].iloc[-1]
            n = len(batch) - int(last.sum())
            goes_on = not held or all(held[-1][c].iloc[-1] == batch[c].iloc[0] for c in key)
            if n or not goes_on:
                yield _found(pd.concat([*held, batch.iloc[:n]], ignore_index=True), key, once, named)
                held = []
            held.append(batch.iloc[n:])
        if held:
            yield _found(pd.concat(held, ignore_index=True), key, once, named)

    rows = rows.withColumn("statement_dt", F.col("statement_dt").cast("string")) if named else rows
    rows = rows.repartition(*key).sortWithinPartitions(*key, *order)
    rows = rows if named else rows.select(*key, "business_category", "is_reversal", "day", "cents")
    return rows.mapInPandas(run, FOUND if named else APPLIED)


def with_periods(tx: DataFrame, period: Column) -> DataFrame:
    """tx with its period; an array of periods gives a row for each."""
    many = tx.select(period.alias("p")).schema["p"].dataType.typeName() == "array"
    return tx.withColumn("period", F.explode(period) if many else period)


def in_reach(tx: DataFrame, period: Column, order: tuple[str, ...] = LISTED) -> DataFrame:
    """Reversals and the debits that they may undo, with part: what lies in different parts of a group can't meet.

    tx has the columns of order, which are kept. Rows of merchants without a reversal go before anything is worked out for a period. A group is one merchant of one account within one period. Each reversal reaches DAYS back; debits
    in no reach, or well above the largest amount that reaches them, go. Where no debit before a day is in reach of a reversal
    from that day on, a new part begins. Reach and parts come from the days of a group, of which there are as many as the
    calendar has, and go back to the rows by day, so that a group with very many rows is in no task as a whole.
    """
    credit = F.col("is_credit")
    back = credit & (F.col("business_category") == "Payment Reversal") & ~F.col("is_transfer") & ~F.col("is_owner_related") & ~(F.col("is_loan") & ~F.col("include_in_pnl"))
    rows = tx.where(back | (~credit & ~F.col("is_transfer"))).withColumns({"merchant": merchant_of(tx), "is_reversal": back})
    some = written(rows.where("is_reversal").select("account_id", "merchant").distinct(), narrow=True)
    rows = with_periods(rows.join(some, ["account_id", "merchant"], "left_semi"), period)
    rows = rows.select(*KEY, *order, "business_category", "is_reversal", F.unix_date("post_dt").alias("day"), (F.col("amount") * 100).cast("long").alias("cents"))
    back, cents = F.col("is_reversal"), F.col("cents")
    days = rows.groupBy(*KEY, "day").agg(F.max(F.when(back, cents)).alias("most"), F.min(F.when(~back, cents)).alias("least"))
    by = Window.partitionBy(*KEY).orderBy("day")
    can = lambda debit: (F.col("reach") < 0) | (F.col(debit) * LEAST_RATIO <= F.col("reach") * 1.000001 + 1)
    days = days.withColumn("reach", F.max("most").over(by.rangeBetween(0, DAYS))).withColumn("debit", F.col("least").isNotNull() & F.coalesce(can("least"), F.lit(False)))
    days = days.where(F.col("debit") | F.col("most").isNotNull())
    last = F.max(F.when(F.col("debit"), F.col("day"))).over(by.rangeBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("most").isNotNull(), F.col("day"))).over(by.rangeBetween(0, Window.unboundedFollowing))
    days = days.withColumns({"last": last, "following": following})
    new = F.when(F.col("following") - F.col("last") <= DAYS, 0).otherwise(1)
    parts = written(days.select(*KEY, "day", "reach", F.sum(new).over(by).alias("part")))
    return rows.join(parts, [*KEY, "day"]).where(back | can("cents")).drop("reach")


def match_reversals(tx: DataFrame, period: Column) -> DataFrame:
    """One row per reversal that finds a debit: both, the debit's category and the amount applied. No debit is used twice.

    Reversals choose in list order. A part is in one task, which holds one part at a time.
    """
    return _by_group(in_reach(tx, period), PART, True).drop("score", "debit_dt")


def best_candidates(tx: DataFrame, period: Column) -> DataFrame:
    """The debit of highest score for each reversal, whether or not another takes it too.

    Rows meet by stretches of days, so that a reversal only meets debits of its own stretch and the one before, near its own
    amount; the better of both stretches stays.
    """
    stretch = F.floor(F.col("day") / (DAYS + 1))
    rows = in_reach(tx, period).withColumn("stretch", F.explode(F.when(F.col("is_reversal"), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))))
    best = F.max_by(F.struct("debit_statement", "debit_sequence", "debit_category", "cents"), F.struct("score", -F.unix_date(F.to_date("debit_dt")), -F.col("debit_sequence")))
    found = _by_group(rows, STRETCH, False).groupBy(*KEY, "reversal_statement", "reversal_sequence").agg(best.alias("d"))
    return found.select(*KEY, F.col("reversal_statement").alias("r_statement"), F.col("reversal_sequence").alias("r_sequence"), F.col("d.debit_statement").alias("d_statement"), F.col("d.debit_sequence").alias("d_sequence"), F.col("d.debit_category").alias("d_category"), F.col("d.cents").alias("applied_cents"))


#: What lines() reads of a classified ledger that carries its merchants.
READ = ("account_id", "statement_id", "statement_dt", "month", "sequence", "post_dt", "merchant", "amount", "is_credit", "business_category", "include_in_pnl", "is_transfer", "is_owner_related", "is_fixed_asset", "is_loan", "cpa_review")


def lines(tx: DataFrame, period: Column, matched: bool = True, order: tuple[str, ...] = LISTED) -> DataFrame:
    """account_id, period, section, category, amount: every line of profit and loss and every bucket outside it.

    period: one, or an array of them, so that one pass over tx gives several grains, each with its reversals matched within
    its own periods. matched: reversals reduce the lines of the debits they undo; else they all are a bucket. order: the columns
    that give the list order.
    """
    key = ["account_id", "period", "section", "category"]
    # routed after they are summed, as a sum's way is that of each of its rows
    sums = with_periods(tx, period).groupBy("account_id", "period", *ROUTED_BY).agg(F.sum("amount").cast(SUMS).alias("amount"))
    rows = route(sums, SUMS).groupBy("account_id", "period", "section", F.col("line").alias("category")).agg(F.sum("moved").cast(MONEY).alias("amount"))
    if matched:
        found = _by_group(in_reach(tx, period, order), PART, True, order, named=False).withColumns({"s": section_of(F.col("debit_category")), "x": (F.col("cents") / 100).cast(MONEY)}).where(F.col("s").isin("revenue", "direct_costs", "operating_expenses"))
        undone = found.select("account_id", "period", F.col("s").alias("section"), F.col("debit_category").alias("category"), (-F.col("x")).alias("amount"))
        taken = found.select("account_id", "period", F.lit("payment_reversal_credits").alias("section"), F.lit("").alias("category"), (-F.col("x")).alias("amount"))
        rows = rows.unionByName(undone).unionByName(taken).groupBy(*key).agg(F.sum("amount").cast(MONEY).alias("amount"))
    return rows


def summary(pl: DataFrame) -> DataFrame:
    """One row per account and period: section totals, profits, margins, every bucket and what lies outside in all."""
    total = lambda name: F.sum(F.when(F.col("section") == name, F.col("amount")).otherwise(0)).cast(MONEY)
    wide = pl.groupBy("account_id", "period").agg(*(total(s).alias(f"total_{s}") for s in SECTIONS), *(total(b).alias(b) for b in BUCKETS))
    add = lambda names: reduce(Column.__add__, map(F.col, names)).cast(MONEY)
    wide = wide.withColumn("gross_profit", (F.col("total_revenue") - F.col("total_direct_costs")).cast(MONEY))
    wide = wide.withColumn("operating_profit", (F.col("gross_profit") - F.col("total_operating_expenses")).cast(MONEY))
    wide = wide.withColumn("net_profit", (F.col("operating_profit") + F.col("total_other_income") - F.col("total_other_expense")).cast(MONEY))
    for name in ("gross", "operating", "net"):
        wide = wide.withColumns({f"{name}_margin": percent(F.col(f"{name}_profit"), F.col("total_revenue")), f"{name}_ratio": ratio(F.col(f"{name}_profit"), F.col("total_revenue"))})
    return wide.withColumns({"non_pnl_credits": add(CREDITS_OUT), "non_pnl_debits": add(DEBITS_OUT)})


def total_period() -> Column:
    return F.lit("total")


def month_period(d: str = "post_dt") -> Column:
    """yyyy-MM; put together from numbers, which takes a small part of the time of a format."""
    plain = F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month(d).cast("string"), 2, "0"))
    return F.when(F.year(d).between(0, 9999), plain).otherwise(F.date_format(d, "yyyy-MM"))


def fiscal(d: Column, start: int) -> tuple[Column, Column]:
    """Fiscal year and quarter of a date; the year has the number of the calendar year in which it begins."""
    moved = F.add_months(d, 1 - start)
    return F.year(moved), F.quarter(moved)


def quarter_period(start: int = 1, d: str = "post_dt") -> Column:
    year, quarter = fiscal(F.col(d), start)
    return F.concat(F.lit("FY"), F.coalesce(year.cast("string"), F.lit("null")), F.lit(" Q"), F.coalesce(quarter.cast("string"), F.lit("null")))


def statement_lines(pl: DataFrame) -> DataFrame:
    """The lines that are not zero, with their share of revenue as printed."""
    revenue = pl.where("section = 'revenue'").groupBy("account_id", "period").agg(F.sum("amount").alias("revenue"))
    kept = pl.where(F.col("section").isin(*SECTIONS) & (F.col("amount") != 0)).join(revenue, ["account_id", "period"], "left")
    revenue = F.coalesce("revenue", F.lit(0))
    return kept.select("account_id", "period", "section", "category", "amount", percent(F.col("amount"), revenue).alias("of_revenue"))


def month_matrix(pl: DataFrame, months: list[str]) -> DataFrame:
    """Categories by months per section, with the period's total, and a TOTAL line for each section."""
    kept = pl.where(F.col("section").isin(*SECTIONS))
    wide = kept.groupBy("account_id", "section", "category").pivot("period", months).agg(F.sum("amount"))
    wide = wide.unionByName(kept.groupBy("account_id", "section").pivot("period", months).agg(F.sum("amount")).withColumn("category", F.lit("TOTAL")))
    filled = [F.coalesce(F.col(f"`{m}`"), F.lit(0)).cast(MONEY) for m in months]
    return wide.select("account_id", "section", "category", *(x.alias(f"m_{m.replace('-', '_')}") for x, m in zip(filled, months)), reduce(Column.__add__, filled).cast(MONEY).alias("total"))


def month_cells(pl: DataFrame) -> DataFrame:
    """The month matrix as cells, for whatever periods an account has: account_id, section, category, period, amount, total.

    Every category of an account has a cell for each of its periods, 0 where nothing moved, and each section a TOTAL line.
    """
    line = ["account_id", "section", "category"]
    kept = pl.where(F.col("section").isin(*SECTIONS)).select(*line, "period", "amount")
    kept = kept.unionByName(kept.groupBy("account_id", "section", "period").agg(F.sum("amount").alias("amount")).withColumn("category", F.lit("TOTAL")))
    grid = kept.select(*line).distinct().join(kept.select("account_id", "period").distinct(), "account_id")
    cells = grid.join(kept, [*line, "period"], "left").groupBy(*line, "period").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("amount"))
    return cells.withColumn("total", F.sum("amount").over(Window.partitionBy(*line)).cast(MONEY))


def quarter_cells(wide: DataFrame) -> DataFrame:
    """The quarter matrix as cells: account_id, metric, period, amount, total."""
    cell = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("amount")) for m in QUARTER_METRICS))).alias("x")
    return wide.select("account_id", "period", cell).select("account_id", "x.metric", "period", "x.amount").withColumn("total", F.sum("amount").over(Window.partitionBy("account_id", "metric")).cast(MONEY))


QUARTER_METRICS = ("total_revenue", "total_direct_costs", "gross_profit", "total_operating_expenses", "operating_profit", "net_profit")


def quarter_matrix(wide: DataFrame, quarters: list[str]) -> DataFrame:
    """Six metrics by quarters, with a total."""
    long = wide.select("account_id", "period", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in QUARTER_METRICS))).alias("x")).select("account_id", "period", "x.metric", "x.v")
    table = long.groupBy("account_id", "metric").pivot("period", quarters).agg(F.sum("v"))
    filled = [F.coalesce(F.col(f"`{q}`"), F.lit(0)).cast(MONEY) for q in quarters]
    return table.select("account_id", "metric", *(x.alias(q.lower().replace(" ", "_")) for x, q in zip(filled, quarters)), reduce(Column.__add__, filled).cast(MONEY).alias("total"))
