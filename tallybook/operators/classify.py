"""Ordered pattern rules: the first rule whose direction fits and whose pattern is found decides."""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import required
from ..functions.personal_values import BANK_FEES_FIRST, PERSONAL, SUBSCRIPTIONS_FIRST
from ..functions.rule_values import EXPENSE, INCOME, NON_PNL, TAX_CATEGORY
from ..functions.scalars import glob, merchant
from ..sources.shared import written

# Categories with a meaning of their own.
TRANSFERS = ("Account Transfer", "Credit Card Payment")
LOANS = ("Loan Proceeds", "Loan Principal Payment", "Loan Interest")
OWNERS = ("Owner Contribution", "Owner Draw or Distribution")
ASSETS = ("Fixed Asset Purchase",)
CREDIT_ONLY = ("Loan Proceeds", "Owner Contribution")
DEBIT_ONLY = ("Credit Card Payment", "Loan Principal Payment", "Payment Reversal", "Owner Draw or Distribution", "Fixed Asset Purchase", "Tax Payment", "Refund", "Reimbursement")
IN_PNL = ("Loan Interest", "Refund", "Reimbursement")
REVIEWED = ("Uncategorized", "CPA Review Required")
DEDUCTIBILITY = ("likely-deductible", "possibly-deductible", "not-normally-deductible", "unknown", "not-applicable")


@dataclass(frozen=True)
class Rule:
    pattern: str
    category: str
    tax_category: str = "CPA Review"
    deductibility: str = "unknown"
    is_income: bool = False
    include_in_pnl: bool = True
    is_transfer: bool = False
    is_owner_related: bool = False
    is_fixed_asset: bool = False
    is_loan: bool = False
    direction: str = "either"
    priority: int = 50


def default_rules() -> list[Rule]:
    """The rules of the fixed tables: what stays out of profit and loss first, then expenses, then income."""
    rules: list[Rule] = []
    for category, patterns in NON_PNL.items():
        direction = "credit" if category in CREDIT_ONLY else "debit" if category in DEBIT_ONLY else "either"
        flags = dict(is_transfer=category in TRANSFERS, is_loan=category in LOANS, is_owner_related=category in OWNERS, is_fixed_asset=category in ASSETS)
        rules += [Rule(p, category, "non-pl", "not-applicable", include_in_pnl=category in IN_PNL, direction=direction, **flags) for p in patterns]
    for category, patterns in EXPENSE.items():
        how = "possibly-deductible" if category == "Meals" else "likely-deductible"
        rules += [Rule(p, category, TAX_CATEGORY.get(category, "Other Expense"), how, direction="debit") for p in patterns]
    for category, patterns in INCOME.items():
        rules += [Rule(p, category, "Gross Receipts", "not-applicable", is_income=True, direction="credit") for p in patterns]
    return [Rule(**{**vars(r), "priority": i}) for i, r in enumerate(rules, 1)]


def configured_rules(rows: list[dict]) -> list[Rule]:
    """Rules from options: what is left out follows from the names. A pattern that does not compile is an error."""
    out = []
    for row in rows:
        re.compile(row["pattern"])
        category, tax = row["category"], row.get("tax_category") or "CPA Review"
        given = {
            "include_in_pnl": tax != "non-pl" and category not in NON_PNL_NAMES,
            "is_transfer": category in TRANSFERS,
            "is_owner_related": category in OWNERS,
            "is_fixed_asset": category in ASSETS,
            "is_loan": category in LOANS,
            "priority": 0,
        }
        out.append(Rule(**{**given, **row, "tax_category": tax}))
    return out


# Categories that stay out of profit and loss when a configured rule does not say.
NON_PNL_NAMES = (
    "Account Transfer", "Credit Card Payment", "Loan Proceeds", "Loan Principal Payment", "Owner Contribution", "Owner Draw or Distribution",
    "Fixed Asset Purchase", "Tax Payment", "Refund", "Reimbursement", "Opening Balance", "Uncategorized", "CPA Review Required",
)


def option_issues(options: dict) -> list[str]:
    """What is wrong with options, in words; empty if nothing is."""
    out = []
    if not 1 <= options.get("fiscal_year_start", 1) <= 12:
        out.append("fiscal_year_start must be 1 to 12")
    out += [f"{k} must be above 0" for k in ("projection_months", "lookback_months") if options.get(k, 1) <= 0]
    if not 0 <= options.get("tax_reserve_pct", 0) <= 1:
        out.append("tax_reserve_pct must be 0 to 1")
    for i, rule in enumerate(options.get("rules", [])):
        if rule.get("direction", "either") not in ("credit", "debit", "either"):
            out.append(f"rule {i}: unknown direction")
        if rule.get("deductibility", "unknown") not in DEDUCTIBILITY:
            out.append(f"rule {i}: unknown deductibility")
    out += ["an alias is empty" for k in options.get("aliases", {}) if not k.strip()]
    return out


def rule_issues(rules: DataFrame) -> DataFrame:
    """rule_id, issue for each thing that is wrong with rows of rules (rule_id, pattern, direction, deductibility)."""
    wrong = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("pattern", F.lit(""))) == "", "no pattern"),
        F.when(~F.coalesce("direction", F.lit("either")).isin("credit", "debit", "either"), F.concat(F.lit("unknown direction: "), "direction")),
        F.when(~F.coalesce("deductibility", F.lit("unknown")).isin(*DEDUCTIBILITY), F.concat(F.lit("unknown deductibility: "), "deductibility")),
    ))
    return rules.select("rule_id", F.explode(wrong).alias("issue"))


def ordered(custom: list[Rule] = (), defaults: list[Rule] | None = None) -> list[Rule]:
    """All custom rules before all default ones, each by priority; rules of one priority stay in order."""
    by = lambda r: r.priority
    return [*sorted(custom, key=by), *sorted(default_rules() if defaults is None else defaults, key=by)]


#: What holds for a row that no rule knows.
NO_RULE = Rule("", "Uncategorized", include_in_pnl=False)


def rules_frame(spark: SparkSession, rules: list[Rule], first: int = 1) -> DataFrame:
    """rule_id (from first on, in the order in which rules are tried) and the attributes."""
    schema = "rule_id int, pattern string, category string, tax_category string, deductibility string, is_income boolean, include_in_pnl boolean, is_transfer boolean, is_owner_related boolean, is_fixed_asset boolean, is_loan boolean, direction string, priority int"
    return spark.createDataFrame([(i, *astuple(r)) for i, r in enumerate(rules, first)], schema)


def _upper_pattern(pattern: str) -> str:
    """The pattern for a text in upper case: only what holds small letters outside escapes has to ignore case."""
    return f"(?i){pattern}" if re.search(r"[a-z]", re.sub(r"\\.|\(\?[:!=<]*", "", pattern)) else pattern


def may_match(upper: Column, pattern: str) -> Column | None:
    """Whether a text in capital letters holds what the pattern can't match without; None if there is no such literal.

    A search for a few bytes takes a small part of the time that a pattern takes, so only texts that pass are tried.
    """
    held = [upper.contains(x) for x in required(pattern)]
    return reduce(Column.__or__, held) if held else None


def _fits(upper: Column, text: Column, pattern: str, tried: str) -> Column:
    may = may_match(upper, pattern)
    return text.rlike(tried) if may is None else may & text.rlike(tried)


def rule_of(text: Column, rules: list[Rule], direction: str) -> Column:
    """rule_id of the first rule of a direction that is found in a text in capital letters, 0 if none is."""
    own = [(i, r) for i, r in enumerate(rules, 1) if r.direction in ("either", direction)]
    return reduce(lambda c, x: c.when(_fits(text, text, x[1].pattern, _upper_pattern(x[1].pattern)), x[0]), own, F.when(F.lit(False), 0)).otherwise(0)


def first_rule(text: Column, is_credit: Column, rules: list[Rule]) -> Column:
    """rule_id of the first rule that fits, 0 if none does. The direction is settled first, so a row only tries its own."""
    return F.when(is_credit, rule_of(text, rules, "credit")).otherwise(rule_of(text, rules, "debit"))


def with_aliases(description: Column, aliases: dict[str, str]) -> Column:
    """The text that rules see: of the first alias that fits, what it stands for."""
    out = None
    for pattern, name in aliases.items():
        fits = glob(F.upper(description), pattern.upper())
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return description if out is None else out.otherwise(description)


def dictionary(descriptions: DataFrame, rules: list[Rule], aliases: dict[str, str] | None = None, own: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per distinct description, written: text_id, description, merchant, credit_rule, debit_rule (0: none), personal.

    Whatever is worked out from a description alone is worked out here once, however many rows have it.
    """
    seen = F.upper(with_aliases(F.col("description"), aliases or {}))
    return written(
        descriptions.select("description").distinct().select(
            F.monotonically_increasing_id().alias("text_id"), "description", merchant(F.col("description")).alias("merchant"),
            rule_of(seen, rules, "credit").alias("credit_rule"), rule_of(seen, rules, "debit").alias("debit_rule"), personal_category(F.col("description"), own).alias("personal"),
        )
    )


def with_dictionary(tx: DataFrame, words: DataFrame) -> DataFrame:
    """tx with text_id, merchant, rule_id (0: none) and category (of the personal profile) of its descriptions; null ones have none."""
    found = tx.drop("text_id", "merchant", "rule_id", "category").join(words, "description", "left")
    rule = F.coalesce(F.when(F.col("is_credit"), F.col("credit_rule")).otherwise(F.col("debit_rule")), F.lit(0))
    return found.withColumns({"rule_id": rule, "category": F.col("personal")}).drop("credit_rule", "debit_rule", "personal")


def categorise(tx: DataFrame, rules: list[Rule], aliases: dict[str, str] | None = None) -> DataFrame:
    """tx (description, is_credit, ...) with the attributes of the rule that decides.

    Rules are tried on distinct descriptions and joined back: a ledger has far fewer of them than rows.
    """
    keys = tx.select("description", "is_credit").distinct()
    keys = keys.withColumn("rule_id", first_rule(F.upper(with_aliases(F.col("description"), aliases or {})), F.col("is_credit"), rules))
    return ruled(tx.drop("rule_id").join(keys, ["description", "is_credit"]), rules).drop("rule_id")


def ruled(tx: DataFrame, rules: list[Rule]) -> DataFrame:
    """tx (rule_id, ...) with the attributes of its rules, which are as many as the options have."""
    attributes = rules_frame(tx.sparkSession, [NO_RULE, *rules], 0).drop("pattern", "direction", "priority", "is_income")
    known, review = F.col("rule_id") > 0, F.col("category").isin(*REVIEWED) | (F.col("tax_category") == "non-pl")
    found = attributes.select(
        "rule_id",
        F.col("category").alias("business_category"),
        "tax_category",
        "deductibility",
        "include_in_pnl",
        "is_transfer",
        "is_owner_related",
        "is_fixed_asset",
        "is_loan",
        review.alias("cpa_review"),
        F.when(~known, "No category rule matched").when(review, F.concat(F.lit("Matched '"), "category", F.lit("' rule — requires CPA verification"))).otherwise("").alias("review_reason"),
    )
    return tx.drop(*(c for c in found.columns if c != "rule_id")).join(F.broadcast(found), "rule_id")


def mark_deposits(tx: DataFrame) -> DataFrame:
    """Credits that no rule knew are to be reviewed as deposits."""
    unknown = F.col("is_credit") & (F.col("business_category") == "Uncategorized")
    return tx.withColumns({
        "cpa_review": F.col("cpa_review") | unknown,
        "review_reason": F.when(unknown, "Uncategorized deposit - verify revenue vs transfer vs loan").otherwise(F.col("review_reason")),
        "business_category": F.when(unknown, "CPA Review Required").otherwise(F.col("business_category")),
    })


def personal_patterns(own: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, str]]:
    """(pattern, category) in the order in which the personal profile tries them; own: a household's further patterns."""
    table = {c: (*p, *(own or {}).get(c, ())) for c, p in PERSONAL.items()}
    middle = [(p, c) for c, patterns in table.items() if c not in ("Bank Fees", "Subscriptions") for p in patterns]
    return [*((p, "Bank Fees") for p in BANK_FEES_FIRST), *((p, "Subscriptions") for p in SUBSCRIPTIONS_FIRST), *middle, *((p, "Subscriptions") for p in table["Subscriptions"])]


def personal_category(description: Column, own: dict[str, tuple[str, ...]] | None = None) -> Column:
    upper = F.upper(description)
    chain = reduce(lambda c, x: c.when(_fits(upper, description, x[0], f"(?i){x[0]}"), x[1]), personal_patterns(own), F.when(F.lit(False), ""))
    return chain.otherwise("Other")


def categorise_personal(tx: DataFrame, own: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    keys = tx.select("description").distinct().withColumn("category", personal_category(F.col("description"), own))
    return tx.drop("category").join(keys, "description")


RULE_FIELDS = tuple(f.name for f in fields(Rule))
