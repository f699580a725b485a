"""Expressions on single values: money, dates, merchants, masks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: A printed amount: in brackets, or with or without a minus sign. Java has no conditional groups, hence two branches.
AMOUNT = r"\(-?\$[\d,]+\.\d{2}\)|-?\$[\d,]+\.\d{2}"


def parse_amount(text: Column) -> Column:
    """$1,234.56, -$5.00, ($9.99), plain numbers; empty or "-" is zero; null if it is no number."""
    t = F.trim(text)
    found = F.regexp_extract(t, AMOUNT, 0)
    digits = F.regexp_replace(F.regexp_extract(found, r"[\d,]+\.\d{2}", 0), ",", "").try_cast(MONEY)
    printed = F.when(found.rlike(r"^[(-]"), -digits).otherwise(digits)
    plain = F.regexp_replace(t, "[$,\u00a0]", "")
    return F.when(found != "", printed).when(plain.isin("", "-"), F.lit(0).cast(MONEY)).otherwise(plain.try_cast(MONEY))


def dollars(x: Column, sign: str = "$") -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(sign), F.format_number(F.abs(x), 2))


def dollars_plain(x: Column) -> Column:
    return dollars(x, "")


def ratio(n: Column, d: Column) -> Column:
    """n / d as a double; null where d is zero."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def percent(n: Column, d: Column) -> Column:
    """One decimal and a percent sign, N/A where d is zero."""
    return F.when(d == 0, "N/A").otherwise(F.concat(F.regexp_replace(F.format_number(ratio(n, d) * 100, 1), ",", ""), F.lit("%")))


def divided(n: Column, d: Column) -> Column:
    """n / d, zero where d is zero."""
    return F.coalesce(F.try_divide(n, d), F.lit(0))


def us_date(text: Column) -> Column:
    """MM/DD/YYYY, with one or two digits; null if there is no such day."""
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy"))


def signed(amount: Column, is_credit: Column) -> Column:
    return F.when(is_credit, amount).otherwise(-amount)


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMMM yyyy")


# What is taken out of a description, in this order, before blanks are collapsed.
MERCHANT_NOISE = (
    (r"XX\d{4}\s+(?:POS\s+)?PINNED\s+\d{2}/\d{2}\s+\d{2}:\d{2}\s*", ""),
    (r"XX\d{4}\s+DEBIT\s+CARD\s+\d{2}/\d{2}\s+\d{2}:\d{2}\s*", ""),
    (r"DEBIT\s+CARD\s+\d{2}/\d{2}\s+\d{2}:\d{2}\s*", ""),
    (r"CARD\s+\d{2}/\d{2}\s+\d{2}:\d{2}\s*", ""),
    (r"\b\d{2}/\d{2}\s+\d{2}:\d{2}\b", ""),
    (r"\b[0-9A-F]{12,}\b", ""),
    (r"\b\d{8,}\b", ""),
    (r"\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?", ""),
    (r"\b([A-Za-z]{4,})\d{1,2}\b", "$1"),
    (r"\s+", " "),
)


def merchant(description: Column) -> Column:
    """The merchant in a description; the first 80 characters of it if nothing is left."""
    out = F.upper(description)
    for pattern, by in MERCHANT_NOISE:
        out = F.regexp_replace(out, pattern, by)
    out = F.trim(out)
    return F.when(out == "", F.substring(description, 1, 80)).otherwise(out)


def merchant_of(tx: DataFrame) -> Column:
    """The merchant that tx carries, from a dictionary of descriptions, else the one that its description gives."""
    return F.col("merchant") if "merchant" in tx.columns else merchant(F.col("description"))


def literal(text: str) -> str:
    """A pattern for text itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def glob(text: Column, pattern: str) -> Column:
    """Whether text fits a pattern in which * is any sequence. First and last part may overlap, so this is not LIKE."""
    if "*" not in pattern:
        return text == pattern
    first, *middle, last = pattern.split("*")
    return text.rlike("(?s)^" + ".*?".join(map(literal, (first, *filter(None, middle))))) & text.endswith(last)


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d", "X")


def mask_account(text: Column) -> Column:
    """Runs of four digits or more keep the last four."""
    return F.regexp_replace(text, r"\d(?=\d{4})", "X")


def share_label(part: Column, total: Column) -> Column:
    """One decimal; <0.1% for what is not zero and would show as such."""
    pct = F.coalesce(ratio(part, total), F.lit(0.0)) * 100
    return F.when((pct > 0) & (pct < 0.1), "<0.1%").otherwise(F.concat(F.regexp_replace(F.format_number(pct, 1), ",", ""), F.lit("%")))


def shortened(text: Column, n: int = 70) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def display_name(name: Column, dba: Column) -> Column:
    return F.when(F.coalesce(dba, F.lit("")) != "", F.concat(name, F.lit(" ("), dba, F.lit(")"))).otherwise(name)


def iso_week(d: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def csv_safe(x: Column) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    text = x.cast("string")
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")
