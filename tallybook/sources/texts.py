"""Statement texts: reading them, dropping repeated files, and printing them from statements and their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import dollars

#: Names of own reports, which are no statements.
OWN_REPORTS = r"(?i)(personal|business)_financial_report"


def read_texts(spark: SparkSession, folder: str, glob: str = "*.[tT][xX][tT]") -> DataFrame:
    """path, text of every extracted statement below a folder, in the order of the paths."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(OWN_REPORTS)).orderBy("path")


def statement_file(path: Column) -> Column:
    """Whether a path is one of an extracted statement: its suffix in any case, and not the name of an own report."""
    return path.rlike(r"(?i)\.txt$") & ~path.rlike(OWN_REPORTS)


def distinct_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of files (path, text): of equal contents the first path stays; no text is an empty one."""
    first = Window.partitionBy("hash").orderBy("path")
    rows = files.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("n", F.row_number().over(first))
    return rows.where("n = 1").drop("n"), rows.where("n > 1").select("path", F.lit("Duplicate file content").alias("message"))


#: Lines of page heads and feet.
PAGE_LINES = ("Page 2 of 2", "12345678  Checking Account Statements", "RETURN SERVICE REQUESTED", "#55 12", "Account Activity (continued)", "0123456789ABCDEF0123456789ABCDEF", "7", "IA 52001")

#: How damaged() spoils a text, by number; other numbers leave it as it is. No pattern reaches beyond a line.
DAMAGE = {
    1: (("Statement Ending ", "Statement of "),),
    2: (("XXXXXXXXXX", "ACCOUNT "),),
    3: (("Statement Ending \\d\\d", "Statement Ending 13"),),
    4: (("(?m)^.*This Period.*$", ""),),
    6: (("(?m)^\\d\\d/\\d\\d/(\\d{4})  ", "13/45/$1  "),),
    7: (("(?m)^(Beginning|Ending) Balance.*$", "Balance"),),
    8: (("Statement Ending ", "Statement of "), ("XXXXXXXXXX", "ACCOUNT ")),
}
#: By the same numbers: from the first of one heading to the last of another the text goes, the latter stays.
CUT = {5: ("Account Activity", "Checks Cleared")}


def damaged(parts: DataFrame, kind: Column) -> DataFrame:
    """parts (doc_id, part, text) of texts spoilt by a number of DAMAGE or CUT, so that a load has rows to reject."""
    text = F.col("text")
    for k, steps in DAMAGE.items():
        spoilt = F.col("text")
        for pattern, by in steps:
            spoilt = F.regexp_replace(spoilt, pattern, by)
        text = F.when(kind == k, spoilt).otherwise(text)
    parts = parts.withColumn("text", text)
    whole = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text, part = F.col("text"), F.col("part")
    for k, (start, end) in CUT.items():
        last = F.when((kind == k) & text.contains(end), F.struct("part", F.substring_index("text", end, -1).alias("rest")))
        rows = parts.withColumns({"from": F.min(F.when((kind == k) & text.contains(start), part)).over(whole), "upto": F.max(last).over(whole)})
        rows = rows.where(F.coalesce((part <= F.col("from")) | (part > F.col("upto.part")), F.lit(True)))
        joined = F.concat(F.substring_index("text", start, 1), F.lit(end), F.col("upto.rest"))
        cut = F.when(part == F.col("upto.part"), F.regexp_replace("text", f"(?s){start}.*{end}", end)).when(F.col("from") < F.col("upto.part"), joined)
        parts = rows.withColumn("text", F.when(part == F.col("from"), F.coalesce(cut, text)).otherwise(text)).drop("from", "upto")
    return parts


def _padded(text: Column, width: int, left: bool = True) -> Column:
    """text filled up with blanks to a width, longer ones as they are."""
    text = F.coalesce(text, F.lit("null"))
    blanks = F.repeat(F.lit(" "), F.lit(width) - F.length(text))
    return F.concat(blanks, text) if left else F.concat(text, blanks)


def printed(statements: DataFrame, tx: DataFrame, *kept: str) -> DataFrame:
    """doc_id (statement_id), part, text: a statement in the layout that the parser reads, with the balance after the last row of each day.

    A text is given in parts, in order, each some whole lines of it: a row of the ledger prints its own lines, the first
    also the head and the last the foot. So no task holds a whole text, however long it is. kept: columns of statements to go along.

    By sequence, descriptions stand on the row, before it, or on it with a reference line after it. Every second statement has
    pages within its activity: heads and feet between the rows, references with a date, a line of balance alone, and a
    balance brought forward after text that belongs to no row.
    """
    odd = lambda day: F.pmod(F.unix_date(F.trunc(day, "MM")), F.lit(2)) == 1
    us = lambda c: F.date_format(c, "MM/dd/yyyy")
    # what is printed several times is worked out once, and in steps, so that the methods made of them are short enough to be compiled
    rows = tx.select("statement_id", "sequence", "post_dt", "description", us("post_dt").alias("on"), dollars(F.col("balance")).alias("left"), dollars(F.col("amount")).alias("moved"), "is_credit", odd("post_dt").alias("paged"))
    by = Window.partitionBy("statement_id").orderBy("sequence")
    rows = rows.withColumns({"following": F.lead("post_dt").over(by), "next": F.lead("sequence").over(by), "before": F.lag("sequence").over(by)})
    day = F.when(F.col("following").isNull() | (F.col("following") != F.col("post_dt")), F.concat_ws(" ", "on", "left"))
    rows = rows.withColumn("days", F.collect_list(day).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    third, paged = F.col("sequence") % 3, F.col("paged")
    aside = F.when(F.col("is_credit"), F.concat(_padded(F.lit(""), 18), _padded(F.col("moved"), 18))).otherwise(F.concat(_padded(F.col("moved"), 18), _padded(F.lit(""), 18)))
    row = F.concat("on", F.lit("  "), _padded(F.when(third == 1, "").otherwise(F.col("description")), 60, left=False), aside, _padded(F.col("left"), 22))
    head = F.element_at(F.array(*map(F.lit, PAGE_LINES)), (F.pmod(F.col("sequence"), F.lit(len(PAGE_LINES))) + 1).cast("int"))
    after = F.when(third == 2, F.when(paged, F.concat("on", F.lit("  REF TEXT"))).otherwise("REF TEXT")).when(paged & (third == 0), head)
    lines = F.concat_ws("\n", F.when(third == 1, F.col("description")), row, after)
    rows = rows.select("statement_id", "sequence", F.col("before").isNull().alias("first"), F.col("next").isNull().alias("last"), lines.alias("body"), F.when(F.col("next").isNull(), F.array_join("days", "   ")).alias("days"))
    d = lambda c: dollars(F.col(c))
    turned = odd("statement_dt")
    top = [
        F.concat(F.lit("FIRST BANK   Statement Ending "), us("statement_dt")),
        F.concat(F.lit("BUSINESS CHECKING XXXXXXXXXX"), F.lpad(F.col("account_id").cast("string"), 4, "0")),
        F.lit("Account Summary"),
        F.concat(F.lit("Beginning Balance "), d("beginning_balance")),
        F.concat(F.col("credit_count").cast("string"), F.lit(" Credit(s) This Period "), d("total_credits")),
        F.concat(F.col("debit_count").cast("string"), F.lit(" Debit(s) This Period "), d("total_debits")),
        F.concat(F.lit("Ending Balance "), d("ending_balance")),
        F.lit("Account Activity"),
        F.format_string("%-12s%-60s%18s%18s%22s", F.lit("Post Date"), F.lit("Description"), F.lit("Debits"), F.lit("Credits"), F.lit("Balance")),
        F.when(turned, F.concat(F.lit("TEXT OF NO ROW\n"), us("statement_dt"), F.lit(" Beginning Balance "), d("beginning_balance"))),
    ]
    foot = [
        F.when(turned, F.format_string("%-127s%s", us("statement_dt"), d("ending_balance"))),
        F.lit("Page 1 of 2"),
        F.lit("Checks Cleared"),
        F.concat(F.lit("   101  "), us("statement_dt"), F.lit("  "), d("total_debits")),
        F.lit("Daily Balances"),
    ]
    around = statements.select("statement_id", F.concat_ws("\n", *top).alias("top"), F.concat_ws("\n", *foot).alias("foot"), *kept)
    text = F.concat_ws("\n", F.when(F.col("first"), F.col("top")), "body", F.when(F.col("last"), F.concat_ws("\n", "foot", "days", F.lit("Total Overdraft Fees $12.50"))))
    return rows.join(around.hint("shuffle_hash"), "statement_id").select(F.col("statement_id").alias("doc_id"), F.col("sequence").alias("part"), text.alias("text"), *kept)
