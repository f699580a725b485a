"""The derived accounts, ready for every report, and the same as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rule_values import EXPENSE, INCOME
from ..functions.scalars import MERCHANT_NOISE
from ..operators import classify, pnl
from ..sources import adapters, texts
from ..sources.shared import written


def rules() -> list[classify.Rule]:
    return classify.ordered(classify.configured_rules(list(adapters.CUSTOM)))


class Book:
    """Frames over one folder of tables. What a query reads more than once is worked out once and written, nothing else."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def words(self) -> DataFrame:
        """The dictionary of descriptions."""
        return classify.dictionary(adapters.texts(self.spark, self.sf_dir), rules())

    @cached_property
    def rows(self) -> DataFrame:
        """The ledger without balances, with what the dictionary says."""
        return classify.with_dictionary(adapters.raw_ledger(self.spark, self.sf_dir), self.words)

    @cached_property
    def raw(self) -> DataFrame:
        return written(adapters.raw_ledger(self.spark, self.sf_dir))

    @cached_property
    def ledger(self) -> DataFrame:
        """The ledger with balances, for which its rows are read twice."""
        return classify.with_dictionary(adapters.transactions(self.spark, self.sf_dir, self.raw), self.words)

    @property
    def kept(self) -> DataFrame | None:
        """The ledger's rows with their numbers as a query has written them already, if it has."""
        return self.__dict__.get("raw", self.__dict__.get("dated"))

    @cached_property
    def st(self) -> DataFrame:
        return adapters.statements(self.spark, self.sf_dir, self.__dict__.get("entered") if self.kept is None else self.kept)

    @cached_property
    def db(self) -> DataFrame:
        return adapters.daily_balances(adapters.transactions(self.spark, self.sf_dir, self.raw if self.kept is None else self.kept))

    @cached_property
    def printed(self) -> DataFrame:
        """The statements as texts in parts, with month and account_id: in place, by statement, as a ledger without its dictionary gives them."""
        raw = self.raw
        return texts.printed(self.st, adapters.transactions(self.spark, self.sf_dir, raw), "month", "account_id")

    @staticmethod
    def classified(rows: DataFrame) -> DataFrame:
        return classify.mark_deposits(classify.ruled(rows.drop("category"), rules())).withColumn("statement_dt", F.last_day("month"))

    @cached_property
    def tx(self) -> DataFrame:
        """The classified ledger, without balances."""
        return self.classified(self.rows)

    @cached_property
    def audited(self) -> DataFrame:
        """The classified ledger with balances."""
        return self.classified(self.ledger)

    @cached_property
    def dated(self) -> DataFrame:
        """The classified ledger, written: what matches reversals reads it several times."""
        return written(self.tx.select(*pnl.READ))

    @cached_property
    def entered(self) -> DataFrame:
        """As dated, with what the numbers of the rows go by in their place: enough for profit and loss."""
        rows = classify.with_dictionary(adapters.unnumbered(self.spark, self.sf_dir), self.words)
        return written(self.classified(rows).select(*(c for c in pnl.READ if c != "sequence"), *adapters.ORDER[1:]))

    @cached_property
    def personal(self) -> DataFrame:
        return self.rows

    def pl(self, period=None, rows: DataFrame | None = None) -> DataFrame:
        """Lines of profit and loss, reversals matched within each period; written, as reports read the few lines several times."""
        rows = self.__dict__.get("dated") if rows is None else rows
        rows, order = (self.entered, adapters.ORDER) if rows is None else (rows, pnl.LISTED)
        return written(pnl.lines(rows, pnl.total_period() if period is None else period, order=order), narrow=True)

    def wide(self, period=None, rows: DataFrame | None = None) -> DataFrame:
        return pnl.summary(self.pl(period, rows))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def _chain(direction: str) -> str:
    own = [(i, r) for i, r in enumerate(rules(), 1) if r.direction in ("either", direction)]
    return "CASE " + " ".join(f"WHEN regexp_matches(u, {quoted(classify._upper_pattern(r.pattern))}) THEN {i}" for i, r in own) + " END"


def _rule_rows() -> str:
    return ", ".join(f"({i}, {quoted(r.category)}, {quoted(r.tax_category)}, {quoted(r.deductibility)}, {r.include_in_pnl}, {r.is_transfer}, {r.is_owner_related}, {r.is_fixed_asset}, {r.is_loan})" for i, r in enumerate(rules(), 1))


def merchant_sql(text: str) -> str:
    out = f"upper({text})"
    for pattern, by in MERCHANT_NOISE:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return f"CASE WHEN trim({out}) = '' THEN substr({text}, 1, 80) ELSE trim({out}) END"


LEDGER = adapters.LEDGER_SQL

TX = f"""{LEDGER}, rules(rule_id, category, r_tax, r_ded, r_pnl, r_transfer, r_owner, r_asset, r_loan) AS (VALUES {_rule_rows()}
), keys AS (SELECT DISTINCT description, is_credit, upper(description) AS u FROM led
), ruled AS (SELECT description, is_credit, CASE WHEN is_credit THEN {_chain('credit')} ELSE {_chain('debit')} END AS rule_id FROM keys
), tx0 AS (
  SELECT led.*, rule_id, coalesce(category, 'Uncategorized') AS cat, coalesce(r_tax, 'CPA Review') AS tax_category, coalesce(r_ded, 'unknown') AS deductibility, coalesce(r_pnl, false) AS include_in_pnl,
         coalesce(r_transfer, false) AS is_transfer, coalesce(r_owner, false) AS is_owner_related, coalesce(r_asset, false) AS is_fixed_asset, coalesce(r_loan, false) AS is_loan,
         category IS NULL OR category IN ('Uncategorized', 'CPA Review Required') OR r_tax = 'non-pl' AS cpa_review
  FROM led JOIN ruled USING (description, is_credit) LEFT JOIN rules USING (rule_id)
), tx AS (
  SELECT * EXCLUDE (cat, rule_id), CASE WHEN is_credit AND cat = 'Uncategorized' THEN 'CPA Review Required' ELSE cat END AS business_category,
         CASE WHEN is_credit AND cat = 'Uncategorized' THEN 'Uncategorized deposit - verify revenue vs transfer vs loan' WHEN rule_id IS NULL THEN 'No category rule matched'
              WHEN cpa_review THEN 'Matched ''' || cat || ''' rule — requires CPA verification' ELSE '' END AS review_reason
  FROM tx0
)"""

_SECTION = f"""CASE WHEN business_category IN {names(pnl.REVENUE)} THEN 'revenue' WHEN business_category IN {names(pnl.DIRECT)} THEN 'direct_costs'
  WHEN business_category IN {names(pnl.OPERATING)} THEN 'operating_expenses' WHEN business_category IN {names(pnl.OTHER_INCOME)} THEN 'other_income'
  WHEN business_category IN {names(pnl.OTHER_EXPENSE)} THEN 'other_expense' END"""


def _matched_sql(rows: str, period: str) -> str:
    """CTEs up to hit: the reversals of each group in order, each taking the best debit that none before it took."""
    return f"""rev AS (
  SELECT account_id, {period} AS period, {merchant_sql('description')} AS merchant, statement_id, sequence, last_day(month) AS sdt, post_dt, (amount * 100)::BIGINT AS cents, business_category,
         is_credit AND business_category = 'Payment Reversal' AND NOT is_transfer AND NOT is_owner_related AND NOT (is_loan AND NOT include_in_pnl) AS back, NOT is_credit AND NOT is_transfer AS debit FROM {rows}
), pairs AS (
  SELECT r.account_id || '|' || r.period || '|' || r.merchant AS grp, r.sdt AS r_sdt, r.statement_id AS r_statement, r.sequence AS r_sequence, r.cents AS rc, d.sdt AS d_sdt, d.statement_id || '#' || d.sequence AS d_id, d.sequence AS d_sequence, d.cents AS dc,
         CASE WHEN r.cents = 0 OR d.cents = 0 THEN 0.0::DOUBLE ELSE least(r.cents, d.cents)::DOUBLE / greatest(r.cents, d.cents)::DOUBLE END AS part, date_diff('day', d.post_dt, r.post_dt) AS days
  FROM rev r JOIN rev d ON r.account_id = d.account_id AND r.period = d.period AND r.merchant = d.merchant WHERE r.back AND d.debit AND r.post_dt >= d.post_dt AND r.post_dt <= d.post_dt + 90
), cand0 AS (SELECT grp, r_sdt, r_statement, r_sequence, list(d_id ORDER BY part - days::DOUBLE / 36500 DESC, d_sdt, d_sequence) AS cands FROM pairs WHERE NOT (rc < dc AND part < 0.8) GROUP BY ALL
), cand AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r_sdt, r_sequence) AS n FROM cand0
), run AS (
  SELECT DISTINCT grp, 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::VARCHAR AS r_statement, NULL::BIGINT AS r_sequence, NULL::VARCHAR AS pick FROM cand
  UNION ALL
  SELECT grp, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, r_statement, r_sequence, pick
  FROM (SELECT c.grp, c.n, run.used, c.r_statement, c.r_sequence, list_filter(c.cands, lambda x: NOT list_contains(run.used, x))[1] AS pick FROM run JOIN cand c ON c.grp = run.grp AND c.n = run.n + 1)
), hit AS (
  SELECT r.account_id, r.period, r.merchant, r.statement_id AS reversal_statement, r.sequence AS reversal_sequence, d.statement_id AS debit_statement, d.sequence AS debit_sequence, d.business_category AS debit_category, least(r.cents, d.cents) AS cents
  FROM run JOIN rev r ON r.statement_id = run.r_statement AND r.sequence = run.r_sequence AND r.account_id || '|' || r.period || '|' || r.merchant = run.grp JOIN rev d ON d.statement_id || '#' || d.sequence = run.pick AND d.period = r.period
)"""


def hit_sql(period: str) -> str:
    return f"RECURSIVE {TX}, {_matched_sql('tx', period)}"


_HIT_SECTION = f"CASE WHEN debit_category IN {names(pnl.REVENUE)} THEN 'revenue' WHEN debit_category IN {names(pnl.DIRECT)} THEN 'direct_costs' WHEN debit_category IN {names(pnl.OPERATING)} THEN 'operating_expenses' END"


def pl_sql(period: str = "'total'", where: str = "true", source: str = "tx") -> str:
    """CTEs up to pl(account_id, period, section, category, amount) and wide; matched reversals are off the lines of their debits."""
    totals = ", ".join(f"coalesce(sum(amount) FILTER (section = '{s}'), 0) AS total_{s}" for s in pnl.SECTIONS)
    buckets = ", ".join(f"coalesce(sum(amount) FILTER (section = '{b}'), 0) AS {b}" for b in pnl.BUCKETS)
    return f"""RECURSIVE {TX}, used_tx AS (SELECT * FROM {source} WHERE {where}
), routed AS (
  SELECT *, {_SECTION} AS known,
    CASE WHEN is_transfer THEN CASE WHEN is_credit THEN 'account_transfers_credits' WHEN business_category = 'Credit Card Payment' THEN 'credit_card_transfers' ELSE 'account_transfers_debits' END
         WHEN is_owner_related THEN CASE WHEN is_credit THEN 'owner_contributions' ELSE 'owner_distributions' END
         WHEN is_loan AND NOT include_in_pnl THEN CASE WHEN is_credit THEN 'loan_proceeds' ELSE 'loan_principal_payments' END
         WHEN business_category = 'Payment Reversal' THEN CASE WHEN is_credit THEN 'payment_reversal_credits' ELSE 'payment_reversal_debits' END
         WHEN is_fixed_asset THEN 'fixed_asset_purchases'
         WHEN NOT include_in_pnl THEN CASE WHEN is_credit THEN 'uncategorized_non_pnl_credits' ELSE 'uncategorized_non_pnl_debits' END END AS bucket
  FROM used_tx
), {_matched_sql('used_tx', period)}, taken AS (SELECT *, {_HIT_SECTION} AS s, cents::DECIMAL(18,2) / 100 AS x FROM hit), pl AS (
  SELECT account_id, period, section, category, sum(amount)::DECIMAL(38,2) AS amount FROM (
    SELECT account_id, {period} AS period, coalesce(bucket, known, CASE WHEN is_credit THEN 'revenue' ELSE 'operating_expenses' END) AS section, CASE WHEN bucket IS NULL THEN business_category ELSE '' END AS category,
           sum(CASE WHEN bucket IS NULL AND known IS NOT NULL AND is_credit <> (known IN ('revenue', 'other_income')) THEN -amount ELSE amount END)::DECIMAL(38,2) AS amount
    FROM routed GROUP BY ALL
    UNION ALL SELECT account_id, period, s, debit_category, -x::DECIMAL(38,2) FROM taken WHERE s IS NOT NULL
    UNION ALL SELECT account_id, period, 'payment_reversal_credits', '', -x::DECIMAL(38,2) FROM taken WHERE s IS NOT NULL) GROUP BY ALL
), wide0 AS (SELECT account_id, period, {totals}, {buckets} FROM pl GROUP BY ALL
), wide AS (
  SELECT *, total_revenue - total_direct_costs AS gross_profit, total_revenue - total_direct_costs - total_operating_expenses AS operating_profit,
         total_revenue - total_direct_costs - total_operating_expenses + total_other_income - total_other_expense AS net_profit
  FROM wide0
)"""


def personal_sql() -> str:
    """CTEs up to ptx: the ledger with its personal category. RE2 has no look-ahead; the two patterns with one match nothing here."""
    chain = " ".join(f"WHEN regexp_matches(description, {quoted('(?i)' + p)}) THEN {quoted(c)}" for p, c in classify.personal_patterns() if "(?!" not in p)
    return f"{LEDGER}, pkeys AS (SELECT DISTINCT description FROM led), pcat AS (SELECT description, CASE {chain} ELSE 'Other' END AS category FROM pkeys), ptx AS (SELECT * FROM led JOIN pcat USING (description))"


CATEGORIES = (*INCOME, *EXPENSE)
