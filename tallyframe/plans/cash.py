"""Cash-flow reports."""

from __future__ import annotations

from tallyframe.operators import cash
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, transactions

FLOWS = """CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END), 0) AS DOUBLE) AS inflow,
 CAST(coalesce(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END), 0) AS DOUBLE) AS outflow,
 CAST(coalesce(sum(amount), 0) AS DOUBLE) AS net, count(*) AS txn_count"""


@report("ag_cash_totals", f"WITH {TXN} SELECT tenant, {FLOWS} FROM txn GROUP BY tenant")
def ag_cash_totals(spark, d):
    return cash.cash_totals(transactions(spark, d, "tenant", "amount"))


@report(
    "ag_cash_daily",
    f"WITH {TXN} SELECT tenant, coalesce(CAST(date AS VARCHAR), 'unknown') AS day, {FLOWS} FROM txn GROUP BY ALL",
)
def ag_cash_daily(spark, d):
    return cash.cash_daily(transactions(spark, d, "tenant", "date", "amount"))


@report(
    "ag_cash_week_month",
    f"""WITH {TXN}
    SELECT tenant, 'day' AS grain, CAST(date AS VARCHAR) AS bucket, {FLOWS} FROM txn GROUP BY ALL
    UNION ALL SELECT tenant, 'week', CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR), {FLOWS} FROM txn GROUP BY ALL
    UNION ALL SELECT tenant, 'month', strftime(date, '%Y-%m'), {FLOWS} FROM txn GROUP BY ALL
    UNION ALL SELECT tenant, 'all', NULL, {FLOWS} FROM txn GROUP BY ALL""",
)
def ag_cash_week_month(spark, d):
    return cash.cash_calendar(transactions(spark, d, "tenant", "date", "amount"))


@report(
    "ag_cash_period",
    f"""WITH {TXN}
    SELECT 'today' AS period, tenant, {FLOWS} FROM txn WHERE date = DATE '1998-06-17' GROUP BY ALL
    UNION ALL SELECT 'week', tenant, {FLOWS} FROM txn WHERE date BETWEEN DATE '1998-06-15' AND DATE '1998-06-21' GROUP BY ALL
    UNION ALL SELECT 'month', tenant, {FLOWS} FROM txn WHERE date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' GROUP BY ALL
    UNION ALL SELECT 'year', tenant, {FLOWS} FROM txn WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY ALL
    UNION ALL SELECT 'range', tenant, {FLOWS} FROM txn WHERE date BETWEEN DATE '1997-03-05' AND DATE '1997-09-20' GROUP BY ALL""",
)
def ag_cash_period(spark, d):
    """All asked periods lie between the first and last day given to the scan."""
    txn = transactions(spark, d, "tenant", "date", "amount", since="1997-03-05", until="1998-12-31")
    return cash.cash_periods(txn, "1998-06-17", {"range": ("1997-03-05", "1997-09-20")})


@report(
    "wn_running_cash",
    f"""WITH {TXN} SELECT tenant, txn_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount,
      CAST(sum(amount) OVER (PARTITION BY tenant ORDER BY date, txn_id, amount ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
    FROM txn""",
)
def wn_running_cash(spark, d):
    return cash.running_cash_rows(transactions(spark, d, "tenant", "txn_id", "date", "amount"))


@report(
    "wn_running_cash_daily",
    f"""WITH {TXN}, daily AS (SELECT tenant, date, sum(amount) AS net FROM txn GROUP BY ALL)
    SELECT tenant, CAST(date AS VARCHAR) AS date, CAST(net AS DOUBLE) AS net,
           CAST(sum(net) OVER (PARTITION BY tenant ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
    FROM daily""",
)
def wn_running_cash_daily(spark, d):
    return cash.running_cash(transactions(spark, d, "tenant", "date", "amount"))


@report(
    "ag_debt_totals",
    f"""WITH {TXN}, src AS (SELECT tenant, amount, CASE WHEN category = 'Travel' THEN 'Loan ' ELSE '' END || description AS description FROM txn)
    SELECT tenant, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS debt_payments,
      CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS loan_proceeds, count(*) AS txn_count
    FROM src WHERE regexp_matches(lower(description), 'loan|debt') GROUP BY tenant""",
)
def ag_debt_totals(spark, d):
    """Travel rows stand in for loan rows: the tables name no loans."""
    from pyspark.sql import functions as F

    txn = transactions(spark, d, "tenant", "amount", "description", "category")
    tagged = F.concat(F.when(F.col("category") == "Travel", "Loan ").otherwise(""), F.col("description"))
    return cash.debt_totals(txn.withColumn("description", tagged))


@report(
    "ag_summary_category",
    f"""WITH {TXN} SELECT tenant, category, {FLOWS} FROM txn GROUP BY tenant, category
    UNION ALL SELECT tenant, '*', {FLOWS} FROM txn GROUP BY tenant""",
)
def ag_summary_category(spark, d):
    return cash.summary_by_category(transactions(spark, d, "tenant", "category", "amount"))
