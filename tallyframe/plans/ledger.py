"""Ledger reports."""

from __future__ import annotations

from tallyframe.constants import CHART_OF_ACCOUNTS, EXPENSE_ACCOUNTS
from tallyframe.operators import ledger
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, transactions

CHART = "chart(account, account_name, account_type, normal_balance) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}')".format(*[x.replace("'", "''") for x in row]) for row in CHART_OF_ACCOUNTS
) + ")"
EXPENSE_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPENSE_ACCOUNTS.items()) + " ELSE '5900' END"
REVENUE_CASE = "CASE WHEN lower(description) LIKE '%service%' THEN '4100' WHEN category = 'Income' THEN '4000' ELSE '4200' END"
ENTRIES = f"""{TXN}, entries AS (
  SELECT tenant, txn_id, date, CASE WHEN amount > 0 THEN {REVENUE_CASE} ELSE {EXPENSE_CASE} END AS account,
         CASE WHEN amount > 0 THEN 0 ELSE abs(amount) END AS debit, CASE WHEN amount > 0 THEN amount ELSE 0 END AS credit,
         CASE WHEN amount > 0 THEN 'Revenue recognition' ELSE 'Expense recognition' END AS memo
  FROM txn
  UNION ALL
  SELECT tenant, txn_id, date, '1000', CASE WHEN amount > 0 THEN amount ELSE 0 END, CASE WHEN amount > 0 THEN 0 ELSE abs(amount) END,
         CASE WHEN amount > 0 THEN 'Cash received' ELSE 'Cash paid' END
  FROM txn
)"""
BALANCES = f"""{ENTRIES}, {CHART}, bal AS (
  SELECT t.tenant, c.account, c.account_name, c.account_type, c.normal_balance,
         coalesce(sum(debit), 0) AS debit_total, coalesce(sum(credit), 0) AS credit_total,
         CASE WHEN c.normal_balance = 'Debit' THEN coalesce(sum(debit), 0) - coalesce(sum(credit), 0)
              ELSE coalesce(sum(credit), 0) - coalesce(sum(debit), 0) END AS balance
  FROM (SELECT DISTINCT tenant FROM txn) t CROSS JOIN chart c LEFT JOIN entries e ON e.tenant = t.tenant AND e.account = c.account
  GROUP BY t.tenant, c.account, c.account_name, c.account_type, c.normal_balance
)"""
NEEDED = ("tenant", "txn_id", "date", "description", "category", "amount")


def entries(spark, d, *columns):
    return ledger.double_entry(transactions(spark, d, *(columns or NEEDED)))


@report(
    "dj_double_entry",
    f"""WITH {ENTRIES} SELECT tenant, txn_id, CAST(date AS VARCHAR) AS date, account, CAST(debit AS DOUBLE) AS debit,
      CAST(credit AS DOUBLE) AS credit, memo FROM entries""",
)
def dj_double_entry(spark, d):
    return entries(spark, d).select("tenant", "txn_id", "date", "account", "debit", "credit", "memo")


@report(
    "fn_revenue_account",
    f"""WITH {TXN} SELECT {REVENUE_CASE} AS account, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM txn
    WHERE amount > 0 GROUP BY ALL""",
)
def fn_revenue_account(spark, d):
    from pyspark.sql import functions as F

    txn = transactions(spark, d, "description", "category", "amount").where("amount > 0")
    return txn.groupBy(ledger.revenue_account(F.col("description"), F.col("category")).alias("account")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )


@report(
    "fn_expense_account",
    f"""WITH {TXN} SELECT {EXPENSE_CASE} AS account, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM txn
    WHERE amount <= 0 GROUP BY ALL""",
)
def fn_expense_account(spark, d):
    from pyspark.sql import functions as F

    txn = transactions(spark, d, "category", "amount").where("amount <= 0")
    return txn.groupBy(ledger.expense_account(F.col("category")).alias("account")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )


@report(
    "jn_account_dim",
    f"""WITH {BALANCES} SELECT tenant, account, account_name, account_type, normal_balance,
      CAST(debit_total AS DOUBLE) AS debit_total, CAST(credit_total AS DOUBLE) AS credit_total FROM bal""",
)
def jn_account_dim(spark, d):
    sums = ledger.posted_sums(transactions(spark, d, "tenant", "description", "category", "amount"))
    return ledger.with_chart(sums, spark)


@report(
    "ag_account_balance",
    f"""WITH {BALANCES} SELECT tenant, account, account_name, account_type, normal_balance,
      CAST(debit_total AS DOUBLE) AS debit_total, CAST(credit_total AS DOUBLE) AS credit_total,
      CAST(balance AS DOUBLE) AS balance FROM bal""",
)
def ag_account_balance(spark, d):
    return ledger.transaction_balances(transactions(spark, d, "tenant", "description", "category", "amount"))


@report(
    "ag_trial_balance",
    f"""WITH {BALANCES}, act AS (SELECT tenant, account, CASE WHEN normal_balance = 'Debit' THEN balance ELSE 0 END AS db,
      CASE WHEN normal_balance = 'Debit' THEN 0 ELSE balance END AS cb FROM bal WHERE debit_total > 0 OR credit_total > 0)
    SELECT tenant, account, CAST(db AS DOUBLE) AS debit_balance, CAST(cb AS DOUBLE) AS credit_balance, CAST(NULL AS BOOLEAN) AS balanced FROM act
    UNION ALL SELECT tenant, 'TOTAL', CAST(sum(db) AS DOUBLE), CAST(sum(cb) AS DOUBLE), abs(sum(db) - sum(cb)) < 0.01 FROM act GROUP BY tenant""",
)
def ag_trial_balance(spark, d):
    txn = transactions(spark, d, "tenant", "description", "category", "amount")
    return ledger.trial_balance(ledger.transaction_balances(txn))


@report(
    "wn_general_ledger",
    f"""WITH {ENTRIES}, {CHART}, daily AS (SELECT tenant, account, date, sum(debit) AS debit, sum(credit) AS credit, count(*) AS n FROM entries GROUP BY ALL)
    SELECT tenant, account, CAST(date AS VARCHAR) AS date, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, n AS entries,
      CAST(sum(CASE WHEN normal_balance = 'Debit' THEN debit - credit ELSE credit - debit END)
        OVER (PARTITION BY tenant, account ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
    FROM daily JOIN chart USING (account)""",
)
def wn_general_ledger(spark, d):
    return ledger.general_ledger(entries(spark, d, "tenant", "date", "description", "category", "amount"))


@report(
    "ag_category_ledger",
    f"""WITH {TXN} SELECT tenant, category, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS debits,
      CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS credits, CAST(sum(amount) AS DOUBLE) AS balance,
      count(*) AS entries FROM txn GROUP BY ALL""",
)
def ag_category_ledger(spark, d):
    return ledger.category_ledger(transactions(spark, d, "tenant", "category", "amount"))
