"""Validation of totals, rows, contracts and narratives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import dbl, inflow, outflow, total

TOLERANCE = 0.01
MAX_AMOUNT = 1_000_000

# Narrative phrases that contradict recorded income or expenses.
INCOME_DENIALS = [
    "no income", "zero income", "cannot be confirmed as no income", "no revenue", "zero revenue", "missing income",
]
EXPENSE_DENIALS = ["no expenses", "zero expenses", "absence of expenses", "no costs", "zero costs", "missing expenses"]
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"


def actual_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Income, expenses, net, counts and the number of invalid amounts per key."""
    amount = F.col("amount")
    bad = amount.isNull() | (amount == 0) | (F.abs(amount) > MAX_AMOUNT)
    return df.groupBy(*keys).agg(
        total(inflow(amount)).alias("income"), total(outflow(amount)).alias("expenses"),
        total(amount).alias("net"), F.count("*").alias("txn_count"), F.count(F.when(bad, 1)).alias("invalid_count"),
    )


def top_two_expenses(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest and second largest expense per key; suspicious when above five times.

    The rank filter is a group limit: at most two rows per key and map task are shuffled.
    """
    w = Window.partitionBy(*keys).orderBy("amount")
    top = df.where(F.col("amount") < 0).select(*keys, "amount").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    out = top.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, -F.col("amount"))).alias("largest"),
        F.max(F.when(F.col("_rn") == 2, -F.col("amount"))).alias("second"),
    )
    return out.withColumn("suspicious", F.coalesce(F.col("largest") > F.col("second") * 5, F.lit(False)))


def _apart(a: Column, b: Column) -> Column:
    return F.abs(dbl(a) - dbl(b)) > TOLERANCE


def validate_summary(reported: DataFrame, transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recompute totals per key, compare with the reported ones, correct and flag."""
    actual = actual_totals(transactions, keys)
    marks = top_two_expenses(transactions, keys).select(*keys, "suspicious")
    j = reported.join(actual, list(keys), "left").join(marks, list(keys), "left").fillna(
        {"txn_count": 0, "invalid_count": 0, "suspicious": False}
    )
    zero = F.lit(0).cast("decimal(28,2)")
    for c in ("income", "expenses", "net"):
        j = j.withColumn(c, F.coalesce(c, zero))
    income, expenses, net = F.col("income"), F.col("expenses"), F.col("net")
    rep = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))
    issue = lambda cond, kind, field: F.when(cond, F.concat(F.lit(kind), F.lit(":"), F.lit(field)))
    issues = F.array_compact(F.array(
        issue(_apart(rep("total_expenses"), expenses), "error", "totalExpenses"),
        issue(_apart(rep("total_income"), income), "error", "totalIncome"),
        issue(_apart(rep("net_cashflow"), net), "error", "netCashflow"),
        issue((expenses > 0) & (income == 0), "warning", "sustainability"),
        issue((income > 0) & (expenses == 0), "warning", "data_completeness"),
        issue(F.col("invalid_count") > 0, "warning", "transaction_quality"),
    ))
    anomalies = F.array_compact(F.array(
        F.when(_apart(rep("net_cashflow"), net), "net_mismatch"),
        F.when((income == 0) & (F.abs(net) > 0), "zero_income_nonzero_net"),
    ))
    errors = F.size(F.filter("issues", lambda i: i.startswith("error")))
    return j.withColumn("issues", issues).withColumn("anomalies", anomalies).select(
        *keys, "income", "expenses", "net", "issues", "anomalies", errors.alias("errors"), (errors == 0).alias("is_valid"), "suspicious",
        ((F.col("txn_count") > 0) & (income == 0) & (expenses == 0)).alias("needs_review"),
    )


def check_consistency(reports: DataFrame) -> DataFrame:
    """Net, margin, narrative and alert contradictions as an issues array."""
    income, expenses, net = dbl(F.col("total_income")), dbl(F.col("total_expenses")), dbl(F.col("net_cashflow"))
    expected = income - expenses
    margin = F.when(income > 0, expected / income * 100).otherwise(F.lit(0.0))
    story = F.lower(F.coalesce("financial_health", F.lit("")))
    says = lambda phrases: story.rlike("|".join(phrases))
    denies = lambda text: F.exists(F.coalesce("alerts", F.array().cast("array<string>")), lambda a: a.contains(text))
    issues = F.array_compact(F.array(
        F.when(F.abs(expected - net) > TOLERANCE, "error:netCashflow"),
        F.when(F.abs(margin - F.col("profit_margin")) > 0.5, "warning:profitMargin"),
        F.when((income > 0) & says(INCOME_DENIALS), "error:income_contradiction"),
        F.when((expenses > 0) & says(EXPENSE_DENIALS), "error:expense_contradiction"),
        F.when((expenses > 0) & denies("No expenses recorded"), "error:alert_expenses"),
        F.when((income > 0) & denies("No income recorded"), "error:alert_income"),
    ))
    return reports.withColumn("issues", issues).withColumn(
        "is_consistent", ~F.exists("issues", lambda i: i.startswith("error"))
    )


def validate_rows(df: DataFrame) -> DataFrame:
    """Row issues with corrected values and the confidence each issue costs."""
    amount = F.col("amount").try_cast("double")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad_date, bad_text, bad_amount, bad_cat = F.col("date").isNull(), blank("description"), amount.isNull() | F.isnan(amount), blank("category")
    issues = F.array_compact(F.array(
        F.when(bad_date, "Missing date"), F.when(bad_text, "Missing description"), F.when(bad_amount, "Invalid amount"),
        F.when(bad_cat, "Missing category"),
    ))
    cost = lambda c, v: F.when(c, F.lit(v).cast("decimal(4,2)")).otherwise(F.lit(0).cast("decimal(4,2)"))
    penalty = cost(bad_date, 0.1) + cost(bad_text, 0.1) + cost(bad_amount, 0.2) + cost(bad_cat, 0.05)
    return df.withColumn("issues", issues).withColumn("penalty", penalty)


def rows_confidence(checked: DataFrame, reported: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest of the row and the totals confidence per key, with the issue count."""
    rows = checked.groupBy(*keys).agg(F.sum("penalty").alias("_p"), F.sum(F.size("issues")).alias("row_issues"))
    j = reported.join(rows, list(keys), "left")
    cols = ("total_income", "total_expenses", "net_cashflow")
    missing = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in cols)
    off = F.coalesce(_apart(F.col("total_income") - F.col("total_expenses"), F.col("net_cashflow")), F.lit(False))
    totals = F.greatest(F.lit(0.0), 1 - missing * 0.2 - F.when(off, 0.3).otherwise(0.0))
    # no rows at all costs 0.3
    row_conf = F.when(F.col("_p").isNull(), 0.7).otherwise(F.greatest(F.lit(0.0), 1 - dbl(F.col("_p"))))
    count = F.coalesce("row_issues", F.lit(1)) + missing + F.when(off, 1).otherwise(0)
    return j.select(
        *keys, F.round(row_conf, 6).alias("row_confidence"), F.round(totals, 6).alias("totals_confidence"),
        F.round(F.least(row_conf, totals), 6).alias("confidence"), count.alias("issue_count"), (count == 0).alias("is_valid"),
    )


def validate_contract(df: DataFrame) -> DataFrame:
    """Reject reasons of raw text rows: ISO date-time, text description, numeric amounts."""
    number = lambda c: F.col(c).try_cast("double").isNull()
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("date").rlike(ISO_DATETIME), F.lit(False)) | F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd").isNull(), "date"),
        F.when(F.col("description").isNull(), "description"), F.when(number("amount"), "amount"),
        F.when(F.col("tax_amount").isNotNull() & number("tax_amount"), "tax_amount"),
        F.when(F.col("status").isNotNull() & ~F.col("status").isin("completed", "failed"), "status"),
    ))
    return df.withColumn("reject", reasons).withColumn("currency", F.coalesce("currency", F.lit("EUR")))
