"""Double entry, account balances, trial balance, general ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.constants import (
    CASH_ACCOUNT, CHART_OF_ACCOUNTS, DEFAULT_EXPENSE_ACCOUNT, EXPENSE_ACCOUNTS,
)
from tallyframe.functions.money import MONEY, total


def chart(spark: SparkSession) -> DataFrame:
    """The chart of accounts: 28 literal rows, always safe to broadcast."""
    return spark.createDataFrame(
        CHART_OF_ACCOUNTS, "account string, account_name string, account_type string, normal_balance string"
    )


def revenue_account(description: Column, category: Column) -> Column:
    return (
        F.when(F.lower(description).contains("service"), "4100")
        .when(category == "Income", "4000")
        .otherwise("4200")
    )


def expense_account(category: Column) -> Column:
    chain = F
    for name, code in EXPENSE_ACCOUNTS.items():
        chain = chain.when(category == name, F.lit(code))
    return chain.otherwise(F.lit(DEFAULT_EXPENSE_ACCOUNT))


def double_entry(df: DataFrame) -> DataFrame:
    """Two entries per transaction: revenue and cash, or expense and cash.

    An amount of 0 or less takes the expense branch.
    """
    amount, zero = F.col("amount"), F.lit(0).cast(MONEY)
    size = F.abs(amount).cast(MONEY)
    is_income = amount > 0
    contra = F.struct(
        F.when(is_income, revenue_account(F.col("description"), F.col("category")))
        .otherwise(expense_account(F.col("category"))).alias("account"),
        F.when(is_income, zero).otherwise(size).alias("debit"),
        F.when(is_income, size).otherwise(zero).alias("credit"),
        F.when(is_income, "Revenue recognition").otherwise("Expense recognition").alias("memo"),
    )
    cash = F.struct(
        F.lit(CASH_ACCOUNT).alias("account"),
        F.when(is_income, size).otherwise(zero).alias("debit"),
        F.when(is_income, zero).otherwise(size).alias("credit"),
        F.when(is_income, "Cash received").otherwise("Cash paid").alias("memo"),
    )
    rest = [c for c in df.columns if c != "amount"]
    return df.select(*rest, F.explode(F.array(contra, cash)).alias("e")).select(*rest, "e.*")


def account_sums(entries: DataFrame) -> DataFrame:
    return entries.groupBy("tenant", "account").agg(
        total(F.col("debit")).alias("debit_total"), total(F.col("credit")).alias("credit_total")
    )


def posted_sums(df: DataFrame) -> DataFrame:
    """Account sums straight from transactions.

    Entries of one account and side add up, so rows are summed first and the two
    entries are made from the sums: the shuffle carries one row per tenant, account and
    side of each map task instead of two per transaction.
    """
    income = F.coalesce(F.col("amount") > 0, F.lit(False))
    contra = F.when(income, revenue_account(F.col("description"), F.col("category"))).otherwise(
        expense_account(F.col("category"))
    )
    sums = df.groupBy("tenant", contra.alias("account"), income.alias("_in")).agg(total(F.abs("amount")).alias("_s"))
    zero, is_income, size = F.lit(0).cast("decimal(28,2)"), F.col("_in"), F.col("_s")
    left, right = F.when(is_income, zero).otherwise(size), F.when(is_income, size).otherwise(zero)
    entries = F.array(
        F.struct(F.col("account"), left.alias("debit"), right.alias("credit")),
        F.struct(F.lit(CASH_ACCOUNT).alias("account"), right.alias("debit"), left.alias("credit")),
    )
    return account_sums(sums.select("tenant", F.inline(entries)))


def with_chart(sums: DataFrame, spark: SparkSession) -> DataFrame:
    """All accounts of every tenant, zeros kept; unknown account codes are dropped.

    The zero rows come from exploding the literal chart on the distinct tenants of
    the already aggregated sums.
    """
    codes = F.array(*[F.lit(row[0]) for row in CHART_OF_ACCOUNTS])
    zero = F.lit(0).cast("decimal(28,2)")
    zeros = sums.select("tenant").distinct().select(
        "tenant", F.explode(codes).alias("account"), zero.alias("debit_total"), zero.alias("credit_total")
    )
    filled = sums.select("tenant", "account", "debit_total", "credit_total").unionByName(zeros).groupBy(
        "tenant", "account"
    ).agg(total(F.col("debit_total")).alias("debit_total"), total(F.col("credit_total")).alias("credit_total"))
    return filled.join(F.broadcast(chart(spark)), "account", "inner")


def account_balances(entries: DataFrame) -> DataFrame:
    """Debit and credit totals and the balance on the account's normal side."""
    return balances_of_sums(account_sums(entries))


def transaction_balances(df: DataFrame) -> DataFrame:
    """The same balances from transactions, without making the entries row by row."""
    return balances_of_sums(posted_sums(df))


def balances_of_sums(sums: DataFrame) -> DataFrame:
    full = with_chart(sums, sums.sparkSession)
    return full.withColumn(
        "balance",
        F.when(F.col("normal_balance") == "Debit", F.col("debit_total") - F.col("credit_total"))
        .otherwise(F.col("credit_total") - F.col("debit_total")),
    )


def trial_balance(balances: DataFrame) -> DataFrame:
    """Active accounts with debit and credit columns, and a total row ('TOTAL') per tenant."""
    debit = F.col("normal_balance") == "Debit"
    zero = F.lit(0).cast("decimal(28,2)")
    active = balances.where((F.col("debit_total") > 0) | (F.col("credit_total") > 0)).select(
        "tenant", "account", F.when(debit, F.col("balance")).otherwise(zero).alias("debit_balance"),
        F.when(debit, zero).otherwise(F.col("balance")).alias("credit_balance"),
    )
    k = F.col("tenant")
    return (
        active.groupingSets([[k, F.col("account")], [k]], k, F.col("account"))
        .agg(
            F.grouping("account").alias("_g"), F.sum("debit_balance").alias("debit_balance"),
            F.sum("credit_balance").alias("credit_balance"),
        )
        .select(
            "tenant", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("account")).alias("account"),
            "debit_balance", "credit_balance",
            F.when(F.col("_g") == 1, F.abs(F.col("debit_balance") - F.col("credit_balance")) < 0.01).alias("balanced"),
        )
    )


def general_ledger(entries: DataFrame) -> DataFrame:
    """Per account running balance, day by day.

    Entries of an account are summed per day first, so ties inside a day cannot
    change the result and a hot account spreads over the map side.
    """
    daily = entries.groupBy("tenant", "account", "date").agg(
        total(F.col("debit")).alias("debit"), total(F.col("credit")).alias("credit"), F.count("*").alias("entries")
    )
    side = F.broadcast(chart(entries.sparkSession).select("account", "normal_balance"))
    signed = F.when(F.col("normal_balance") == "Debit", F.col("debit") - F.col("credit")).otherwise(
        F.col("credit") - F.col("debit")
    )
    w = Window.partitionBy("tenant", "account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        daily.join(side, "account").withColumn("balance", F.sum(signed).over(w)).drop("normal_balance")
    )


def category_ledger(df: DataFrame, default: str = "General") -> DataFrame:
    """Debits (expenses), credits (income) and balance per category; the rows of a
    category stay in the transactions table."""
    from tallyframe.functions.money import inflow, outflow

    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(default))
    return df.withColumn("category", category).groupBy("tenant", "category").agg(
        total(outflow(F.col("amount"))).alias("debits"),
        total(inflow(F.col("amount"))).alias("credits"),
        total(F.col("amount")).alias("balance"),
        F.count("*").alias("entries"),
    )
