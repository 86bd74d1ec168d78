"""One table of additive measures from which every section of a financial report derives.

A row is a tenant's month, category, asset class and tax class; its measures are sums and
counts, so tables of different periods or sources are merged by adding them, and a new
period never reads old transactions again. The table grows with months and classes, not
with transactions.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import dbl, inflow, outflow, rounded, total
from tallyframe.functions.periods import as_date, month_key, tax_due_date
from tallyframe.functions.tax import tax_class, tax_rate, tax_word
from tallyframe.operators import statements, tax, trend

KEYS = ("tenant", "month", "category", "asset_class", "tax_class", "names_debt")
MEASURES = {
    "n": "bigint", "spend_n": "bigint", "inflow": "decimal(28,2)", "outflow": "decimal(28,2)", "net": "decimal(28,2)",
    "net_amount": "decimal(28,4)", "tax_part": "decimal(28,4)",
}


def statement_facts(df: DataFrame) -> DataFrame:
    """``KEYS`` and ``MEASURES`` of transactions (tenant, date, amount, category, description), from one scan.

    Rows of amount 0 or NULL count in ``n`` and have no class. NULL dates and categories keep
    groups of their own.
    """
    amount = F.col("amount")
    real = amount.isNotNull() & (amount != 0)
    asset = statements.classify_asset_liability(F.col("description"), amount, F.coalesce("category", F.lit("Other")))
    rows = df.select(
        "tenant", month_key(F.col("date")).alias("month"), "category", "amount", "description",
        F.when(real, asset).alias("asset_class"), F.when(real, tax_word(F.col("description"))).alias("_word"), real.alias("_real"),
        F.coalesce(F.lower("description").rlike("loan|debt"), F.lit(False)).alias("names_debt"),
    ).withColumn("tax_class", F.when(F.col("_real"), tax_class(F.col("_word"), F.col("category"))))
    net, part = tax.parts(amount, tax_rate(F.col("_word"), F.col("tax_class"), F.col("description")))
    taxed = F.col("tax_class").isNotNull()
    money = F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.count(F.when(amount < 0, 1)).alias("spend_n"),
        total(inflow(money)).alias("inflow"), total(outflow(money)).alias("outflow"), total(money).alias("net"),
        *[F.coalesce(F.sum(F.when(taxed, c)), F.lit(0)).cast(MEASURES[m]).alias(m) for m, c in (("net_amount", net), ("tax_part", part))],
    )


def merged(*tables: DataFrame) -> DataFrame:
    """Facts of several periods or sources as one table."""
    return reduce(DataFrame.unionByName, tables).groupBy(*KEYS).agg(*[F.sum(m).cast(kind).alias(m) for m, kind in MEASURES.items()])


def cash(facts: DataFrame) -> DataFrame:
    """What ``cash.cash_totals`` gives of the transactions."""
    return facts.groupBy("tenant").agg(*[F.sum(c).cast("decimal(28,2)").alias(c) for c in ("inflow", "outflow", "net")], F.sum("n").alias("txn_count"))


def spending(facts: DataFrame) -> DataFrame:
    """What ``budget.actuals`` gives of the transactions."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Other"))
    return facts.where("spend_n > 0").groupBy("tenant", category.alias("category"), "month").agg(
        F.sum("outflow").cast("decimal(28,2)").alias("actual"), F.sum("spend_n").alias("txn_count")
    )


def assets(facts: DataFrame) -> DataFrame:
    """What ``statements.assets_liabilities`` gives of the classified transactions."""
    return statements.totals_of_kinds(facts.where("asset_class is not null").groupBy(
        "tenant", F.substring_index("asset_class", ":", 1).alias("type"), F.substring_index("asset_class", ":", -1).alias("subcategory"),
    ).agg(total(F.col("inflow") + F.col("outflow")).alias("_v"), F.sum("n").alias("_n")))


def debts(facts: DataFrame) -> DataFrame:
    """What ``cash.debt_totals`` gives of the transactions."""
    return facts.where("names_debt").groupBy("tenant").agg(
        F.sum("outflow").cast("decimal(28,2)").alias("debt_payments"), F.sum("inflow").cast("decimal(28,2)").alias("loan_proceeds"), F.sum("n").alias("txn_count")
    )


def taxes(facts: DataFrame, as_of: date | str, days: int = 30) -> DataFrame:
    """``tax.tax_totals`` and counts of entries that fall due; all entries are pending, as ``tax.tax_entries`` makes them."""
    day = as_date(as_of)
    sums = facts.where("tax_class is not null").groupBy("tenant", "tax_class").agg(F.sum("n").alias("n"), F.sum("net_amount").alias("net_amount"), F.sum("tax_part").alias("tax_part"))
    sums = sums.withColumn("type", tax.tax_type(F.col("tax_class"))).withColumn("due_date", tax_due_date(F.col("tax_class"), as_of))
    soon, late = F.col("due_date").between(day, F.date_add(day, days)), F.col("due_date") < day
    due = sums.groupBy("tenant").agg(
        F.sum(F.when(soon, F.col("n")).otherwise(0)).alias("upcoming"), dbl(F.sum(F.when(soon, F.col("tax_part")).otherwise(0))).alias("upcoming_amount"),
        F.sum(F.when(late, F.col("n")).otherwise(0)).alias("overdue"), F.max(F.when(F.col("type") == "vat", 0.0)).alias("vat_paid_share"),
    )
    return tax.totals_of_kinds(sums).join(due, "tenant")


def outlook(facts: DataFrame, months: int = 12) -> DataFrame:
    """Next month per tenant: the mean of its last ``months`` calendar months, moved by the trend of the last two with rows."""
    per = facts.where("month is not null").groupBy("tenant", "month").agg(*[F.sum(a).alias(b) for a, b in (("inflow", "income"), ("outflow", "expense"), ("net", "net"))])
    last = F.max("month").over(Window.partitionBy("tenant"))  # a row a month
    recent = per.withColumn("_from", month_key(F.add_months(F.to_date(F.concat(last, F.lit("-01"))), -months))).where("month > _from")
    stats = trend.last_two(recent.drop("_from"), ["tenant"], "month", ["income", "expense", "net"])

    def next_month(v: str):
        return F.col(f"avg_{v}") * (1 + F.col(f"{v}_trend") / 100)

    return stats.withColumns({
        "next_income": rounded(next_month("income"), 4), "next_expense": rounded(next_month("expense"), 4),
        "total_net": rounded(next_month("income") - next_month("expense"), 4),
    })
