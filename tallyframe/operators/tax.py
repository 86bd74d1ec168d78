"""Taxes and VAT: entries, totals, liability, calendar and deadlines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.money import rounded
from tallyframe.functions.periods import as_date, tax_due_date
from tallyframe.functions.tax import tax_class, tax_rate, tax_word

TAX_MONEY = "decimal(18,4)"


def tax_type(cls: Column) -> Column:
    return F.when(cls.isin("VAT by text", "VAT"), "vat").when(cls.isNotNull(), "tax")


def parts(amount: Column, rate: Column) -> tuple[Column, Column]:
    """Net amount and the tax within an amount, as decimals so that sums do not depend on their order."""
    size = F.abs(amount).cast("double")
    net = size / (1 + rate)
    return rounded(net, 4).cast(TAX_MONEY), rounded(size - net, 4).cast(TAX_MONEY)


def tax_entries(df: DataFrame, as_of: date | str) -> DataFrame:
    """One entry per tax-related transaction; everything else is dropped."""
    valid = df.where(F.col("amount").isNotNull() & (F.col("amount") != 0))
    cls = F.col("_cls")
    net_amount, tax_part = parts(F.col("amount"), F.col("rate"))
    return (
        valid.withColumn("_word", tax_word(F.col("description")))
        # zero or one class per row: the generator drops untaxed rows and keeps later
        # filters from copying the keyword expressions
        .select("*", F.explode(F.array_compact(F.array(tax_class(F.col("_word"), F.col("category"))))).alias("_cls"))
        .withColumn("rate", tax_rate(F.col("_word"), cls, F.col("description")))
        .withColumns(
            {
                "type": tax_type(cls),
                "subcategory": F.when(cls == "VAT by text", "VAT").otherwise(cls),
                "net_amount": net_amount,
                "tax_part": tax_part,
                "due_date": tax_due_date(cls, as_of),
                "status": F.lit("pending"),
            }
        )
        .drop("_word", "_cls")
    )


def tax_totals(entries: DataFrame) -> DataFrame:
    return totals_of_kinds(entries.groupBy("tenant", "type").agg(
        F.sum("tax_part").alias("tax_part"), F.sum("net_amount").alias("net_amount"), F.count("*").alias("n")
    ))


def totals_of_kinds(sums: DataFrame) -> DataFrame:
    """Totals and effective rates per tenant from sums (tax_part, net_amount, n) per type."""
    is_vat, zero = F.col("type") == "vat", F.lit(0)
    base = sums.groupBy("tenant").agg(
        F.sum(F.when(is_vat, zero).otherwise(F.col("tax_part"))).alias("total_taxes"),
        F.sum(F.when(is_vat, F.col("tax_part")).otherwise(zero)).alias("total_vat"),
        F.sum("net_amount").alias("total_net"),
        F.sum(F.when(is_vat, F.col("n")).otherwise(zero)).alias("vat_count"),
        F.sum(F.when(is_vat, zero).otherwise(F.col("n"))).alias("tax_count"),
    )

    def rate(col: str) -> Column:
        quotient = F.col(col).cast("double") / F.col("total_net").cast("double")
        return F.when(F.col("total_net") > 0, rounded(quotient, 6)).otherwise(F.lit(0.0))

    return base.withColumn("effective_tax_rate", rate("total_taxes")).withColumn(
        "effective_vat_rate", rate("total_vat")
    )


def tax_liability(entries: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Counts and totals by kind for entries dated inside the period."""
    inside = entries.where(F.col("date").between(as_date(start), as_date(end)))
    return inside.groupBy("tenant", "type").agg(F.count("*").alias("n"), F.sum("tax_part").alias("total"))


def reminders(tenants: DataFrame, as_of: date | str) -> DataFrame:
    """Recurring reminders of the year of ``as_of`` that are still ahead.

    Income tax is due on day 31 of the quarter's last month (day 31 of a 30-day
    month is the next day); VAT on the last day of each month.
    """
    day = as_date(as_of)
    year = F.trunc(day, "year")
    y = F.date_format(day, "yyyy")
    quarters = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda q: F.struct(
            F.lit("tax").alias("type"), F.lit("Income Tax").alias("subcategory"),
            F.concat(F.lit("Income Tax Q"), (q + 1).cast("string"), F.lit(" "), y).alias("description"),
            F.date_add(F.add_months(year, q * 3 + 2), 30).alias("due_date"),
        ),
    )
    months = F.transform(
        F.sequence(F.lit(0), F.lit(11)),
        lambda m: F.struct(
            F.lit("vat").alias("type"), F.lit("VAT").alias("subcategory"),
            F.concat(F.lit("VAT Return "), F.date_format(F.add_months(year, m), "yyyy-MM")).alias("description"),
            F.last_day(F.add_months(year, m)).alias("due_date"),
        ),
    )
    rows = tenants.select("tenant", F.inline(F.concat(quarters, months)))
    return rows.where(F.col("due_date") > day)


def calendar(entries: DataFrame, as_of: date | str, tenants: DataFrame | None = None) -> DataFrame:
    """Entries and reminders by due date."""
    who = entries.select("tenant").distinct() if tenants is None else tenants
    ours = entries.select(
        "tenant", "type", "subcategory", "description", "due_date", F.col("tax_part").alias("amount")
    )
    ahead = reminders(who, as_of).withColumn("amount", F.lit(0).cast(TAX_MONEY))
    return ours.unionByName(ahead).orderBy("tenant", "due_date", "type", "description", "amount")


def deadlines(entries: DataFrame, as_of: date | str, days: int = 30) -> DataFrame:
    """Due within ``days`` days ('upcoming') or past and unpaid ('overdue')."""
    day = as_date(as_of)
    due = F.col("due_date")
    kind = F.when((due >= day) & (due <= F.date_add(day, days)), "upcoming").when(
        (due < day) & (F.col("status") != "paid"), "overdue"
    )
    return entries.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn(
        "days_overdue", F.when(F.col("kind") == "overdue", F.datediff(day, due))
    )


def mark_paid(entries: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply payments (id, payment_date); returns the entries and the unknown ids."""
    joined = entries.join(payments, "id", "left")
    updated = joined.withColumn(
        "status", F.when(F.col("payment_date").isNotNull(), "paid").otherwise(F.col("status"))
    )
    return updated, payments.join(entries, "id", "left_anti")
