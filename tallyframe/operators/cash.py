"""Cash flow: totals, calendar summaries, periods and running balance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import inflow, outflow, total
from tallyframe.functions.periods import as_date
from tallyframe.operators.running import running_total

PERIODS = ("today", "week", "month", "year")


def flows() -> list[Column]:
    amount = F.coalesce(F.col("amount"), F.lit(0).cast("decimal(18,2)"))
    return [
        total(inflow(amount)).alias("inflow"),
        total(outflow(amount)).alias("outflow"),
        total(amount).alias("net"),
        F.count("*").alias("txn_count"),
    ]


def cash_totals(df: DataFrame, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Inflow, outflow, net and count; rows of amount 0 or NULL count as rows."""
    return df.groupBy(*keys).agg(*flows())


def cash_daily(df: DataFrame, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Per day flows; a missing date falls under 'unknown'."""
    day = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("unknown")).alias("day")
    return df.groupBy(*keys, day).agg(*flows())


def cash_calendar(df: DataFrame, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Day, week, month and overall summaries from one scan.

    Rows are first summed per day, so the grouping-set expansion multiplies days,
    not transactions.
    """
    daily = df.groupBy(*keys, "date").agg(*flows())
    parts = daily.withColumn("week", F.date_trunc("week", "date").cast("date")).withColumn(
        "month", F.date_format("date", "yyyy-MM")
    )
    k = [F.col(c) for c in keys]
    sets = parts.groupingSets(
        [[*k, F.col("date")], [*k, F.col("week")], [*k, F.col("month")], k],
        *k, F.col("date"), F.col("week"), F.col("month"),
    ).agg(
        F.grouping("date").alias("_gd"), F.grouping("week").alias("_gw"), F.grouping("month").alias("_gm"),
        *[F.sum(c).alias(c) for c in ("inflow", "outflow", "net", "txn_count")],
    )
    grain = (
        F.when(F.col("_gd") == 0, "day").when(F.col("_gw") == 0, "week").when(F.col("_gm") == 0, "month")
        .otherwise("all")
    )
    bucket = (
        F.when(F.col("_gd") == 0, F.date_format("date", "yyyy-MM-dd"))
        .when(F.col("_gw") == 0, F.date_format("week", "yyyy-MM-dd"))
        .when(F.col("_gm") == 0, F.col("month"))
    )
    return sets.select(
        *keys, grain.alias("grain"), bucket.alias("bucket"), "inflow", "outflow", "net", "txn_count"
    )


def period_bounds(period: str, as_of: date | str) -> tuple[Column, Column]:
    day = as_date(as_of)
    if period == "today":
        return day, day
    if period == "week":
        start = F.date_trunc("week", day).cast("date")
        return start, F.date_add(start, 6)
    if period == "month":
        return F.trunc(day, "month"), F.last_day(day)
    if period == "year":
        start = F.trunc(day, "year")
        return start, F.date_sub(F.add_months(start, 12), 1)
    raise ValueError(f"invalid period: {period}")


def cash_between(df: DataFrame, start: date | str | Column, end: date | str | Column) -> DataFrame:
    return cash_totals(df.where(F.col("date").between(as_date(start), as_date(end))))


def cash_period(df: DataFrame, period: str, as_of: date | str) -> DataFrame:
    """Totals of the day, week, month or year that holds ``as_of``."""
    return cash_between(df, *period_bounds(period, as_of))


def cash_periods(
    df: DataFrame, as_of: date | str, ranges: dict[str, tuple[date | str, date | str]] | None = None,
    keys: tuple[str, ...] = ("tenant",),
) -> DataFrame:
    """Totals of the day, week, month and year of ``as_of`` and of named date ranges.

    Days are summed once; a day then counts for every period that holds it, so the
    rows are read and shuffled once however many periods are asked for.
    """
    bounds = {p: period_bounds(p, as_of) for p in PERIODS}
    bounds |= {name: (as_date(a), as_date(b)) for name, (a, b) in (ranges or {}).items()}
    inside = F.array_compact(F.array(*[F.when(F.col("date").between(a, b), F.lit(p)) for p, (a, b) in bounds.items()]))
    daily = df.groupBy(*keys, "date").agg(*flows())
    return daily.select("*", F.explode(inside).alias("period")).groupBy("period", *keys).agg(
        *[F.sum(c).alias(c) for c in ("inflow", "outflow", "net", "txn_count")]
    )


def running_cash(df: DataFrame, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Balance after each day; the window scans days, never raw rows."""
    daily = df.groupBy(*keys, "date").agg(total(F.col("amount")).alias("net"))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("balance", F.sum("net").over(w))


def running_cash_rows(df: DataFrame, keys: tuple[str, ...] = ("tenant",), ranges: int | None = None) -> DataFrame:
    """Balance after each transaction in the order (date, txn_id).

    Rows that share date, id and amount are interchangeable.
    """
    return running_total(df, list(keys), ["date", "txn_id", "amount"], F.col("amount"), "balance", ranges=ranges)


def debt_totals(df: DataFrame, keys: tuple[str, ...] = ("tenant",)) -> DataFrame:
    """Payments and proceeds of rows whose description names a loan or debt."""
    hit = df.where(F.lower("description").rlike("loan|debt"))
    return hit.groupBy(*keys).agg(
        total(outflow(F.col("amount"))).alias("debt_payments"),
        total(inflow(F.col("amount"))).alias("loan_proceeds"),
        F.count("*").alias("txn_count"),
    )


def summary_by_category(df: DataFrame, keys: tuple[str, ...] = ("tenant",), default: str = "General") -> DataFrame:
    """Sums per category and over all categories (category '*')."""
    per = (
        df.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(default)))
        .groupBy(*keys, "category")
        .agg(*flows())
    )
    k = [F.col(c) for c in keys]
    return (
        per.groupingSets([[*k, F.col("category")], k], *k, F.col("category"))
        .agg(
            F.grouping("category").alias("_g"),
            *[F.sum(c).alias(c) for c in ("inflow", "outflow", "net", "txn_count")],
        )
        .select(
            *keys, F.when(F.col("_g") == 1, "*").otherwise(F.col("category")).alias("category"),
            "inflow", "outflow", "net", "txn_count",
        )
    )


def category_map(df: DataFrame, keys: tuple[str, ...] = ("tenant",), default: str = "General") -> DataFrame:
    """The job-result form: one row per key with a map of category totals."""
    per = summary_by_category(df, keys, default).where(F.col("category") != "*")
    entries = F.sort_array(F.collect_list(F.struct("category", "net")))
    return per.groupBy(*keys).agg(
        F.map_from_entries(entries).alias("totals_by_category"),
        *[F.sum(c).alias(c) for c in ("inflow", "outflow", "net", "txn_count")],
    )
