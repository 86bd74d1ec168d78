"""Budgets against actual spending."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.constants import DEFAULT_BUDGETS
from tallyframe.functions.money import dbl, percent_or_zero, ratio_or_zero, rounded, total
from tallyframe.functions.periods import as_date
from tallyframe.operators import trend

MONEY = "decimal(18,2)"


def default_budgets(spark: SparkSession) -> DataFrame:
    """The eight default budgets: literal rows, always safe to broadcast."""
    rows = [(c, float(m), float(y), p) for c, m, y, p in DEFAULT_BUDGETS]
    return spark.createDataFrame(rows, "category string, monthly double, yearly double, priority string").select(
        "category", F.col("monthly").cast(MONEY).alias("monthly"), F.col("yearly").cast(MONEY).alias("yearly"), "priority"
    )


def budget_status(utilisation: Column) -> Column:
    return (
        F.when(utilisation >= 0.95, "critical").when(utilisation >= 0.8, "warning")
        .when(utilisation <= 0.5, "underutilized").otherwise("healthy")
    )


def actuals(df: DataFrame) -> DataFrame:
    """Spending per tenant, category and month: the only pass over raw rows that
    the budget family makes."""
    spent = df.where(F.col("amount") < 0)
    return spent.groupBy(
        "tenant", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Other")).alias("category"),
        F.date_format("date", "yyyy-MM").alias("month"),
    ).agg(total(-F.col("amount")).alias("actual"), F.count("*").alias("txn_count"))


def reference_month(spend: DataFrame) -> DataFrame:
    """Latest month with spending per tenant."""
    return spend.groupBy("tenant").agg(F.max("month").alias("month"))


def tenant_budgets(spend: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """Budget rows per tenant; without a budget table every tenant gets the defaults.

    The defaults are exploded from a literal array on the distinct tenants.
    """
    if budgets is not None:
        return budgets
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("category"), F.lit(m).cast(MONEY).alias("monthly"), F.lit(y).cast(MONEY).alias("yearly"),
            F.lit(p).alias("priority"),
        )
        for c, m, y, p in DEFAULT_BUDGETS
    ])
    return spend.select("tenant").distinct().select("tenant", F.inline(rows))


def budget_actual(spend: DataFrame, budgets: DataFrame | None = None, month: str | None = None) -> DataFrame:
    """Budgets LEFT JOIN actual of the reference month (or a given month)."""
    plan = tenant_budgets(spend, budgets)
    if month is None:
        chosen = spend.join(reference_month(spend), ["tenant", "month"], "left_semi")
    else:
        chosen = spend.where(F.col("month") == month)
    per = chosen.groupBy("tenant", "category").agg(F.sum("actual").alias("actual"))
    return plan.join(per, ["tenant", "category"], "left").withColumn(
        "actual", F.coalesce("actual", F.lit(0)).cast("decimal(28,2)")
    )


def performance(joined: DataFrame) -> DataFrame:
    """Variance, utilisation and status per budget row."""
    budget, actual = F.col("monthly"), F.col("actual")
    return (
        joined.withColumn("variance", actual - budget)
        .withColumn("variance_pct", percent_or_zero(F.col("variance"), budget))
        .withColumn("utilisation", ratio_or_zero(actual, budget))
        .withColumn("status", budget_status(F.when(budget > 0, dbl(actual) / dbl(budget)).otherwise(F.lit(0.0))))
    )


def overall(spend: DataFrame, joined: DataFrame) -> DataFrame:
    """Totals per tenant for the reference month: all spending against all budgets."""
    budget = joined.groupBy("tenant").agg(F.sum("monthly").alias("budget"))
    actual = (
        spend.join(reference_month(spend), ["tenant", "month"], "left_semi")
        .groupBy("tenant", "month").agg(F.sum("actual").alias("actual"))
    )
    both = budget.join(actual, "tenant")
    b, a = F.col("budget"), F.col("actual")
    return (
        both.withColumn("variance", a - b)
        .withColumn("variance_pct", percent_or_zero(a - b, b))
        .withColumn("utilisation", ratio_or_zero(a, b))
        .withColumn("status", budget_status(F.when(b > 0, dbl(a) / dbl(b)).otherwise(F.lit(0.0))))
    )


def category_performance(spend: DataFrame) -> DataFrame:
    """Total, count, mean and number of months per category."""
    return spend.groupBy("tenant", "category").agg(
        F.sum("actual").alias("total"), F.sum("txn_count").alias("n"),
        (dbl(F.sum("actual")) / F.sum("txn_count")).alias("_avg"), F.count("*").alias("months"),
    ).withColumn("average", rounded("_avg", 4)).drop("_avg")


def monthly_performance(spend: DataFrame, as_of: date | str) -> DataFrame:
    """Per month of the year of ``as_of``: category amounts and the month total ('*'),
    with the tenant's mean month and trend on the total rows."""
    year = F.date_format(as_date(as_of), "yyyy")
    current = spend.where(F.substring("month", 1, 4) == year)
    k, m = F.col("tenant"), F.col("month")
    both = current.groupingSets([[k, m, F.col("category")], [k, m]], k, m, F.col("category")).agg(
        F.grouping("category").alias("_g"), F.sum("actual").alias("actual")
    )
    months = current.groupBy("tenant", "month").agg(F.sum("actual").alias("total"))
    stats = trend.last_two(months, ["tenant"], "month", ["total"]).select(
        "tenant", rounded("avg_total", 4).alias("average_month"), "total_trend", "total_direction"
    )
    is_total = F.col("_g") == 1
    return both.join(stats, "tenant").select(
        "tenant", "month", F.when(is_total, "*").otherwise(F.col("category")).alias("category"), "actual",
        *[F.when(is_total, F.col(c)).alias(c) for c in ("average_month", "total_trend", "total_direction")],
    )


def spending_forecast(spend: DataFrame, as_of: date | str, months: int = 3, history: int = 6) -> DataFrame:
    """Mean of the last ``history`` months (empty months count as 0), moved by the
    trend of the last two."""
    start = F.trunc(as_date(as_of), "month")
    slots = F.transform(F.sequence(F.lit(-history), F.lit(-1)), lambda i: F.date_format(F.add_months(start, i), "yyyy-MM"))
    grid = spend.select("tenant").distinct().select("tenant", F.explode(slots).alias("month"))
    per = spend.groupBy("tenant", "month").agg(F.sum("actual").alias("actual"))
    filled = grid.join(per, ["tenant", "month"], "left").withColumn(
        "total", F.coalesce("actual", F.lit(0)).cast("decimal(28,2)")
    )
    stats = trend.last_two(filled.select("tenant", "month", "total"), ["tenant"], "month", ["total"])
    i = F.col("step")
    return stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("step")).select(
        "tenant", F.date_format(F.add_months(start, i), "yyyy-MM").alias("month"),
        rounded("avg_total", 4).alias("average"), F.col("total_trend").alias("trend_pct"),
        rounded(F.col("avg_total") * (1 + F.col("total_trend") / 100 * i), 4).alias("forecast"),
        rounded(F.greatest(F.lit(0.5), 1 - i * 0.1), 4).alias("confidence"),
    )


def upsert_budgets(budgets: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace rows of the same tenant, category and month, then append."""
    kept = budgets.join(changes, ["tenant", "category", "month"], "left_anti")
    return kept.unionByName(changes.select(*budgets.columns))


def update_budgets(budgets: DataFrame, changes: DataFrame) -> DataFrame:
    """Change fields that are given; rows without a change stay as they are."""
    fields = [c for c in changes.columns if c not in ("tenant", "category", "month")]
    renamed = changes.select("tenant", "category", "month", *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = budgets.join(renamed, ["tenant", "category", "month"], "left")
    return joined.select(
        *[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in budgets.columns]
    )
