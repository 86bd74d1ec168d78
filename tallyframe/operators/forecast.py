"""Forecasts, trends and seasonality, all from one per-day aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import dbl, inflow, outflow, rounded, total
from tallyframe.functions.periods import month_key, week_key, week_number
from tallyframe.operators import trend

HORIZONS = {
    "short": {"days": 30, "steps": 30, "floor": 0.6, "decay": 0.01},
    "medium": {"days": 90, "steps": 13, "floor": 0.4, "decay": 0.05},
    "long": {"days": 365, "steps": 13, "floor": 0.2, "decay": 0.1},
}


def date_parts(df: DataFrame) -> DataFrame:
    """Type, month, year, quarter and week columns of each transaction."""
    day = F.col("date")
    return df.select(
        "*",
        F.when(F.col("amount") > 0, "income").otherwise("expense").alias("type"),
        month_key(day).alias("month"), F.year(day).alias("year"), F.quarter(day).alias("quarter"),
        week_number(day).alias("week"),
    )


def daily_base(df: DataFrame, *extra: str) -> DataFrame:
    """Sums per tenant and day (and extra keys); everything else reads this."""
    amount = F.col("amount")
    return df.where(amount.isNotNull() & (amount != 0)).groupBy("tenant", *extra, "date").agg(
        total(inflow(amount)).alias("income"), total(outflow(amount)).alias("expense"), total(amount).alias("net"),
        total(F.abs(amount)).alias("size"), F.count("*").alias("n"), F.count(F.when(amount > 0, 1)).alias("n_income"),
    )


def bucket_of(horizon: str) -> Column:
    if horizon == "short":
        return F.date_format("date", "yyyy-MM-dd")
    return week_key(F.col("date")) if horizon == "medium" else month_key(F.col("date"))


def bucket_cash(daily: DataFrame, horizon: str) -> DataFrame:
    """Flows per bucket inside the look-back window that ends on the tenant's last day."""
    days = HORIZONS[horizon]["days"]
    anchor = daily.groupBy("tenant").agg(F.max("date").alias("anchor"))
    recent = daily.join(anchor, "tenant").where(F.col("date") >= F.date_sub("anchor", days))
    return recent.groupBy("tenant", "anchor", bucket_of(horizon).alias("bucket")).agg(
        *[F.sum(c).alias(c) for c in ("income", "expense", "net", "n")]
    )


def horizon_stats(daily: DataFrame, horizon: str) -> DataFrame:
    return trend.last_two(bucket_cash(daily, horizon), ["tenant", "anchor"], "bucket", ["income", "expense", "net"])


def horizon_forecast(daily: DataFrame, horizon: str) -> DataFrame:
    """Forecast rows: mean moved by the trend, confidence falling with the step."""
    h = HORIZONS[horizon]
    steps, i = h["steps"], F.col("step")
    if horizon == "short":
        label = F.date_format(F.date_add("anchor", i), "yyyy-MM-dd")
    elif horizon == "medium":
        label = week_key(F.date_add("anchor", i * 7))
    else:
        label = month_key(F.add_months(F.trunc("anchor", "month"), i))

    def moved(v: str) -> Column:
        return F.col(f"avg_{v}") * (1 + F.col(f"{v}_trend") / 100 * (i / F.lit(float(steps))))

    rows = horizon_stats(daily, horizon).select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return rows.select(
        "tenant", "step", label.alias("bucket"), rounded(moved("income"), 4).alias("income"),
        rounded(moved("expense"), 4).alias("expense"), rounded(moved("income") - moved("expense"), 4).alias("net"),
        rounded(F.greatest(F.lit(h["floor"]), 1 - i * h["decay"]), 4).alias("confidence"),
    )


def overall_averages(daily: DataFrame) -> DataFrame:
    """Mean income, expense and net per day, week and month over all history."""
    parts = []
    for grain, key in (("day", "date"), ("week", week_key(F.col("date"))), ("month", month_key(F.col("date")))):
        per = daily.groupBy("tenant", (F.col(key) if isinstance(key, str) else key).alias("b")).agg(
            *[F.sum(c).alias(c) for c in ("income", "expense", "net")]
        )
        parts.append(
            per.groupBy("tenant").agg(
                F.lit(grain).alias("grain"),
                *[rounded(dbl(F.sum(c)) / F.count("*"), 4).alias(f"avg_{c}") for c in ("income", "expense", "net")],
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def seasonality(daily: DataFrame) -> DataFrame:
    """Mean absolute amount per month of year, quarter and weekday (Sunday = 0)."""
    parts = daily.select(
        "tenant", "size", "n", F.month("date").alias("m"), F.quarter("date").alias("q"),
        (F.dayofweek("date") - 1).alias("w"),
    )
    t, m, q, w = (F.col(c) for c in ("tenant", "m", "q", "w"))
    sets = parts.groupingSets([[t, m], [t, q], [t, w]], t, m, q, w).agg(
        F.grouping("m").alias("_gm"), F.grouping("q").alias("_gq"), (dbl(F.sum("size")) / F.sum("n")).alias("_a")
    )
    grain = F.when(F.col("_gm") == 0, "month").when(F.col("_gq") == 0, "quarter").otherwise("weekday")
    return sets.select("tenant", grain.alias("grain"), F.coalesce("m", "q", "w").alias("slot"), rounded("_a", 4).alias("mean_size"))


def category_months(df: DataFrame) -> DataFrame:
    amount = F.col("amount")
    return df.where(amount.isNotNull() & (amount != 0)).groupBy("tenant", "category", month_key(F.col("date")).alias("month")).agg(
        total(inflow(amount)).alias("income"), total(outflow(amount)).alias("expense"), total(amount).alias("net"),
        total(F.abs(amount)).alias("size"), F.count(F.when(amount > 0, 1)).alias("n_income"),
        F.count(F.when(amount < 0, 1)).alias("n_expense"),
    )


def trend_family(months: DataFrame) -> DataFrame:
    """Trend of the overall, income, expense and per-category monthly series."""
    series = months.select(
        "tenant", "month",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("overall").alias("series"), F.col("net").alias("v")),
                    F.when(F.col("n_income") > 0, F.struct(F.lit("income").alias("series"), F.col("income").alias("v"))),
                    F.when(F.col("n_expense") > 0, F.struct(F.lit("expense").alias("series"), F.col("expense").alias("v"))),
                    F.struct(F.concat(F.lit("category:"), "category").alias("series"), F.col("size").alias("v")),
                )
            )
        ).alias("s"),
    ).groupBy("tenant", F.col("s.series").alias("series"), "month").agg(F.sum("s.v").alias("value"))
    out = trend.last_two(series, ["tenant", "series"], "month", ["value"])
    return out.select("tenant", "series", "buckets", F.col("value_trend").alias("trend_pct"), F.col("value_direction").alias("direction"))


def category_forecast(months: DataFrame) -> DataFrame:
    """Mean month moved by its trend; confidence falls with more history."""
    out = trend.last_two(months.select("tenant", "category", "month", "size"), ["tenant", "category"], "month", ["size"])
    return out.select(
        "tenant", "category", "buckets", rounded("avg_size", 4).alias("average"), F.col("size_trend").alias("trend_pct"),
        rounded(F.col("avg_size") * (1 + F.col("size_trend") / 100), 4).alias("forecast"),
        rounded(F.greatest(F.lit(0.3), 1 - F.col("buckets") * 0.05), 4).alias("confidence"),
    )
