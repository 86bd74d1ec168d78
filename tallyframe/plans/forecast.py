"""Forecast reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.money import rounded
from tallyframe.operators import forecast, trend
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, transactions


def week_number_sql(c):
    first = f"date_trunc('year', {c})"
    return f"CAST(ceil((dayofyear({c}) - 1 + dayofweek({first}) + 1) / 7.0) AS INTEGER)"


def week_key_sql(c):
    return f"strftime({c}, '%Y') || '-W' || lpad(CAST({week_number_sql(c)} AS VARCHAR), 2, '0')"


DAILY = f"""{TXN}, daily AS (SELECT tenant, date, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS income,
  sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS expense, sum(amount) AS net, sum(abs(amount)) AS size, count(*) AS n
  FROM txn WHERE amount <> 0 GROUP BY tenant, date)"""
BUCKETS = {"short": "CAST(date AS VARCHAR)", "medium": week_key_sql("date"), "long": "strftime(date, '%Y-%m')"}
LABELS = {
    "short": "CAST(anchor + CAST(i AS INTEGER) AS VARCHAR)",
    "medium": week_key_sql("(anchor + CAST(i * 7 AS INTEGER))"),
    "long": "strftime(date_trunc('month', anchor) + INTERVAL (i) MONTH, '%Y-%m')",
}


def bucket_sql(h):
    return f"""{DAILY}, anc AS (SELECT tenant, max(date) AS anchor FROM daily GROUP BY tenant),
    bk AS (SELECT tenant, anchor, {BUCKETS[h]} AS bucket, sum(income) AS income, sum(expense) AS expense, sum(net) AS net, CAST(sum(n) AS BIGINT) AS n
      FROM daily JOIN anc USING (tenant) WHERE date >= anchor - {forecast.HORIZONS[h]['days']} GROUP BY ALL)"""


def horizon_sql(h):
    p = forecast.HORIZONS[h]
    inc = f"avg_income * (1 + income_trend / 100 * (CAST(i AS DOUBLE) / {float(p['steps'])}))"
    exp = f"avg_expense * (1 + expense_trend / 100 * (CAST(i AS DOUBLE) / {float(p['steps'])}))"
    return f"""WITH {bucket_sql(h)} SELECT tenant, i AS step, {LABELS[h]} AS bucket, round({inc}, 4) AS income, round({exp}, 4) AS expense,
      round({inc} - {exp}, 4) AS net, CAST(greatest({p['floor']}, 1 - i * {p['decay']}) AS DOUBLE) AS confidence
    FROM {trend.sql_last_two('bk', 'tenant, anchor', 'bucket', ['income', 'expense', 'net'])}, range(1, {p['steps'] + 1}) r(i)"""


def daily(spark, d):
    return forecast.daily_base(transactions(spark, d, "tenant", "date", "amount"))


for _h in forecast.HORIZONS:
    report(f"dj_forecast_{_h}", horizon_sql(_h))(
        lambda spark, d, h=_h: forecast.horizon_forecast(daily(spark, d), h)
    )


@report(
    "ag_bucket_cash",
    " UNION ALL ".join(
        f"(WITH {bucket_sql(h)} SELECT '{h}' AS horizon, tenant, CAST(anchor AS VARCHAR) AS anchor, bucket, CAST(income AS DOUBLE) AS income,"
        f" CAST(expense AS DOUBLE) AS expense, CAST(net AS DOUBLE) AS net, n FROM bk)"
        for h in forecast.HORIZONS
    ),
)
def ag_bucket_cash(spark, d):
    base = daily(spark, d)
    parts = [forecast.bucket_cash(base, h).select(F.lit(h).alias("horizon"), "*") for h in forecast.HORIZONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _avg(grain, key):
    return f"""SELECT tenant, '{grain}' AS grain, round(CAST(sum(income) AS DOUBLE) / count(*), 4) AS avg_income,
      round(CAST(sum(expense) AS DOUBLE) / count(*), 4) AS avg_expense, round(CAST(sum(net) AS DOUBLE) / count(*), 4) AS avg_net
      FROM (SELECT tenant, {key} AS b, sum(income) AS income, sum(expense) AS expense, sum(net) AS net FROM daily GROUP BY ALL) GROUP BY tenant"""


@report(
    "ag_overall_avgs",
    f"WITH {DAILY} {_avg('day', 'date')} UNION ALL {_avg('week', week_key_sql('date'))} UNION ALL {_avg('month', BUCKETS['long'])}",
)
def ag_overall_avgs(spark, d):
    return forecast.overall_averages(daily(spark, d))


def _season(grain, key):
    return f"SELECT tenant, '{grain}' AS grain, {key} AS slot, round(CAST(sum(size) AS DOUBLE) / sum(n), 4) AS mean_size FROM daily GROUP BY ALL"


@report(
    "ag_season",
    f"WITH {DAILY} {_season('month', 'month(date)')} UNION ALL {_season('quarter', 'quarter(date)')} UNION ALL {_season('weekday', 'dayofweek(date)')}",
)
def ag_season(spark, d):
    return forecast.seasonality(daily(spark, d))


MONTHS = f"""{TXN}, cm AS (SELECT tenant, category, strftime(date, '%Y-%m') AS month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS income,
  sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS expense, sum(amount) AS net, sum(abs(amount)) AS size,
  count(*) FILTER (amount > 0) AS n_income, count(*) FILTER (amount < 0) AS n_expense FROM txn WHERE amount <> 0 GROUP BY ALL)"""


def months(spark, d):
    return forecast.category_months(transactions(spark, d, "tenant", "category", "date", "amount"))


@report(
    "wn_trend_family",
    f"""WITH {MONTHS}, ser AS (SELECT tenant, series, month, sum(v) AS value FROM (
      SELECT tenant, month, 'overall' AS series, net AS v FROM cm UNION ALL SELECT tenant, month, 'income', income FROM cm WHERE n_income > 0
      UNION ALL SELECT tenant, month, 'expense', expense FROM cm WHERE n_expense > 0 UNION ALL SELECT tenant, month, 'category:' || category, size FROM cm)
      GROUP BY ALL)
    SELECT tenant, series, buckets, value_trend AS trend_pct, value_direction AS direction FROM {trend.sql_last_two('ser', 'tenant, series', 'month', ['value'])}""",
)
def wn_trend_family(spark, d):
    return forecast.trend_family(months(spark, d))


@report(
    "wn_trend_last2",
    f"""WITH {DAILY}, m AS (SELECT tenant, strftime(date, '%Y-%m') AS month, sum(net) AS net FROM daily GROUP BY ALL)
    SELECT tenant, buckets, net_trend, net_direction, round(avg_net, 4) AS avg_net FROM {trend.sql_last_two('m', 'tenant', 'month', ['net'])}""",
)
def wn_trend_last2(spark, d):
    per = daily(spark, d).groupBy("tenant", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("net").alias("net"))
    return trend.last_two(per, ["tenant"], "month", ["net"]).withColumn("avg_net", rounded("avg_net", 4))


@report(
    "dj_forecast_category",
    f"""WITH {MONTHS} SELECT tenant, category, buckets, round(avg_size, 4) AS average, size_trend AS trend_pct,
      round(avg_size * (1 + size_trend / 100), 4) AS forecast, CAST(greatest(0.3, 1 - buckets * 0.05) AS DOUBLE) AS confidence
    FROM {trend.sql_last_two('cm', 'tenant, category', 'month', ['size'])}""",
)
def dj_forecast_category(spark, d):
    return forecast.category_forecast(months(spark, d))


@report(
    "prj_type_month_parts",
    f"""WITH {TXN} SELECT txn_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS type,
      strftime(date, '%Y-%m') AS month, year(date) AS year, quarter(date) AS quarter, {week_number_sql('date')} AS week FROM txn""",
)
def prj_type_month_parts(spark, d):
    return forecast.date_parts(transactions(spark, d, "txn_id", "date", "amount"))
