"""Budget reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.constants import DEFAULT_BUDGETS
from tallyframe.operators import budget, trend
from tallyframe.plans.registry import report
from tallyframe.session import fresh_dir
from tallyframe.sources import sinks
from tallyframe.sources.adapters import TXN, transactions

AS_OF = "1998-08-15"
SPEND = f"""{TXN}, spend AS (SELECT tenant, category, strftime(date, '%Y-%m') AS month, sum(-amount) AS actual, count(*) AS txn_count
  FROM txn WHERE amount < 0 GROUP BY ALL)"""
PLAN = "plan(category, monthly, yearly, priority) AS (VALUES " + ", ".join(
    f"('{c}', CAST({m} AS DECIMAL(18,2)), CAST({y} AS DECIMAL(18,2)), '{p}')" for c, m, y, p in DEFAULT_BUDGETS
) + ")"
REF = "ref AS (SELECT tenant, max(month) AS month FROM spend GROUP BY tenant)"
STATUS = "CASE WHEN {u} >= 0.95 THEN 'critical' WHEN {u} >= 0.8 THEN 'warning' WHEN {u} <= 0.5 THEN 'underutilized' ELSE 'healthy' END"
JOINED = f"""{SPEND}, {PLAN}, {REF}, act AS (SELECT tenant, category, sum(actual) AS actual FROM spend JOIN ref USING (tenant, month) GROUP BY ALL),
 joined AS (SELECT t.tenant, p.category, p.monthly, p.yearly, p.priority, coalesce(a.actual, 0) AS actual
   FROM (SELECT DISTINCT tenant FROM spend) t CROSS JOIN plan p LEFT JOIN act a ON a.tenant = t.tenant AND a.category = p.category)"""
PERF = """SELECT tenant, category, CAST(monthly AS DOUBLE) AS monthly, CAST(yearly AS DOUBLE) AS yearly, priority, CAST(actual AS DOUBLE) AS actual,
   CAST(actual - monthly AS DOUBLE) AS variance, round(CAST(actual - monthly AS DOUBLE) / CAST(monthly AS DOUBLE) * 100, 6) AS variance_pct,
   round(CAST(actual AS DOUBLE) / CAST(monthly AS DOUBLE), 6) AS utilisation, """ + STATUS.format(u="CAST(actual AS DOUBLE) / CAST(monthly AS DOUBLE)") + " AS status"
OVERALL = f"""{JOINED}, tot AS (SELECT b.tenant, a.month, b.budget, a.actual FROM (SELECT tenant, sum(monthly) AS budget FROM joined GROUP BY tenant) b
   JOIN (SELECT tenant, month, sum(actual) AS actual FROM spend JOIN ref USING (tenant, month) GROUP BY ALL) a USING (tenant)),
 ov AS (SELECT tenant, month, CAST(budget AS DOUBLE) AS budget, CAST(actual AS DOUBLE) AS actual, CAST(actual - budget AS DOUBLE) AS variance,
   round(CAST(actual - budget AS DOUBLE) / CAST(budget AS DOUBLE) * 100, 6) AS variance_pct,
   round(CAST(actual AS DOUBLE) / CAST(budget AS DOUBLE), 6) AS utilisation, {STATUS.format(u='CAST(actual AS DOUBLE) / CAST(budget AS DOUBLE)')} AS status FROM tot)"""


def spend(spark, d):
    return budget.actuals(transactions(spark, d, "tenant", "category", "date", "amount"))


@report("jn_budget_actual", f"""WITH {JOINED} SELECT tenant, category, CAST(monthly AS DOUBLE) AS monthly, CAST(yearly AS DOUBLE) AS yearly,
  priority, CAST(actual AS DOUBLE) AS actual FROM joined""")
def jn_budget_actual(spark, d):
    return budget.budget_actual(spend(spark, d))


@report("dj_budget", f"WITH {JOINED} {PERF} FROM joined")
def dj_budget(spark, d):
    return budget.performance(budget.budget_actual(spend(spark, d)))


@report("fn_budget_status", f"WITH {OVERALL} SELECT * FROM ov")
def fn_budget_status(spark, d):
    s = spend(spark, d)
    return budget.overall(s, budget.tenant_budgets(s))


@report(
    "dj_budget_summary",
    f"""WITH {SPEND}, {PLAN}, a AS (SELECT tenant, category, sum(actual) AS actual FROM spend WHERE month = '1998-03' GROUP BY ALL)
    SELECT t.tenant, p.category, CAST(monthly AS DOUBLE) AS monthly, CAST(coalesce(actual, 0) AS DOUBLE) AS actual,
      CAST(coalesce(actual, 0) - monthly AS DOUBLE) AS variance
    FROM (SELECT DISTINCT tenant FROM spend) t CROSS JOIN plan p LEFT JOIN a ON a.tenant = t.tenant AND a.category = p.category""",
)
def dj_budget_summary(spark, d):
    rows = budget.performance(budget.budget_actual(spend(spark, d), month="1998-03"))
    return rows.select("tenant", "category", "monthly", "actual", "variance")


@report(
    "ag_budget_category",
    f"""WITH {SPEND} SELECT tenant, category, CAST(sum(actual) AS DOUBLE) AS total, CAST(sum(txn_count) AS BIGINT) AS n, count(*) AS months,
      round(CAST(sum(actual) AS DOUBLE) / sum(txn_count), 4) AS average FROM spend GROUP BY ALL""",
)
def ag_budget_category(spark, d):
    return budget.category_performance(spend(spark, d))


@report(
    "ag_budget_month",
    f"""WITH {SPEND}, cur AS (SELECT * FROM spend WHERE month[1:4] = '1998'), months AS (SELECT tenant, month, sum(actual) AS total FROM cur GROUP BY ALL),
    st AS (SELECT * FROM {trend.sql_last_two('months', 'tenant', 'month', ['total'])})
    SELECT tenant, month, category, CAST(actual AS DOUBLE) AS actual, CAST(NULL AS DOUBLE) AS average_month, CAST(NULL AS DOUBLE) AS total_trend,
      CAST(NULL AS VARCHAR) AS total_direction FROM cur
    UNION ALL SELECT m.tenant, m.month, '*', CAST(m.total AS DOUBLE), round(avg_total, 4), total_trend, total_direction FROM months m JOIN st USING (tenant)""",
)
def ag_budget_month(spark, d):
    return budget.monthly_performance(spend(spark, d), AS_OF)


@report(
    "dj_budget_forecast",
    f"""WITH {SPEND}, slots AS (SELECT strftime(DATE '1998-08-01' - INTERVAL (i) MONTH, '%Y-%m') AS month FROM range(1, 7) r(i)),
    grid AS (SELECT t.tenant, s.month, coalesce(sum(p.actual), 0) AS total FROM (SELECT DISTINCT tenant FROM spend) t CROSS JOIN slots s
      LEFT JOIN spend p ON p.tenant = t.tenant AND p.month = s.month GROUP BY t.tenant, s.month)
    SELECT tenant, strftime(DATE '1998-08-01' + INTERVAL (i) MONTH, '%Y-%m') AS month, round(avg_total, 4) AS average, total_trend AS trend_pct,
      round(avg_total * (1 + total_trend / 100 * i), 4) AS forecast, CAST(greatest(0.5, 1 - i * 0.1) AS DOUBLE) AS confidence
    FROM {trend.sql_last_two('grid', 'tenant', 'month', ['total'])}, range(1, 4) r(i)""",
)
def dj_budget_forecast(spark, d):
    return budget.spending_forecast(spend(spark, d), AS_OF)


def _budget_table(spark, d):
    """A budget table drawn from all past spending: the spend of each tenant, category and month."""
    return spend(spark, d).select(
        "tenant", "category", "month", F.col("actual").cast("decimal(18,2)").alias("monthly"),
        F.lit("medium").alias("priority"),
    )


def _changes(spark, d):
    return spend(spark, d).where("month >= '1998-07'").select(
        "tenant", "category", "month", F.col("txn_count").cast("decimal(18,2)").alias("monthly"),
        F.lit("high").alias("priority"),
    )


@report(
    "so_upsert_budget",
    f"""WITH {SPEND} SELECT tenant, category, month, CAST(CASE WHEN month >= '1998-07' THEN txn_count ELSE actual END AS DOUBLE) AS monthly,
      CASE WHEN month >= '1998-07' THEN 'high' ELSE 'medium' END AS priority FROM spend""",
)
def so_upsert_budget(spark, d):
    """A budget table by month, into which the changes are merged: months without changes are not written again."""
    path, keys = fresh_dir(spark, "budgets"), ["tenant", "category", "month"]
    sinks.merge_rows(_budget_table(spark, d), path, keys, ["month"])
    changes = _changes(spark, d)
    sinks.merge_rows(changes, path, keys, ["month"])
    return spark.read.schema(changes.schema).parquet(path)


@report(
    "so_update_budget",
    f"""WITH {SPEND} SELECT tenant, category, month, CAST(CASE WHEN month >= '1998-07' THEN txn_count ELSE actual END AS DOUBLE) AS monthly,
      'medium' AS priority FROM spend""",
)
def so_update_budget(spark, d):
    return budget.update_budgets(_budget_table(spark, d), _changes(spark, d).drop("priority"))
