"""Statement reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.constants import ASSET_LIABILITY_RULES
from tallyframe.functions.periods import as_date
from tallyframe.functions.rules import sql_first_match
from tallyframe.operators import cash, statements
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, transactions

CONFIDENCE = "CASE WHEN txn_count < 10 THEN 60 WHEN txn_count < 50 THEN 75 WHEN txn_count < 100 THEN 85 ELSE 95 END"
PL = f"""{TXN}, b AS (SELECT tenant, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS revenue,
  sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS cogs, count(*) AS txn_count FROM txn GROUP BY tenant),
 g AS (SELECT *, revenue - cogs AS gross_profit FROM b),
 t AS (SELECT *, CASE WHEN gross_profit > 0 THEN CAST(gross_profit AS DOUBLE) * 0.2 ELSE 0 END AS taxes0 FROM g),
 n AS (SELECT *, round(CAST(gross_profit AS DOUBLE) - taxes0, 4) AS net_income FROM t),
 pl AS (SELECT tenant, CAST(revenue AS DOUBLE) AS revenue, CAST(cogs AS DOUBLE) AS cogs, txn_count, CAST(gross_profit AS DOUBLE) AS gross_profit,
  round(taxes0, 4) AS taxes, net_income,
  CASE WHEN revenue > 0 THEN round(CAST(gross_profit AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 6) ELSE 0 END AS gross_margin,
  CASE WHEN revenue > 0 THEN round(CAST(gross_profit AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 6) ELSE 0 END AS operating_margin,
  CASE WHEN revenue > 0 THEN round(net_income / CAST(revenue AS DOUBLE) * 100, 6) ELSE 0 END AS net_margin,
  CASE WHEN revenue > 0 THEN round((CAST(revenue AS DOUBLE) - net_income) / CAST(revenue AS DOUBLE) * 100, 6) ELSE 0 END AS expense_ratio,
  CAST(CASE WHEN gross_profit > 0 THEN 20.0 ELSE 0.0 END AS DOUBLE) AS tax_rate, {CONFIDENCE} AS confidence FROM n)"""


@report("ag_profit_loss", f"WITH {PL} SELECT * FROM pl")
def ag_profit_loss(spark, d):
    return statements.profit_loss(transactions(spark, d, "tenant", "amount"))


@report(
    "fn_confidence_by_count",
    f"WITH {TXN}, c AS (SELECT tenant, category, count(*) AS txn_count FROM txn GROUP BY ALL) SELECT tenant, category, txn_count, {CONFIDENCE} AS confidence FROM c",
)
def fn_confidence_by_count(spark, d):
    counts = transactions(spark, d, "tenant", "category").groupBy("tenant", "category").agg(
        F.count("*").alias("txn_count")
    )
    return counts.withColumn("confidence", statements.count_confidence(F.col("txn_count")))


BS = f"""{TXN}, b AS (SELECT tenant, sum(amount) AS net,
   sum(CASE WHEN amount < 0 AND category = 'Equipment' THEN -amount ELSE 0 END) AS equipment,
   sum(CASE WHEN amount < 0 AND contains(lower(description), 'furniture') THEN -amount ELSE 0 END) AS furniture,
   sum(CASE WHEN amount < 0 AND category = 'Software' THEN -amount ELSE 0 END) AS computer_software, count(*) AS txn_count
   FROM txn GROUP BY tenant),
 s AS (SELECT *, greatest(net, 0) AS cash, equipment + furniture + computer_software AS fixed_assets FROM b),
 bs AS (SELECT tenant, CAST(equipment AS DOUBLE) AS equipment, CAST(furniture AS DOUBLE) AS furniture,
   CAST(computer_software AS DOUBLE) AS computer_software, txn_count, CAST(cash AS DOUBLE) AS cash, CAST(cash AS DOUBLE) AS retained_earnings,
   CAST(fixed_assets AS DOUBLE) AS fixed_assets, CAST(cash + fixed_assets AS DOUBLE) AS total_assets, CAST(0 AS DOUBLE) AS total_liabilities,
   CAST(cash AS DOUBLE) AS total_equity, abs(fixed_assets) < 0.01 AS balanced,
   CAST(CASE WHEN cash + fixed_assets > 0 THEN NULL ELSE 0.0 END AS DOUBLE) AS current_ratio, CAST(0 AS DOUBLE) AS debt_to_equity, CAST(0 AS DOUBLE) AS debt_to_asset,
   CASE WHEN cash + fixed_assets > 0 THEN round(CAST(cash AS DOUBLE) / CAST(cash + fixed_assets AS DOUBLE), 6) ELSE 0 END AS equity_ratio,
   {CONFIDENCE} AS confidence FROM s)"""


@report("ag_balance_sheet", f"WITH {BS} SELECT * FROM bs")
def ag_balance_sheet(spark, d):
    return statements.balance_sheet(transactions(spark, d, "tenant", "amount", "category", "description"))


def _tail(name, cond):
    return (
        f"{name} AS (SELECT tenant, sum(abs(amount)) AS v FROM (SELECT tenant, amount, row_number() OVER (PARTITION BY tenant "
        f"ORDER BY date DESC, txn_id DESC, amount DESC) AS rn FROM txn WHERE {cond}) WHERE rn <= 30 GROUP BY tenant)"
    )


@report(
    "ag_bs_estimates",
    f"""WITH {TXN}, {_tail('ri', "amount > 0 AND category = 'Income'")},
    {_tail('rs', "amount < 0 AND category IN ('Office', 'Equipment', 'Software')")}, {_tail('re', "amount < 0")},
    w AS (SELECT tenant, CAST(sum(amount) AS DOUBLE) AS net, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS income,
      CAST(sum(CASE WHEN amount < 0 AND category IN ('Rent','Insurance','Software') THEN -amount ELSE 0 END) AS DOUBLE) AS prepaid,
      CAST(sum(CASE WHEN amount < 0 AND category IN ('Rent','Utilities','Professional') THEN -amount ELSE 0 END) AS DOUBLE) AS accrued,
      CAST(sum(CASE WHEN amount < 0 AND category = 'Equipment' THEN -amount ELSE 0 END)
         + sum(CASE WHEN amount < 0 AND contains(lower(description), 'furniture') THEN -amount ELSE 0 END)
         + sum(CASE WHEN amount < 0 AND category = 'Software' THEN -amount ELSE 0 END) AS DOUBLE) AS fixed FROM txn GROUP BY tenant)
    SELECT w.tenant, round(coalesce(CAST(ri.v AS DOUBLE), 0) * 0.2, 4) AS accounts_receivable, round(coalesce(CAST(rs.v AS DOUBLE), 0) * 0.3, 4) AS inventory,
      round(prepaid * 0.5, 4) AS prepaid_expenses, round(fixed * 0.3, 4) AS accumulated_depreciation,
      round(coalesce(CAST(re.v AS DOUBLE), 0) * 0.15, 4) AS accounts_payable, round(accrued * 0.1, 4) AS accrued_expenses,
      round(greatest(net, 0) * 0.2, 4) AS taxes_payable, round(greatest(net, 0) * 0.8, 4) AS retained_earnings,
      round(income * 0.1, 4) AS owners_equity, round(greatest(net, 0) * 0.1, 4) AS cash
    FROM w LEFT JOIN ri USING (tenant) LEFT JOIN rs USING (tenant) LEFT JOIN re USING (tenant)""",
)
def ag_bs_estimates(spark, d):
    return statements.balance_estimates(
        transactions(spark, d, "tenant", "txn_id", "date", "amount", "category", "description")
    )


@report(
    "wn_last_n",
    f"""WITH {TXN} SELECT tenant, txn_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount FROM (
      SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY date DESC, txn_id DESC, amount DESC) AS rn FROM txn WHERE amount > 0) WHERE rn <= 30""",
)
def wn_last_n(spark, d):
    txn = transactions(spark, d, "tenant", "txn_id", "date", "amount").where("amount > 0")
    return statements.last_rows(txn, 30, ["tenant"], ["date", "txn_id", "amount"])


CLASS = f"""{TXN}, akind AS (SELECT tenant, txn_id, date, abs(amount) AS value,
  coalesce({sql_first_match('description', ASSET_LIABILITY_RULES, None)}, CASE WHEN amount > 0 THEN 'asset:Other' ELSE 'liability:Other' END) AS k
  FROM txn WHERE amount <> 0),
 al AS (SELECT tenant, txn_id, date, value, split_part(k, ':', 1) AS type, split_part(k, ':', 2) AS subcategory FROM akind),
 alt AS (SELECT tenant, sum(CASE WHEN type = 'asset' THEN value ELSE 0 END) AS ta, sum(CASE WHEN type = 'asset' THEN 0 ELSE value END) AS tl,
  count(*) FILTER (type = 'asset') AS asset_count, count(*) FILTER (type <> 'asset') AS liability_count,
  count(DISTINCT subcategory) FILTER (type = 'asset') AS asset_kinds, count(DISTINCT subcategory) FILTER (type <> 'asset') AS liability_kinds
  FROM al GROUP BY tenant)"""
AL_COLUMNS = ("tenant", "txn_id", "date", "description", "amount", "category")


def al_rows(spark, d, *columns):
    return statements.asset_liability_rows(transactions(spark, d, *(columns or AL_COLUMNS)))


@report(
    "fn_asset_liability_class",
    f"WITH {CLASS} SELECT tenant, txn_id, type, subcategory, CAST(value AS DOUBLE) AS value FROM al",
)
def fn_asset_liability_class(spark, d):
    return al_rows(spark, d).select("tenant", "txn_id", "type", "subcategory", "value")


@report(
    "ag_assets_liab",
    f"""WITH {CLASS} SELECT tenant, CAST(ta AS DOUBLE) AS total_assets, CAST(tl AS DOUBLE) AS total_liabilities, asset_count, liability_count,
    asset_kinds, liability_kinds, CAST(ta - tl AS DOUBLE) AS net_worth,
    CASE WHEN ta > 0 THEN round(CAST(tl AS DOUBLE) / CAST(ta AS DOUBLE), 6) ELSE 0 END AS debt_to_asset FROM alt""",
)
def ag_assets_liab(spark, d):
    return statements.assets_liabilities(al_rows(spark, d, "tenant", "description", "amount", "category"))


@report(
    "ag_asset_breakdown",
    f"""WITH {CLASS}, s AS (SELECT tenant, type, subcategory, count(*) AS n, sum(value) AS v FROM al GROUP BY ALL)
    SELECT tenant, type, subcategory, n, CAST(v AS DOUBLE) AS total_value,
      round(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY tenant, type) AS DOUBLE), 6) AS share FROM s""",
)
def ag_asset_breakdown(spark, d):
    return statements.asset_breakdown(al_rows(spark, d, "tenant", "description", "amount", "category"))


@report(
    "dj_networth_trend",
    f"WITH {CLASS} SELECT tenant, txn_id, CAST(date AS VARCHAR) AS date, type, CAST(value AS DOUBLE) AS value FROM al WHERE date >= DATE '1998-07-31' - 30",
)
def dj_networth_trend(spark, d):
    recent = transactions(spark, d, *AL_COLUMNS, since="1998-07-01")
    rows = statements.networth_rows(statements.asset_liability_rows(recent), as_date("1998-07-31"), 30)
    return rows.select("tenant", "txn_id", "date", "type", "value").orderBy("tenant", "date", "txn_id")


def _basic(*prefix):
    def plan(spark, d):
        out = statements.basic_statements(cash.cash_totals(transactions(spark, d, "tenant", "amount")))
        return out.select("tenant", *[c for c in out.columns if c[:3] in prefix])

    return plan


BASIC = f"""WITH {TXN}, b AS (SELECT tenant, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS i,
  CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS e, CAST(sum(amount) AS DOUBLE) AS n FROM txn GROUP BY tenant) SELECT tenant, """
report("ag_basic_bs", BASIC + """greatest(n, 0) AS bs_assets, n AS bs_equity, CAST(NULL AS DOUBLE) AS bs_current_ratio,
  round(0.0 / nullif(n, 0), 2) AS bs_debt_to_equity, round(n / nullif(greatest(n, 0), 0) * 100, 2) AS bs_return_on_assets FROM b""")(_basic("bs_"))
report("ag_basic_pl", BASIC + """i AS pl_revenue, e AS pl_cogs, n AS pl_net_income,
  CASE WHEN i > 0 THEN round(n / i * 100, 6) ELSE 0 END AS pl_margin FROM b""")(_basic("pl_"))
report("ag_basic_assets", BASIC + """round(i * 0.3, 4) AS al_current_assets, round(i * 0.5, 4) AS al_fixed_assets, round(i * 0.8, 4) AS al_total_assets,
  round(e * 0.2, 4) AS al_current_liabilities, round(e * 0.3, 4) AS al_longterm_liabilities, round(e * 0.5, 4) AS al_total_liabilities,
  round(i * 0.8 - e * 0.5, 4) AS al_equity FROM b""")(_basic("al_"))
report("ag_basic_budget", BASIC + """round(i / 12, 4) AS bu_monthly_income, round(e / 12, 4) AS bu_monthly_expenses, round(i / 12 - e / 12, 4) AS bu_savings,
  round(i - e, 4) AS bu_remaining, round(e / 12 * 0.6, 4) AS bu_fixed, round(e / 12 * 0.3, 4) AS bu_variable, round(e / 12 * 0.1, 4) AS bu_discretionary FROM b""")(_basic("bu_"))
report("ag_basic_forecast", BASIC + """round(i * (1 + CAST(0.05 AS DOUBLE) / 12), 4) AS fc_next_month, round(i * (1 + CAST(0.05 AS DOUBLE) / 4), 4) AS fc_next_quarter,
  round(i * CAST(1.05 AS DOUBLE), 4) AS fc_next_year, round(i * power(CAST(1.05 AS DOUBLE), 3), 4) AS fc_long_term FROM b""")(_basic("fc_"))
