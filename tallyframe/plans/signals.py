"""Signal reports: every module's rules over its facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.money import dbl
from tallyframe.operators import budget, cash, currency, forecast, ledger, signals, statements, tax
from tallyframe.plans import budget as p_budget
from tallyframe.plans import currency as p_currency
from tallyframe.plans import forecast as p_forecast
from tallyframe.plans import ledger as p_ledger
from tallyframe.plans import statements as p_statements
from tallyframe.plans import tax as p_tax
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, transactions

HOT = """CASE WHEN tenant = '3' THEN CASE WHEN amount > 0 THEN 0 ELSE amount END WHEN tenant = '4' THEN CASE WHEN amount < 0 THEN 0 ELSE amount END
  WHEN tenant IN ('5', '6') AND amount > 0 THEN amount * 5 ELSE amount END"""
FACTS = f"""{TXN}, ft AS (SELECT tenant, category, CAST({HOT} AS DECIMAL(18,2)) AS amount FROM txn),
 facts AS (SELECT tenant, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS income,
  CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS expenses, CAST(sum(amount) AS DOUBLE) AS net, count(*) AS txn_count,
  CAST(sum(CASE WHEN amount < 0 AND category = 'Travel' THEN -amount ELSE 0 END) AS DOUBLE) AS other_spend FROM ft GROUP BY tenant)"""


def adjusted(spark, d, *columns):
    """Transactions with a few tenants shifted (no income, no expenses, high income) so
    that each rule has tenants on both sides."""
    t = transactions(spark, d, "tenant", "amount", *columns)
    return t.withColumn("amount", F.expr(f"CAST({HOT} AS DECIMAL(18,2))"))


def cash_facts(spark, d):
    t = adjusted(spark, d, "category")
    other = F.when((F.col("amount") < 0) & (F.col("category") == "Travel"), -F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return t.groupBy("tenant").agg(*cash.flows(), F.sum(other).alias("other")).select(
        "tenant", dbl(F.col("inflow")).alias("income"), dbl(F.col("outflow")).alias("expenses"), dbl(F.col("net")).alias("net"),
        "txn_count", dbl(F.col("other")).alias("other_spend"),
    )


for _module in ("health", "run", "basic", "margin"):
    report(f"dj_signals_{_module}", f"WITH {FACTS} {signals.emit_sql(_module, 'facts')}")(
        lambda spark, d, m=_module: signals.emit(cash_facts(spark, d), m)
    )


@report(
    "fn_health",
    f"""WITH {FACTS} SELECT tenant, income, expenses, net, CASE WHEN income = 0 THEN 'Unknown' WHEN net / income * 100 > 20 THEN 'Excellent'
      WHEN net / income * 100 > 10 THEN 'Good' WHEN net / income * 100 > 0 THEN 'Stable' WHEN net / income * 100 > -10 THEN 'Concerning' ELSE 'Critical' END AS health FROM facts""",
)
def fn_health(spark, d):
    f = cash_facts(spark, d).select("tenant", "income", "expenses", "net")
    return f.withColumn("health", signals.health_label(F.col("income"), F.col("expenses"), F.col("net")))


@report(
    "dj_signals_zero_income",
    f"""WITH {FACTS} SELECT tenant, income, CASE WHEN income = 0 THEN 'Cannot be confirmed as no income is recorded in the data provided. Stable' ELSE 'Stable' END AS health_text,
      CASE WHEN income = 0 THEN 'income_missing' END AS alert, CASE WHEN income = 0 THEN
       'Ensure revenue sources are properly tracked and recorded to allow accurate financial analysis.' END AS recommendation,
      CASE WHEN income = 0 THEN 65 ELSE 80 END AS confidence FROM facts""",
)
def dj_signals_zero_income(spark, d):
    f = cash_facts(spark, d).select("tenant", "income", F.lit("Stable").alias("health_text"), F.lit(80).alias("confidence"))
    return signals.zero_income(f)


@report(
    "dj_signals_expense",
    f"""WITH {TXN}, sp AS (SELECT *, CASE WHEN category = 'Office' THEN 'VAT ' WHEN category = 'Software' THEN 'Service ' ELSE '' END || description AS dsc FROM txn WHERE amount < 0),
    m AS (SELECT tenant, CAST(sum(-amount) AS DOUBLE) / count(*) AS mean_expense FROM sp GROUP BY tenant),
    fv AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY date, txn_id, amount) AS rn FROM sp WHERE contains(lower(dsc), 'vat')),
    fs AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY date, txn_id, amount) AS rn FROM sp WHERE contains(lower(dsc), 'service'))
    SELECT sp.tenant, 'expense' AS type, 'high' AS severity, round(CAST(-amount AS DOUBLE), 2) AS amount, category, txn_id FROM sp JOIN m USING (tenant) WHERE CAST(-amount AS DOUBLE) > mean_expense * 2
    UNION ALL SELECT tenant, 'tax', 'medium', round(CAST(-amount AS DOUBLE), 2), 'Tax', txn_id FROM fv WHERE rn = 1
    UNION ALL SELECT tenant, 'service', 'low', round(CAST(-amount AS DOUBLE), 2), 'Other', txn_id FROM fs WHERE rn = 1""",
)
def dj_signals_expense(spark, d):
    t = transactions(spark, d, "tenant", "txn_id", "date", "amount", "category", "description")
    tag = F.when(F.col("category") == "Office", "VAT ").when(F.col("category") == "Software", "Service ").otherwise("")
    return signals.expense_signals(t.withColumn("description", F.concat(tag, "description")))


@report(
    "ag_high_expense",
    f"""WITH {TXN}, m AS (SELECT tenant, CAST(sum(-amount) AS DOUBLE) / count(*) AS mean_expense FROM txn WHERE amount < 0 GROUP BY tenant)
    SELECT tenant, txn_id, CAST(amount AS DOUBLE) AS amount FROM txn JOIN m USING (tenant) WHERE amount < 0 AND CAST(-amount AS DOUBLE) > mean_expense * 2""",
)
def ag_high_expense(spark, d):
    return signals.high_expenses(transactions(spark, d, "tenant", "txn_id", "amount")).drop("mean_expense")


MIX = f"""{TXN}, mc AS (SELECT tenant, category, sum(-amount) AS spend FROM txn WHERE amount < 0 GROUP BY ALL),
 mix AS (SELECT tenant, arg_max(category, (spend, category)) AS top_category, max(spend) AS top_spend, sum(spend) AS expenses,
   sum(CASE WHEN category = 'Other' THEN spend ELSE 0 END) AS other_spend FROM mc GROUP BY tenant)"""


@report(
    "ag_top_category",
    f"""WITH {MIX} SELECT tenant, top_category, CAST(top_spend AS DOUBLE) AS top_spend, round(CAST(top_spend AS DOUBLE) / CAST(expenses AS DOUBLE), 6) AS top_share FROM mix""",
)
def ag_top_category(spark, d):
    mix = signals.spend_mix(transactions(spark, d, "tenant", "amount", "category", "description", "vendor"))
    return mix.select("tenant", "top_category", "top_spend", "top_share")


@report(
    "fn_business_type",
    f"""WITH {MIX}, b AS (SELECT tenant, bool_or(regexp_matches(lower(description), 'consulting|service')) AS c, bool_or(regexp_matches(lower(description), 'software|license')) AS s,
      bool_or(regexp_matches(lower(description), 'office|supplies')) AS o, bool_or(regexp_matches(lower(description), 'client|payment')) AS p FROM txn GROUP BY tenant)
    SELECT tenant, top_category, CASE WHEN top_category = 'Software' AND CAST(top_spend AS DOUBLE) > CAST(expenses AS DOUBLE) * 0.3 THEN 'Technology/Software Company'
      WHEN top_category = 'Marketing' AND CAST(top_spend AS DOUBLE) > CAST(expenses AS DOUBLE) * 0.3 THEN 'Marketing/Agency'
      WHEN top_category = 'Equipment' AND CAST(top_spend AS DOUBLE) > CAST(expenses AS DOUBLE) * 0.3 THEN 'Manufacturing/Production' ELSE 'General Business' END AS business_type,
      CASE WHEN c THEN 'Consulting Services' WHEN s THEN 'Software/Technology' WHEN o THEN 'General Business' WHEN p THEN 'Service Provider' ELSE 'General Business' END AS business_type_text
    FROM mix JOIN b USING (tenant)""",
)
def fn_business_type(spark, d):
    t = transactions(spark, d, "tenant", "amount", "category", "description", "vendor")
    mix = signals.business_type(signals.spend_mix(t)).select("tenant", "top_category", "business_type")
    return mix.join(signals.business_type_by_text(t), "tenant")


@report("dj_signals_assets", f"WITH {p_statements.CLASS}, f AS (SELECT tenant, CAST(ta AS DOUBLE) AS total_assets, CAST(tl AS DOUBLE) AS total_liabilities, asset_count, liability_count, asset_kinds, liability_kinds, CAST(ta - tl AS DOUBLE) AS net_worth, CASE WHEN ta > 0 THEN round(CAST(tl AS DOUBLE) / CAST(ta AS DOUBLE), 6) ELSE 0 END AS debt_to_asset FROM alt) {signals.emit_sql('assets', 'f')}")
def dj_signals_assets(spark, d):
    rows = p_statements.al_rows(spark, d, "tenant", "description", "amount", "category")
    return signals.emit(statements.assets_liabilities(rows), "assets")


def _well_managed(perf):
    return perf.where("status in ('healthy', 'underutilized')").select("tenant").distinct().select(
        "tenant", F.lit("budget").alias("module"), F.lit("highlight").alias("kind"), F.lit("well_managed_categories").alias("type"),
        F.lit("low").alias("severity"), F.lit(0.0).alias("amount"), F.lit("Categories").alias("category"),
    )


@report(
    "dj_signals_budget",
    f"""WITH {p_budget.OVERALL}, perf AS ({p_budget.PERF} FROM joined)
    {signals.emit_sql('budget', 'ov')} UNION ALL {signals.emit_sql('budget_category', 'perf', label='category')}
    UNION ALL SELECT DISTINCT tenant, 'budget', 'highlight', 'well_managed_categories', 'low', 0.0, 'Categories' FROM perf WHERE status IN ('healthy', 'underutilized')""",
)
def dj_signals_budget(spark, d):
    s = p_budget.spend(spark, d)
    perf = budget.performance(budget.budget_actual(s))
    parts = [
        signals.emit(budget.overall(s, budget.tenant_budgets(s)), "budget"),
        signals.emit(perf, "budget_category", label="category"), _well_managed(perf),
    ]
    return signals.union_all(parts)


@report(
    "dj_signals_forecast",
    f"""WITH {p_forecast.bucket_sql('short')}, st AS (SELECT * FROM {p_forecast.trend.sql_last_two('bk', 'tenant, anchor', 'bucket', ['income', 'expense', 'net'])}),
    fc AS (SELECT tenant, sum(CAST(round(avg_income * (1 + income_trend / 100 * (i / 30.0)) - avg_expense * (1 + expense_trend / 100 * (i / 30.0)), 4) AS DECIMAL(18,4))) AS t FROM st, range(1, 31) r(i) GROUP BY tenant),
    f AS (SELECT st.*, CAST(t AS DOUBLE) AS total_net FROM st JOIN fc USING (tenant)) {signals.emit_sql('forecast', 'f')}""",
)
def dj_signals_forecast(spark, d):
    base = p_forecast.daily(spark, d)
    total = forecast.horizon_forecast(base, "short").groupBy("tenant").agg(
        dbl(F.sum(F.col("net").cast("decimal(18,4)"))).alias("total_net")
    )
    return signals.emit(forecast.horizon_stats(base, "short").join(total, "tenant"), "forecast")


@report(
    "dj_signals_tax",
    f"""WITH {p_tax.TAXED}, t AS (SELECT tenant, CAST(sum(CASE WHEN type = 'tax' THEN tax_part ELSE 0 END) AS DOUBLE) AS total_taxes, CAST(sum(CASE WHEN type = 'vat' THEN tax_part ELSE 0 END) AS DOUBLE) AS total_vat,
      CAST(sum(net_amount) AS DOUBLE) AS nt, count(*) FILTER (due_date BETWEEN DATE '1998-06-10' AND DATE '1998-07-10') AS upcoming,
      CAST(coalesce(sum(tax_part) FILTER (due_date BETWEEN DATE '1998-06-10' AND DATE '1998-07-10'), 0) AS DOUBLE) AS upcoming_amount,
      count(*) FILTER (due_date < DATE '1998-06-10') AS overdue, CASE WHEN count(*) FILTER (type = 'vat') > 0 THEN 0.0 END AS vat_paid_share FROM ent GROUP BY tenant),
    f AS (SELECT *, CASE WHEN nt > 0 THEN round(total_taxes / nt, 6) ELSE 0 END AS effective_tax_rate FROM t) {signals.emit_sql('tax', 'f')}""",
)
def dj_signals_tax(spark, d):
    ent = p_tax.entries(spark, d)
    due = tax.deadlines(ent, "1998-06-10", 30).groupBy("tenant").agg(
        F.count(F.when(F.col("kind") == "upcoming", 1)).alias("upcoming"),
        F.sum(F.when(F.col("kind") == "upcoming", F.col("tax_part"))).alias("upcoming_amount"),
        F.count(F.when(F.col("kind") == "overdue", 1)).alias("overdue"),
    )
    paid = ent.where("type = 'vat'").groupBy("tenant").agg(
        (F.count(F.when(F.col("status") == "paid", 1)) / F.count("*")).alias("vat_paid_share")
    )
    facts = tax.tax_totals(ent).join(due, "tenant", "left").join(paid, "tenant", "left").fillna(0, ["upcoming", "overdue"])
    return signals.emit(facts.withColumn("upcoming_amount", F.coalesce(dbl(F.col("upcoming_amount")), F.lit(0.0))), "tax")


@report(
    "dj_signals_currency",
    f"""WITH {p_currency.EXPO_G}, f AS (SELECT tenant, currencies, round(h, 6) AS hhi, round(1 - h, 6) AS diversification,
      CASE WHEN currencies = 1 THEN 'high' WHEN currencies >= 3 THEN 'low' ELSE 'medium' END AS volatility FROM con) {signals.emit_sql('currency', 'f')}""",
)
def dj_signals_currency(spark, d):
    return signals.emit(currency.concentration(currency.exposure(p_currency.multi(spark, d))), "currency")


@report("dj_signals_pl", f"WITH {p_statements.PL.replace('FROM txn GROUP BY tenant)', f'FROM (SELECT tenant, CAST({HOT} AS DECIMAL(18,2)) AS amount FROM txn) GROUP BY tenant)')} {signals.emit_sql('pl', 'pl')}")
def dj_signals_pl(spark, d):
    return signals.emit(statements.profit_loss(adjusted(spark, d)), "pl")


@report("dj_signals_bs", f"WITH {p_statements.BS} {signals.emit_sql('bs', 'bs')}")
def dj_signals_bs(spark, d):
    sheet = statements.balance_sheet(transactions(spark, d, "tenant", "amount", "category", "description"))
    return signals.emit(sheet, "bs")


@report(
    "dj_signals_ledger",
    f"""WITH {p_ledger.BALANCES}, tot AS (SELECT tenant, CAST(sum(CASE WHEN normal_balance = 'Debit' AND (debit_total > 0 OR credit_total > 0) THEN balance ELSE 0 END) AS DOUBLE) AS debits,
      CAST(sum(CASE WHEN normal_balance = 'Credit' AND (debit_total > 0 OR credit_total > 0) THEN balance ELSE 0 END) AS DOUBLE) AS credits,
      count(*) FILTER (debit_total > 0 OR credit_total > 0) AS accounts FROM bal GROUP BY tenant),
    f AS (SELECT tot.*, abs(debits - credits) < 0.01 AS balanced, n AS txn_count FROM tot JOIN (SELECT tenant, count(*) AS n FROM txn GROUP BY tenant) USING (tenant)),
    acct AS (SELECT tenant, account_name, account_type, normal_balance, CAST(balance AS DOUBLE) AS balance FROM bal)
    {signals.emit_sql('ledger', 'f')} UNION ALL {signals.emit_sql('ledger_account', 'acct', label='account_name')}""",
)
def dj_signals_ledger(spark, d):
    t = transactions(spark, d, "tenant", "description", "category", "amount")
    bal = ledger.transaction_balances(t)
    active = (F.col("debit_total") > 0) | (F.col("credit_total") > 0)
    debit = F.col("normal_balance") == "Debit"
    zero = F.lit(0).cast("decimal(28,2)")
    facts = (
        bal.groupBy("tenant").agg(
            dbl(F.sum(F.when(active & debit, F.col("balance")).otherwise(zero))).alias("debits"),
            dbl(F.sum(F.when(active & ~debit, F.col("balance")).otherwise(zero))).alias("credits"),
            F.count(F.when(active, 1)).alias("accounts"),
        )
        .withColumn("balanced", F.abs(F.col("debits") - F.col("credits")) < 0.01)
        .join(t.groupBy("tenant").agg(F.count("*").alias("txn_count")), "tenant")
    )
    accounts = bal.withColumn("balance", dbl(F.col("balance")))
    return signals.emit(facts, "ledger").unionByName(signals.emit(accounts, "ledger_account", label="account_name"))


@report(
    "ag_all_signals",
    f"""SELECT tenant, module, kind, severity, count(*) AS n FROM (
      (WITH {FACTS} {signals.emit_sql('health', 'facts')} UNION ALL {signals.emit_sql('run', 'facts')} UNION ALL {signals.emit_sql('basic', 'facts')} UNION ALL {signals.emit_sql('margin', 'facts')})
      UNION ALL (WITH {p_statements.PL} {signals.emit_sql('pl', 'pl')})
      UNION ALL (WITH {p_statements.BS} {signals.emit_sql('bs', 'bs')})
      UNION ALL (WITH {p_currency.EXPO}, f AS (SELECT tenant, currencies, round(h, 6) AS hhi, round(1 - h, 6) AS diversification,
      CASE WHEN currencies = 1 THEN 'high' WHEN currencies >= 3 THEN 'low' ELSE 'medium' END AS volatility FROM con) {signals.emit_sql('currency', 'f')})
    ) GROUP BY ALL""",
)
def ag_all_signals(spark, d):
    facts = cash_facts(spark, d)
    t = transactions(spark, d, "tenant", "amount", "category", "description", "currency")
    parts = [signals.emit(facts, m) for m in ("health", "run", "basic", "margin")]
    parts.append(signals.emit(statements.profit_loss(t), "pl"))
    parts.append(signals.emit(statements.balance_sheet(t), "bs"))
    parts.append(signals.emit(currency.concentration(currency.exposure(t)), "currency"))
    return signals.union_all(parts).groupBy("tenant", "module", "kind", "severity").agg(F.count("*").alias("n"))
