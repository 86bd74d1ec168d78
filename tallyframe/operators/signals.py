"""Alerts, highlights and recommendations as one long table.

A rule is (kind, type, severity, condition, amount, category); condition and
amount are SQL expressions over the facts row of a key. All rules of a module run
in one projection; nothing is joined or shuffled beyond the facts themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import dbl, ratio_or_zero, rounded

SIGNAL_COLUMNS = ("module", "kind", "type", "severity", "amount", "category")
Rule = tuple[str, str, str, str, str, str]

# Rule ids, severities and thresholds. All comparisons are strict unless written otherwise.
RULES: dict[str, list[Rule]] = {
    "health": [
        ("alert", "income_missing", "high", "income = 0 AND expenses > 0", "0", "Income"),
        ("alert", "expense_missing", "medium", "expenses = 0 AND income > 0", "0", "Expenses"),
        ("alert", "expense_high", "medium", "income > 0 AND expenses > 0 AND expenses > income * 0.5", "expenses", "Expenses"),
        ("alert", "negative_cashflow", "high", "income > 0 AND expenses > 0 AND net < 0", "abs(net)", "Cashflow"),
        ("highlight", "income_strong", "low", "income > 0 AND expenses > 0 AND income > expenses * 2", "0", "Income"),
        ("highlight", "high_profit_margin", "low", "income > 0 AND expenses > 0 AND net > income * 0.5", "0", "Profitability"),
        ("highlight", "low_expense_ratio", "low", "income > 0 AND expenses > 0 AND expenses < income * 0.3", "0", "Expenses"),
        ("alert", "data_missing", "high", "income = 0 AND expenses = 0", "0", "Data"),
    ],
    "run": [
        ("alert", "income_missing", "high", "income = 0 AND expenses > 0", "0", "Income"),
        ("alert", "negative_cashflow", "high", "net < 0", "abs(net)", "Cashflow"),
        ("alert", "expense_recorded", "medium", "expenses > 0", "expenses", "Expenses"),
        ("highlight", "data_processed", "low", "expenses > 0", "0", "Data"),
        ("highlight", "balance_sheet_available", "low", "txn_count > 0", "0", "Statements"),
        ("highlight", "profit_loss_available", "low", "txn_count > 0", "0", "Statements"),
        ("highlight", "ledger_available", "low", "txn_count > 0", "0", "Statements"),
    ],
    "basic": [
        ("alert", "cashflow_alert", "high", "net < 0", "abs(net)", "Cashflow"),
        ("alert", "expense_alert", "medium", "expenses > income * 0.8", "0", "Expenses"),
        ("alert", "categorization_alert", "low", "other_spend > expenses * 0.2", "0", "Other"),
        ("alert", "income_missing", "high", "expenses > 0 AND income = 0", "0", "Income"),
        ("alert", "negative_cashflow", "high", "net < 0", "abs(net)", "Cashflow"),
        ("alert", "no_transactions", "medium", "txn_count = 0", "0", "Transactions"),
        ("highlight", "income_strong", "low", "income > 0 AND expenses > 0 AND net > 0", "0", "Income"),
        ("highlight", "high_profit_margin", "low", "net > income * 0.5", "0", "Profitability"),
        ("highlight", "low_expense_ratio", "low", "expenses < income * 0.3", "0", "Expenses"),
        ("recommendation", "raise_revenue_or_cut_costs", "high", "net < 0", "0", "Cashflow"),
        ("recommendation", "cut_costs", "medium", "expenses > income * 0.8", "0", "Expenses"),
        ("recommendation", "improve_categories", "low", "other_spend > expenses * 0.2", "0", "Other"),
        ("risk", "negative_cashflow_risk", "high", "net < 0", "0", "Cashflow"),
        ("risk", "no_income_risk", "medium", "income = 0", "0", "Income"),
        ("risk", "no_expense_risk", "medium", "expenses = 0", "0", "Expenses"),
    ],
    "margin": [
        ("recommendation", "reduce_or_grow", "high", "net < 0", "0", "Cashflow"),
        ("recommendation", "monitor_expense_ratio", "medium", "expenses > income * 0.8", "0", "Expenses"),
        ("recommendation", "consider_investment", "low", "income > 0 AND net > 0", "0", "Growth"),
        ("recommendation", "keep_monitoring", "low", "NOT (net < 0) AND NOT (expenses > income * 0.8) AND NOT (income > 0 AND net > 0)", "0", "General"),
    ],
    "assets": [
        ("alert", "high_debt_ratio", "high", "debt_to_asset > 0.8", "total_liabilities", "Debt"),
        ("alert", "negative_net_worth", "high", "net_worth < 0", "abs(net_worth)", "Net Worth"),
        ("alert", "low_asset_diversity", "medium", "asset_kinds < 3 AND asset_count > 5", "0", "Diversification"),
        ("alert", "high_liability_concentration", "medium", "liability_kinds < 2 AND liability_count > 3", "0", "Risk"),
        ("highlight", "strong_net_worth", "low", "net_worth > total_assets * 0.5", "0", "Net Worth"),
        ("highlight", "low_debt_ratio", "low", "debt_to_asset < 0.3", "0", "Debt"),
        ("highlight", "good_asset_diversity", "low", "asset_kinds >= 5", "0", "Diversification"),
        ("highlight", "positive_net_worth_growth", "low", "net_worth > 0 AND total_assets > total_liabilities * 2", "0", "Net Worth"),
    ],
    "budget": [
        ("alert", "budget_exceeded", "high", "utilisation >= 0.95", "abs(variance)", "Budget"),
        ("alert", "spending_trend_warning", "medium", "utilisation > 0.8 AND variance_pct > 20", "0", "Trends"),
        ("highlight", "under_budget", "low", "utilisation < 0.8", "abs(variance)", "Budget"),
        ("highlight", "consistent_spending", "low", "utilisation >= 0.7 AND utilisation <= 0.9", "0", "Consistency"),
        ("recommendation", "reduce_spending", "high", "utilisation > 1", "0", "Overall"),
        ("recommendation", "trend_analysis", "medium", "variance_pct > 20", "0", "Trends"),
    ],
    "budget_category": [
        ("alert", "category_budget_exceeded", "high", "status = 'critical'", "abs(variance)", "*"),
        ("alert", "category_budget_warning", "medium", "status = 'warning'", "actual", "*"),
        ("recommendation", "category_reduction", "high", "status = 'critical'", "0", "*"),
        ("recommendation", "category_reallocation", "low", "status = 'underutilized'", "0", "*"),
    ],
    "forecast": [
        ("alert", "negative_cashflow_forecast", "high", "total_net < 0", "abs(total_net)", "Forecast"),
        ("alert", "declining_trend_forecast", "medium", "net_direction = 'decreasing' AND net_trend < -20", "0", "Trends"),
        ("alert", "high_expense_growth_forecast", "medium", "expense_direction = 'increasing' AND expense_trend > 30", "0", "Expenses"),
        ("highlight", "positive_cashflow_forecast", "low", "total_net > 0", "0", "Forecast"),
        ("highlight", "stable_trend_forecast", "low", "net_direction = 'stable' AND abs(net_trend) < 10", "0", "Trends"),
        ("highlight", "income_growth_forecast", "low", "income_direction = 'increasing' AND income_trend > 10", "0", "Income"),
        ("recommendation", "cashflow_improvement", "high", "total_net < 0", "0", "Cashflow"),
        ("recommendation", "expense_control", "medium", "expense_direction = 'increasing' AND expense_trend > 20", "0", "Expenses"),
        ("recommendation", "growth_management", "low", "income_direction = 'increasing' AND income_trend > 15", "0", "Growth"),
    ],
    "tax": [
        ("alert", "high_tax_burden", "high", "effective_tax_rate > 0.30", "total_taxes", "Tax"),
        ("alert", "upcoming_tax_deadlines", "medium", "upcoming > 0", "upcoming_amount", "Deadlines"),
        ("alert", "overdue_tax_payments", "high", "overdue > 0", "0", "Overdue"),
        ("alert", "vat_registration_threshold", "medium", "total_vat > 85000", "total_vat", "VAT"),
        ("highlight", "low_tax_burden", "low", "effective_tax_rate < 0.15", "0", "Tax"),
        ("highlight", "no_overdue_tax_payments", "low", "overdue = 0", "0", "Overdue"),
        ("highlight", "good_vat_compliance", "low", "vat_paid_share > 0.9", "0", "VAT"),
    ],
    "currency": [
        ("alert", "high_concentration_risk", "high", "hhi > 0.5", "0", "Currency Risk"),
        ("alert", "low_diversification", "medium", "diversification < 0.3", "0", "Diversification"),
        ("alert", "high_volatility_risk", "high", "volatility = 'high'", "0", "Volatility"),
        ("highlight", "good_diversification", "low", "diversification > 0.7", "0", "Diversification"),
        ("highlight", "low_volatility_risk", "low", "volatility = 'low'", "0", "Volatility"),
        ("highlight", "multiple_currencies", "low", "currencies >= 3", "0", "Currency"),
    ],
    "pl": [
        ("alert", "net_loss", "high", "net_income < 0", "abs(net_income)", "Profitability"),
        ("alert", "low_gross_margin", "medium", "gross_margin < 20", "gross_margin", "Profitability"),
        ("alert", "operating_loss", "high", "gross_profit < 0", "abs(gross_profit)", "Operations"),
        ("alert", "high_expense_ratio", "medium", "expense_ratio > 90", "expense_ratio", "Efficiency"),
        ("highlight", "profitable_business", "low", "net_income > 0", "net_income", "Profitability"),
        ("highlight", "strong_gross_margin", "low", "gross_margin > 50", "gross_margin", "Profitability"),
        ("highlight", "profitable_operations", "low", "gross_profit > 0", "gross_profit", "Operations"),
        ("highlight", "healthy_profit_margin", "low", "net_margin > 10", "net_margin", "Profitability"),
    ],
    "bs": [
        ("alert", "low_current_ratio", "high", "current_ratio < 1", "current_ratio", "Liquidity"),
        ("alert", "high_debt_to_equity", "medium", "debt_to_equity > 2", "debt_to_equity", "Leverage"),
        ("alert", "balance_sheet_imbalance", "high", "NOT balanced", "abs(total_assets - total_liabilities - total_equity)", "Balance"),
        ("highlight", "strong_liquidity", "low", "current_ratio > 2", "current_ratio", "Liquidity"),
        ("highlight", "strong_equity_position", "low", "equity_ratio > 0.5", "equity_ratio", "Equity"),
        ("highlight", "balanced_sheet", "low", "balanced", "0", "Balance"),
    ],
    "ledger": [
        ("alert", "trial_balance_error", "high", "NOT balanced", "abs(debits - credits)", "Balance"),
        ("highlight", "balanced_ledger", "low", "balanced", "0", "Balance"),
        ("highlight", "active_accounts", "low", "accounts >= 0", "accounts", "Accounts"),
        ("highlight", "comprehensive_ledger", "low", "txn_count > 50", "txn_count", "Transactions"),
    ],
    "ledger_account": [
        ("alert", "negative_asset_balance", "medium", "balance < 0 AND normal_balance = 'Debit'", "abs(balance)", "*"),
        ("alert", "negative_liability_balance", "medium", "balance > 0 AND normal_balance = 'Credit' AND account_type = 'Liability'", "abs(balance)", "*"),
    ],
}


def emit(facts: DataFrame, module: str, key: str = "tenant", label: str | None = None) -> DataFrame:
    """Rows of the signal table for every rule of ``module`` that holds; a category
    of '*' takes the value of column ``label``."""
    cells = []
    for kind, kind_type, severity, condition, amount, category in RULES[module]:
        cell = F.struct(
            F.lit(module.split("_")[0]).alias("module"), F.lit(kind).alias("kind"), F.lit(kind_type).alias("type"),
            F.lit(severity).alias("severity"), rounded(F.expr(amount), 2).alias("amount"),
            (F.col(label) if category == "*" else F.lit(category)).alias("category"),
        )
        cells.append(F.when(F.expr(condition), cell))
    return facts.select(key, F.inline(F.array_compact(F.array(*cells))))


def emit_sql(module: str, source: str, key: str = "tenant", label: str | None = None) -> str:
    arms = []
    for kind, kind_type, severity, condition, amount, category in RULES[module]:
        cat = label if category == "*" else f"'{category}'"
        arms.append(
            f"SELECT {key}, '{module.split('_')[0]}' AS module, '{kind}' AS kind, '{kind_type}' AS type, '{severity}' AS severity, "
            f"round(CAST({amount} AS DOUBLE), 2) AS amount, {cat} AS category FROM {source} WHERE {condition}"
        )
    return " UNION ALL ".join(arms)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Signals of all modules as one table."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def health_label(income: Column, expenses: Column, net: Column) -> Column:
    """Margin bands: above 20, 10, 0, -10 percent."""
    margin = F.try_divide(net, income) * 100
    return (
        F.when(income == 0, "Unknown").when(margin > 20, "Excellent").when(margin > 10, "Good")
        .when(margin > 0, "Stable").when(margin > -10, "Concerning").otherwise("Critical")
    )


def high_expenses(df: DataFrame, keys: Sequence[str] = ("tenant",), factor: float = 2.0) -> DataFrame:
    """Expense rows larger than ``factor`` times the mean absolute expense of the key.

    The mean is aggregated and joined back, so a hot key is not sorted in one task.
    """
    spent = df.where(F.col("amount") < 0)
    mean = spent.groupBy(*keys).agg((dbl(F.sum(-F.col("amount"))) / F.count("*")).alias("mean_expense"))
    return spent.join(mean, list(keys)).where(-dbl(F.col("amount")) > F.col("mean_expense") * factor)


def expense_signals(df: DataFrame) -> DataFrame:
    """High expenses, and the first VAT and the first service row of each key."""
    high = high_expenses(df).select(
        "tenant", F.lit("expense").alias("type"), F.lit("high").alias("severity"), rounded(-F.col("amount"), 2).alias("amount"),
        "category", "txn_id",
    )
    order = F.struct("date", "txn_id", "amount")

    def first_of(word: str, kind: str, severity: str, category: str) -> DataFrame:
        hit = df.where((F.col("amount") < 0) & F.lower("description").contains(word))
        first = hit.groupBy("tenant").agg(F.min(order).alias("f"))
        return first.select(
            "tenant", F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
            rounded(-F.col("f.amount"), 2).alias("amount"), F.lit(category).alias("category"), F.col("f.txn_id").alias("txn_id"),
        )

    return high.unionByName(first_of("vat", "tax", "medium", "Tax")).unionByName(
        first_of("service", "service", "low", "Other")
    )


def zero_income(facts: DataFrame) -> DataFrame:
    """Health text, alert, recommendation and capped confidence where no income is recorded."""
    none = F.coalesce(F.col("income"), F.lit(0.0)) == 0
    lead = "Cannot be confirmed as no income is recorded in the data provided. "
    tail = F.coalesce(
        F.nullif(F.trim("health_text"), F.lit("")),
        F.lit("Expenses are dominated by transaction fees and VAT which may affect sustainability if revenue is not sufficient."),
    )
    noted = F.coalesce(F.lower("health_text").contains("no income recorded"), F.lit(False))
    return facts.withColumns(
        {
            "health_text": F.when(none & ~noted, F.concat(F.lit(lead), tail)).otherwise(F.col("health_text")),
            "alert": F.when(none, F.lit("income_missing")),
            "recommendation": F.when(
                none,
                F.lit("Ensure revenue sources are properly tracked and recorded to allow accurate financial analysis."),
            ),
            "confidence": F.when(none, F.least("confidence", F.lit(65))).otherwise(F.col("confidence")),
        }
    )


def spend_mix(df: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Top spending category, its share, spend under 'Other', and business-type marks."""
    cat = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Other"))
    desc, vendor = F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("vendor", F.lit("")))
    spent = df.where(F.col("amount") < 0).groupBy(*keys, cat.alias("category")).agg(
        F.sum(-F.col("amount")).alias("spend"),
        F.bool_or(desc.contains("transaction") | desc.contains("query") | (cat == "Transaction Fees")).alias("_fees"),
        F.bool_or(vendor.contains("software") | vendor.contains("gmbh")).alias("_soft"),
    )
    return spent.groupBy(*keys).agg(
        F.max(F.struct("spend", "category")).alias("_top"), F.sum("spend").alias("expenses"),
        F.sum(F.when(F.col("category") == "Other", F.col("spend")).otherwise(F.lit(0).cast("decimal(28,2)"))).alias("other_spend"),
        F.bool_or("_fees").alias("_fees"), F.bool_or("_soft").alias("_soft"),
    ).select(
        *keys, F.col("_top.category").alias("top_category"), F.col("_top.spend").alias("top_spend"), "expenses", "other_spend",
        ratio_or_zero(F.col("_top.spend"), F.col("expenses")).alias("top_share"), "_fees", "_soft",
    )


# Business type by top category above a 30 % share.
BUSINESS_TYPES = {
    "Software": "Technology/Software Company",
    "Professional": "Professional Services",
    "Marketing": "Marketing/Agency",
    "Equipment": "Manufacturing/Production",
}


def business_type(mix: DataFrame) -> DataFrame:
    """Business type from the expense mix."""
    share = dbl(F.col("top_spend")) > dbl(F.col("expenses")) * 0.3
    chain = F.when(F.col("_fees") & F.col("_soft"), "Software/Financial Services")
    for category, label in BUSINESS_TYPES.items():
        chain = chain.when((F.col("top_category") == category) & share, label)
    return mix.withColumn("business_type", chain.otherwise("General Business")).drop("_fees", "_soft")


def business_type_by_text(df: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Business type from the words of all descriptions of a key."""
    desc = F.lower("description")
    marks = df.groupBy(*keys).agg(
        F.bool_or(desc.rlike("consulting|service")).alias("_c"), F.bool_or(desc.rlike("software|license")).alias("_s"),
        F.bool_or(desc.rlike("office|supplies")).alias("_o"), F.bool_or(desc.rlike("client|payment")).alias("_p"),
    )
    return marks.select(
        *keys,
        F.when(F.col("_c"), "Consulting Services").when(F.col("_s"), "Software/Technology")
        .when(F.col("_o"), "General Business").when(F.col("_p"), "Service Provider").otherwise("General Business")
        .alias("business_type_text"),
    )
