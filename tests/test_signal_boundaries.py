"""Every numeric threshold of the signal rules: below, at and above it, from numbers written out here."""

import pytest

from tallyframe.operators import signals

INCOME = {"income": 1000.0, "expenses": 300.0, "net": 700.0, "other_spend": 0.0, "txn_count": 3}
ASSETS = {"debt_to_asset": 0.5, "total_liabilities": 50.0, "total_assets": 100.0, "net_worth": 10.0, "asset_kinds": 4, "asset_count": 6, "liability_kinds": 2, "liability_count": 4}
BUDGET = {"utilisation": 0.85, "variance": -5.0, "variance_pct": 30.0}
TREND = {"total_net": 1.0, "net_direction": "stable", "net_trend": 0.0, "expense_direction": "increasing", "expense_trend": 0.0, "income_direction": "increasing", "income_trend": 0.0}
TAX = {"effective_tax_rate": 0.2, "total_taxes": 1.0, "upcoming": 0, "upcoming_amount": 0.0, "overdue": 0, "total_vat": 1.0, "vat_paid_share": 0.5}
MONEY = {"hhi": 0.4, "diversification": 0.5, "volatility": "medium", "currencies": 2}
PL = {"net_income": 1.0, "gross_margin": 30.0, "gross_profit": 1.0, "expense_ratio": 50.0, "net_margin": 5.0}
BS = {"current_ratio": 1.5, "debt_to_equity": 1.0, "balanced": True, "total_assets": 1.0, "total_liabilities": 0.5, "total_equity": 0.5, "equity_ratio": 0.4}
LEDGER = {"balanced": True, "debits": 1.0, "credits": 1.0, "accounts": 1, "txn_count": 10}

# module, signal, facts, changed fact, threshold, and whether the signal is there below, at and above it
CASES = [
    ("health", "expense_high", INCOME, "expenses", 500.0, (0, 0, 1)),
    ("health", "income_strong", INCOME, "expenses", 500.0, (1, 0, 0)),
    ("health", "low_expense_ratio", INCOME, "expenses", 300.0, (1, 0, 0)),
    ("health", "high_profit_margin", INCOME, "net", 500.0, (0, 0, 1)),
    ("health", "negative_cashflow", INCOME, "net", 0.0, (1, 0, 0)),
    ("basic", "expense_alert", INCOME, "expenses", 800.0, (0, 0, 1)),
    ("basic", "categorization_alert", INCOME, "other_spend", 60.0, (0, 0, 1)),
    ("basic", "cashflow_alert", INCOME, "net", 0.0, (1, 0, 0)),
    ("basic", "high_profit_margin", INCOME, "net", 500.0, (0, 0, 1)),
    ("assets", "high_debt_ratio", ASSETS, "debt_to_asset", 0.8, (0, 0, 1)),
    ("assets", "low_debt_ratio", ASSETS, "debt_to_asset", 0.3, (1, 0, 0)),
    ("assets", "negative_net_worth", ASSETS, "net_worth", 0.0, (1, 0, 0)),
    ("assets", "strong_net_worth", ASSETS, "net_worth", 50.0, (0, 0, 1)),
    ("assets", "low_asset_diversity", ASSETS, "asset_kinds", 3, (1, 0, 0)),
    ("assets", "low_asset_diversity", ASSETS | {"asset_kinds": 2}, "asset_count", 5, (0, 0, 1)),
    ("assets", "high_liability_concentration", ASSETS, "liability_kinds", 2, (1, 0, 0)),
    ("assets", "high_liability_concentration", ASSETS | {"liability_kinds": 1}, "liability_count", 3, (0, 0, 1)),
    ("assets", "good_asset_diversity", ASSETS, "asset_kinds", 5, (0, 1, 1)),
    ("assets", "positive_net_worth_growth", ASSETS, "total_assets", 100.0, (0, 0, 1)),
    ("budget", "budget_exceeded", BUDGET, "utilisation", 0.95, (0, 1, 1)),
    ("budget", "spending_trend_warning", BUDGET, "utilisation", 0.8, (0, 0, 1)),
    ("budget", "spending_trend_warning", BUDGET, "variance_pct", 20.0, (0, 0, 1)),
    ("budget", "under_budget", BUDGET, "utilisation", 0.8, (1, 0, 0)),
    ("budget", "consistent_spending", BUDGET, "utilisation", 0.7, (0, 1, 1)),
    ("budget", "consistent_spending", BUDGET, "utilisation", 0.9, (1, 1, 0)),
    ("budget", "reduce_spending", BUDGET, "utilisation", 1.0, (0, 0, 1)),
    ("forecast", "negative_cashflow_forecast", TREND, "total_net", 0.0, (1, 0, 0)),
    ("forecast", "positive_cashflow_forecast", TREND, "total_net", 0.0, (0, 0, 1)),
    ("forecast", "declining_trend_forecast", TREND | {"net_direction": "decreasing"}, "net_trend", -20.0, (1, 0, 0)),
    ("forecast", "high_expense_growth_forecast", TREND, "expense_trend", 30.0, (0, 0, 1)),
    ("forecast", "expense_control", TREND, "expense_trend", 20.0, (0, 0, 1)),
    ("forecast", "stable_trend_forecast", TREND, "net_trend", 10.0, (1, 0, 0)),
    ("forecast", "income_growth_forecast", TREND, "income_trend", 10.0, (0, 0, 1)),
    ("forecast", "growth_management", TREND, "income_trend", 15.0, (0, 0, 1)),
    ("tax", "high_tax_burden", TAX, "effective_tax_rate", 0.30, (0, 0, 1)),
    ("tax", "low_tax_burden", TAX, "effective_tax_rate", 0.15, (1, 0, 0)),
    ("tax", "upcoming_tax_deadlines", TAX, "upcoming", 0, (0, 0, 1)),
    ("tax", "overdue_tax_payments", TAX, "overdue", 0, (0, 0, 1)),
    ("tax", "vat_registration_threshold", TAX, "total_vat", 85000.0, (0, 0, 1)),
    ("tax", "good_vat_compliance", TAX, "vat_paid_share", 0.9, (0, 0, 1)),
    ("currency", "high_concentration_risk", MONEY, "hhi", 0.5, (0, 0, 1)),
    ("currency", "low_diversification", MONEY, "diversification", 0.3, (1, 0, 0)),
    ("currency", "good_diversification", MONEY, "diversification", 0.7, (0, 0, 1)),
    ("currency", "multiple_currencies", MONEY, "currencies", 3, (0, 1, 1)),
    ("pl", "net_loss", PL, "net_income", 0.0, (1, 0, 0)),
    ("pl", "low_gross_margin", PL, "gross_margin", 20.0, (1, 0, 0)),
    ("pl", "strong_gross_margin", PL, "gross_margin", 50.0, (0, 0, 1)),
    ("pl", "high_expense_ratio", PL, "expense_ratio", 90.0, (0, 0, 1)),
    ("pl", "healthy_profit_margin", PL, "net_margin", 10.0, (0, 0, 1)),
    ("pl", "operating_loss", PL, "gross_profit", 0.0, (1, 0, 0)),
    ("bs", "low_current_ratio", BS, "current_ratio", 1.0, (1, 0, 0)),
    ("bs", "strong_liquidity", BS, "current_ratio", 2.0, (0, 0, 1)),
    ("bs", "high_debt_to_equity", BS, "debt_to_equity", 2.0, (0, 0, 1)),
    ("bs", "strong_equity_position", BS, "equity_ratio", 0.5, (0, 0, 1)),
    ("ledger", "comprehensive_ledger", LEDGER, "txn_count", 50, (0, 0, 1)),
]


@pytest.mark.parametrize("module", sorted({c[0] for c in CASES}))
def test_thresholds(spark, module):
    rows, want = [], {}
    for i, (_, kind, facts, fact, limit, expected) in enumerate(c for c in CASES if c[0] == module):
        step = 1 if isinstance(limit, int) else max(abs(limit), 1.0) / 1000
        for k, value in enumerate((limit - step, limit, limit + step)):
            rows.append({"tenant": f"{i}/{k}", **facts, fact: value})
            want[f"{i}/{k}", kind] = bool(expected[k])
    facts = spark.createDataFrame(rows)
    got = {(r["tenant"], r["type"]) for r in signals.emit(facts, module).collect()}
    assert {key: key in got for key in want} == want
