"""Report assembly: key metrics, overall health, confidence, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.constants import REPORT_WEIGHTS

# Module names as data sources.
SOURCES = {
    "cash": "Cashflow Manager", "budget": "Budgeting Tool", "assets": "Assets & Liabilities Manager",
    "debts": "Debts & Loans Manager", "tax": "Taxes & VAT Manager", "forecast": "Forecasting Tool",
}


def health(signals: DataFrame) -> DataFrame:
    """Overall health per tenant from high alerts and positive highlights."""
    high = F.count(F.when((F.col("kind") == "alert") & (F.col("severity") == "high"), 1))
    positive = F.count(F.when((F.col("kind") == "highlight") & F.col("type").contains("positive"), 1))
    s = signals.groupBy("tenant").agg(high.alias("high_alerts"), positive.alias("positive_highlights"))
    h, p = F.col("high_alerts"), F.col("positive_highlights")
    return s.withColumn(
        "overall_health",
        F.when((h == 0) & (p > 0), "excellent").when((h <= 1) & (p > 0), "good").when(h <= 2, "fair").otherwise("poor"),
    )


def confidence(modules: list[str]) -> int:
    """Mean weight of the modules present, in percent."""
    known = [REPORT_WEIGHTS[m] for m in modules if m in REPORT_WEIGHTS]
    return int(sum(known) / len(known) * 100 + 0.5) if known else 0


def assemble(cash: DataFrame, budget: DataFrame, assets: DataFrame, debts: DataFrame, taxes: DataFrame, outlook: DataFrame,
             signals: DataFrame, period: Column) -> DataFrame:
    """One row per tenant of ``cash``: key metrics of the six modules, health, sources, confidence.

    A tenant without debts or taxes has 0 there; without a budget, classified rows or months it
    has NULL in those sections.
    """
    modules = list(SOURCES)
    b = budget.select("tenant", F.col("budget").alias("total_budget"), F.col("actual").alias("total_actual"), F.col("variance").alias("budget_variance"))
    a = assets.select("tenant", "total_assets", "total_liabilities", "net_worth", "debt_to_asset")
    owed = ["debt_payments", "loan_proceeds"]
    due = ["total_taxes", "total_vat", "total_net", "effective_tax_rate", "effective_vat_rate"]
    t = taxes.select("tenant", *[F.col(c).cast("double").alias(c) for c in due]).withColumnRenamed("total_net", "taxed_net")
    f = outlook.select("tenant", "next_income", "next_expense", F.col("total_net").alias("next_net"), "income_direction", "expense_direction")
    out = cash
    for part in (b, a, debts.select("tenant", *[F.col(c).cast("double").alias(c) for c in owed]), t, f, health(signals)):
        out = out.join(part, "tenant", "left")
    none = [*owed, *["taxed_net" if c == "total_net" else c for c in due]]
    return out.fillna(0.0, none).withColumns({
        "overall_health": F.coalesce("overall_health", F.lit("fair")), "period": period,
        "sources": F.lit(", ".join(SOURCES[m] for m in modules)), "confidence": F.lit(confidence(modules)),
    })


def recommendations(signals: DataFrame, report: DataFrame) -> DataFrame:
    """Module recommendations plus two from the overall figures, high priority first."""
    ours = signals.where(F.col("kind") == "recommendation").select("tenant", "type", F.col("severity").alias("priority"), "category")
    cells = F.array_compact(F.array(
        F.when(F.col("net") < 0, F.struct(F.lit("cashflow_improvement").alias("type"), F.lit("high").alias("priority"), F.lit("Cashflow").alias("category"))),
        F.when(F.col("debt_to_asset") > 0.8, F.struct(F.lit("debt_reduction").alias("type"), F.lit("high").alias("priority"), F.lit("Debt Management").alias("category"))),
    ))
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    return ours.unionByName(report.select("tenant", F.inline(cells))).withColumn("rank", rank).orderBy("tenant", F.desc("rank"), "type", "category")
