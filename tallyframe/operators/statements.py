"""Profit and loss, balance sheet, assets and liabilities, basic statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.constants import ASSET_LIABILITY_RULES
from tallyframe.functions.money import dbl, inflow, outflow, percent_or_zero, ratio, ratio_or_zero, rounded, total
from tallyframe.functions.rules import first_match


def count_confidence(count: Column) -> Column:
    """60, 75, 85 or 95 by number of transactions."""
    return F.when(count < 10, 60).when(count < 50, 75).when(count < 100, 85).otherwise(95)


def profit_loss(df: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Statement per key: every expense is cost of goods sold, tax is 20 % of a profit."""
    amount = F.col("amount")
    base = df.groupBy(*keys).agg(
        total(inflow(amount)).alias("revenue"), total(outflow(amount)).alias("cogs"), F.count("*").alias("txn_count")
    )
    revenue = F.col("revenue")
    money = base.withColumn("gross_profit", revenue - F.col("cogs")).withColumn(
        "taxes", F.when(F.col("gross_profit") > 0, dbl(F.col("gross_profit")) * 0.2).otherwise(F.lit(0.0))
    )
    gross, net = dbl(F.col("gross_profit")), F.col("net_income")
    return (
        money.withColumn("net_income", rounded(gross - F.col("taxes"), 4))
        .withColumn("taxes", rounded("taxes", 4))
        .withColumn("gross_margin", percent_or_zero(F.col("gross_profit"), revenue))
        .withColumn("operating_margin", F.col("gross_margin"))
        .withColumn("net_margin", percent_or_zero(net, revenue))
        .withColumn("expense_ratio", percent_or_zero(dbl(revenue) - net, revenue))
        .withColumn("tax_rate", F.when(F.col("gross_profit") > 0, F.lit(20.0)).otherwise(F.lit(0.0)))
        .withColumn("confidence", count_confidence(F.col("txn_count")))
    )


def balance_sheet(df: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Assets are cash (net, not below 0) and fixed assets bought; liabilities are 0."""
    amount, category = F.col("amount"), F.col("category")
    spend = outflow(amount)
    zero = F.lit(0).cast("decimal(18,2)")

    def spent(condition: Column) -> Column:
        return total(F.when(condition, spend).otherwise(zero))

    base = df.groupBy(*keys).agg(
        total(amount).alias("_net"),
        spent(category == "Equipment").alias("equipment"),
        spent(F.lower("description").contains("furniture")).alias("furniture"),
        spent(category == "Software").alias("computer_software"),
        F.count("*").alias("txn_count"),
    )
    floor0 = F.greatest(F.col("_net"), F.lit(0).cast("decimal(28,2)"))
    sheet = (
        base.withColumn("cash", floor0)
        .withColumn("retained_earnings", floor0)
        .withColumn("fixed_assets", F.col("equipment") + F.col("furniture") + F.col("computer_software"))
        .withColumn("total_assets", F.col("cash") + F.col("fixed_assets"))
        .withColumn("total_liabilities", F.lit(0.0))
        .withColumn("total_equity", F.col("retained_earnings"))
    )
    assets, liabilities, equity = F.col("total_assets"), F.col("total_liabilities"), F.col("total_equity")
    return sheet.drop("_net").select(
        "*",
        (F.abs(assets - equity) < 0.01).alias("balanced"),
        F.when(assets > 0, ratio(dbl(assets) * 0.4, liabilities * 0.6)).otherwise(F.lit(0.0)).alias("current_ratio"),
        ratio_or_zero(liabilities, equity).alias("debt_to_equity"),
        ratio_or_zero(liabilities, assets).alias("debt_to_asset"),
        ratio_or_zero(equity, assets).alias("equity_ratio"),
        count_confidence(F.col("txn_count")).alias("confidence"),
    )


def last_rows(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows per key; the rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def balance_estimates(df: DataFrame, keys: Sequence[str] = ("tenant",), n: int = 30) -> DataFrame:
    """Estimate columns from totals and from the last ``n`` qualifying rows."""
    amount, category = F.col("amount"), F.col("category")
    spend, zero = outflow(amount), F.lit(0).cast("decimal(18,2)")
    whole = df.groupBy(*keys).agg(
        total(amount).alias("_net"),
        total(inflow(amount)).alias("_income"),
        total(F.when(category.isin("Rent", "Insurance", "Software"), spend).otherwise(zero)).alias("_prepaid"),
        total(F.when(category.isin("Rent", "Utilities", "Professional"), spend).otherwise(zero)).alias("_accrued"),
        total(F.when(category == "Equipment", spend).otherwise(zero)).alias("_equipment"),
        total(F.when(F.lower("description").contains("furniture"), spend).otherwise(zero)).alias("_furniture"),
        total(F.when(category == "Software", spend).otherwise(zero)).alias("_software"),
    )
    order = ["date", "txn_id", "amount"]

    def tail(condition: Column, name: str) -> DataFrame:
        rows = last_rows(df.where(condition).select(*keys, *order), n, keys, order)
        return rows.groupBy(*keys).agg(total(F.abs("amount")).alias(name))

    receivable = tail((amount > 0) & (category == "Income"), "_recent_income")
    stock = tail((amount < 0) & category.isin("Office", "Equipment", "Software"), "_recent_stock")
    payable = tail(amount < 0, "_recent_expense")
    out = whole
    for side in (receivable, stock, payable):
        out = out.join(side, list(keys), "left")

    def part(col: str, share: float) -> Column:
        return rounded(dbl(F.coalesce(F.col(col), F.lit(0))) * share, 4)

    fixed = dbl(F.col("_equipment") + F.col("_furniture") + F.col("_software"))
    positive = F.greatest(dbl(F.col("_net")), F.lit(0.0))
    return out.select(
        *keys,
        part("_recent_income", 0.2).alias("accounts_receivable"),
        part("_recent_stock", 0.3).alias("inventory"),
        part("_prepaid", 0.5).alias("prepaid_expenses"),
        rounded(fixed * 0.3, 4).alias("accumulated_depreciation"),
        part("_recent_expense", 0.15).alias("accounts_payable"),
        part("_accrued", 0.1).alias("accrued_expenses"),
        rounded(positive * 0.2, 4).alias("taxes_payable"),
        rounded(positive * 0.8, 4).alias("retained_earnings"),
        part("_income", 0.1).alias("owners_equity"),
        rounded(positive * 0.1, 4).alias("cash"),
    )


def classify_asset_liability(description: Column, amount: Column, category: Column) -> Column:
    """'asset:<kind>' or 'liability:<kind>' by keyword group, then category, then sign."""
    by_word = first_match(description, ASSET_LIABILITY_RULES, None)
    return F.coalesce(by_word, F.when(amount > 0, "asset:Other").otherwise("liability:Other"))


def asset_liability_rows(df: DataFrame) -> DataFrame:
    kind = classify_asset_liability(F.col("description"), F.col("amount"), F.coalesce("category", F.lit("Other")))
    valid = df.where(F.col("amount").isNotNull() & (F.col("amount") != 0))
    return (
        valid.withColumn("_k", kind)
        .withColumn("type", F.substring_index("_k", ":", 1))
        .withColumn("subcategory", F.substring_index("_k", ":", -1))
        .withColumn("value", F.abs("amount"))
        .drop("_k")
    )


def assets_liabilities(rows: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    return totals_of_kinds(rows.groupBy(*keys, "type", "subcategory").agg(
        total(F.col("value")).alias("_v"), F.count("*").alias("_n")
    ), keys)


def totals_of_kinds(sums: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Totals, counts and ratios from value (``_v``) and count (``_n``) per type and subcategory."""
    is_asset, zero = F.col("type") == "asset", F.lit(0).cast("decimal(18,2)")
    return sums.groupBy(*keys).agg(
        total(F.when(is_asset, F.col("_v")).otherwise(zero)).alias("total_assets"),
        total(F.when(is_asset, zero).otherwise(F.col("_v"))).alias("total_liabilities"),
        F.sum(F.when(is_asset, F.col("_n")).otherwise(0)).alias("asset_count"),
        F.sum(F.when(is_asset, 0).otherwise(F.col("_n"))).alias("liability_count"),
        F.count(F.when(is_asset, 1)).alias("asset_kinds"),
        F.count(F.when(~is_asset, 1)).alias("liability_kinds"),
    ).withColumn("net_worth", F.col("total_assets") - F.col("total_liabilities")).withColumn(
        "debt_to_asset", ratio_or_zero(F.col("total_liabilities"), F.col("total_assets"))
    )


def asset_breakdown(rows: DataFrame, keys: Sequence[str] = ("tenant",)) -> DataFrame:
    """Count, total and share per subcategory."""
    sums = rows.groupBy(*keys, "type", "subcategory").agg(
        F.count("*").alias("n"), total(F.col("value")).alias("total_value")
    )
    share = F.sum("total_value").over(Window.partitionBy(*keys, "type"))
    return sums.withColumn("share", ratio(F.col("total_value"), share))


def networth_rows(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Asset and liability rows of the last ``days`` days."""
    return rows.where(F.col("date") >= F.date_sub(as_of, days))


def basic_statements(totals: DataFrame) -> DataFrame:
    """Simple statement columns derived from cash totals (inflow, outflow)."""
    income, expenses = dbl(F.col("inflow")), dbl(F.col("outflow"))
    net = dbl(F.col("net"))
    keep = F.greatest(net, F.lit(0.0))
    r4 = lambda c: rounded(c, 4)
    margin = F.when(income > 0, rounded(net / income * 100, 6)).otherwise(F.lit(0.0))
    return totals.select(
        "*",
        # balance sheet
        keep.alias("bs_assets"), net.alias("bs_equity"), F.lit(None).cast("double").alias("bs_current_ratio"),
        rounded(F.try_divide(F.lit(0.0), net), 2).alias("bs_debt_to_equity"),
        rounded(F.try_divide(net, keep) * 100, 2).alias("bs_return_on_assets"),
        # profit and loss
        income.alias("pl_revenue"), expenses.alias("pl_cogs"), net.alias("pl_net_income"), margin.alias("pl_margin"),
        # assets and liabilities
        r4(income * 0.3).alias("al_current_assets"), r4(income * 0.5).alias("al_fixed_assets"),
        r4(income * 0.8).alias("al_total_assets"), r4(expenses * 0.2).alias("al_current_liabilities"),
        r4(expenses * 0.3).alias("al_longterm_liabilities"), r4(expenses * 0.5).alias("al_total_liabilities"),
        r4(income * 0.8 - expenses * 0.5).alias("al_equity"),
        # budget
        r4(income / 12).alias("bu_monthly_income"), r4(expenses / 12).alias("bu_monthly_expenses"),
        r4(income / 12 - expenses / 12).alias("bu_savings"), r4(income - expenses).alias("bu_remaining"),
        r4(expenses / 12 * 0.6).alias("bu_fixed"), r4(expenses / 12 * 0.3).alias("bu_variable"),
        r4(expenses / 12 * 0.1).alias("bu_discretionary"),
        # forecast
        r4(income * (1 + 0.05 / 12)).alias("fc_next_month"), r4(income * (1 + 0.05 / 4)).alias("fc_next_quarter"),
        r4(income * 1.05).alias("fc_next_year"), r4(income * F.pow(F.lit(1.05), F.lit(3))).alias("fc_long_term"),
    )
