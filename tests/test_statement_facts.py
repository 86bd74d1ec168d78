"""Sections derived from the additive facts equal those of the raw transactions, and facts of periods add up."""

from datetime import date

from pyspark.sql import functions as F

from tallyframe.operators import budget, cash, facts, statements, tax

SCHEMA = "tenant string, date date, amount decimal(18,2), category string, description string"
TEXTS = ["VAT 7.5% paper", "Loan for a car", "income tax 2022", "corporate tax 21%", "software licence", "debt payment 0%", "building", "", None]


def rows():
    out = []
    for i in range(240):
        amount = (None, 0, 120, -35, -7.5, 980)[i % 6]
        day = None if i % 31 == 0 else date(2022 + i % 2, 1 + i % 12, 1 + i % 28)
        out.append((f"t{i % 3}", day, amount, ("Office", "Tax", "VAT", None, "", "Travel", "Income")[i % 7], TEXTS[i % 9]))
    return out


def same(got, want):
    key = lambda df: sorted(tuple(str(float(v)) if hasattr(v, "as_tuple") else str(v) for v in r) for r in df.select(*sorted(want.columns)).collect())
    assert key(got) == key(want)


def test_sections_equal_those_of_the_rows(spark):
    from decimal import Decimal

    data = [(t, d, None if a is None else Decimal(str(a)), c, x) for t, d, a, c, x in rows()]
    df = spark.createDataFrame(data, SCHEMA)
    f = facts.statement_facts(df)
    entries = tax.tax_entries(df, "2023-05-20")
    pairs = {
        "cash": (facts.cash(f), cash.cash_totals(df)), "spending": (facts.spending(f), budget.actuals(df)),
        "assets": (facts.assets(f), statements.assets_liabilities(statements.asset_liability_rows(df))),
        "debts": (facts.debts(f), cash.debt_totals(df)), "taxes": (facts.taxes(f, "2023-05-20"), tax.tax_totals(entries)),
    }
    for got, want in pairs.values():
        assert want.count() > 0
        same(got, want)
    due = tax.deadlines(entries, "2023-05-20", 30).groupBy("tenant").agg(
        F.count(F.when(F.col("kind") == "upcoming", 1)).alias("upcoming"), F.count(F.when(F.col("kind") == "overdue", 1)).alias("overdue"))
    same(facts.taxes(f, "2023-05-20").where("upcoming + overdue > 0"), due)
    # two periods add up to the whole, and the sum can be added to again
    early = F.coalesce(F.col("date") < "2023-01-01", F.lit(True))
    halves = facts.merged(facts.statement_facts(df.where(early)), facts.statement_facts(df.where(~early)))
    same(halves, f)
    assert halves.schema == f.schema or [x.dataType for x in halves.schema] == [x.dataType for x in f.schema]
    assert facts.statement_facts(df.limit(0)).count() == 0


def test_outlook_by_hand(spark):
    """Thirteen months: the first is beyond the last twelve; a tenant of one month has no trend."""
    data = [("a", date(2022 + m // 12, 1 + m % 12, 5), 1000 + 100 * (m == 12), "Income", "x") for m in range(13)]
    data += [("a", date(2022, 1, 9), -990_000, "Other", "x"), ("b", date(2023, 3, 1), -50, "Other", "x")]
    df = spark.createDataFrame([(t, d, a, c, x) for t, d, a, c, x in data], "tenant string, date date, amount int, category string, description string")
    got = {r["tenant"]: r for r in facts.outlook(facts.statement_facts(df.withColumn("amount", F.col("amount").cast("decimal(18,2)")))).collect()}
    mean = 12_100 / 12
    assert got["a"]["buckets"] == 12 and abs(got["a"]["next_income"] - mean * 1.1) < 0.001 and got["a"]["next_expense"] == 0
    assert got["a"]["income_direction"] == "increasing" and got["b"]["next_expense"] == 50 and got["b"]["total_net"] == -50
