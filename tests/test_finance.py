"""Pinned numbers and invariants of the finance operators on small inline tables."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import budget, cash, clean, currency, forecast, ledger, statements, tax
from tallyframe.operators.running import median, position, running_total

TXN = "txn_id string, tenant string, date date, description string, amount decimal(18,2), currency string, category string"


def txns(spark, rows):
    full = [(f"t{i:03d}", "a", d, desc, None if a is None else D(a), cur, cat) for i, (d, desc, a, cur, cat) in enumerate(rows)]
    return spark.createDataFrame(full, TXN)


CASH5 = [
    (date(2024, 1, 1), "Office Supplies", "-150.00", "EUR", "Office"),
    (date(2024, 1, 2), "Client Payment - ABC Corp", "2500.00", "EUR", "Income"),
    (date(2024, 1, 3), "Software License", "-99.00", "EUR", "Software"),
    (date(2024, 1, 4), "Internet Service", "-89.99", "EUR", "Utilities"),
    (date(2024, 1, 5), "Client Payment - XYZ Ltd", "1800.00", "EUR", "Income"),
]
BUDGET5 = [
    (date(2024, 1, 3), f"row {c}", a, "EUR", c)
    for c, a in (("Office", "-150.00"), ("Software", "-99.00"), ("Utilities", "-89.99"), ("Marketing", "-500.00"), ("Professional", "-300.00"))
]


def test_cash_totals(spark):
    row = cash.cash_totals(txns(spark, CASH5)).first()
    assert (row.inflow, row.outflow, row.net, row.txn_count) == (D("4300.00"), D("338.99"), D("3961.01"), 5)


def test_cash_counts_null_and_zero_rows_and_unknown_day(spark):
    df = txns(spark, CASH5 + [(None, "x", "0.00", "EUR", "Office"), (date(2024, 1, 5), "y", None, "EUR", "Office")])
    assert cash.cash_totals(df).first().txn_count == 7
    assert {r.day for r in cash.cash_daily(df).collect()} >= {"unknown", "2024-01-05"}


def test_invalid_period_raises(spark):
    with pytest.raises(ValueError):
        cash.cash_period(txns(spark, CASH5), "decade", "2024-01-01")


def test_cash_calendar_parts_add_up(spark):
    rows = cash.cash_calendar(txns(spark, CASH5)).collect()
    for grain in ("day", "week", "month", "all"):
        assert sum(r.net for r in rows if r.grain == grain) == D("3961.01")


def test_last_running_balance_is_total(spark):
    df = txns(spark, CASH5)
    rows = cash.running_cash_rows(df, ranges=2).orderBy("date").collect()
    assert rows[-1].balance == D("3961.01")
    assert [r.balance for r in rows] == [D("-150.00"), D("2350.00"), D("2251.00"), D("2161.01"), D("3961.01")]


def test_running_total_with_a_hot_key_matches_brute_force(spark):
    data = [("hot" if i % 3 else f"k{i % 7}", i % 5, (i * 37) % 11, i, (i * 7919) % 101 - 50) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, day int, blk int, id int, v int").repartition(5)
    got = {(r.k, r.id): r.run for r in running_total(df, ["k"], ["day", "blk", "id"], F.col("v"), "run", "bigint").collect()}
    want = {}
    sums: dict = {}
    for k, day, blk, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2], r[3])):
        sums[k] = sums.get(k, 0) + v
        want[(k, i)] = sums[k]
    assert got == want


def test_position_counts_every_row_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") / 100).cast("int").alias("b"), "id")
    rows = position(df, ["k"], ["b", "id"], "pos").collect()
    for key in range(3):
        assert sorted(r.pos for r in rows if r.k == key) == list(range(1, sum(r.k == key for r in rows) + 1))


@pytest.mark.parametrize("n", [1, 2, 5, 8, 999, 1000])
def test_median_is_exact(spark, n):
    values = [D((i * 7919) % 100003) / 100 for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v decimal(18,2)").repartition(4)
    ordered = sorted(values)
    want = float(ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert abs(median(df, ["k"], "v", width=10).first()["median"] - want) < 1e-9


def test_trial_balance_is_balanced_and_chart_is_complete(spark):
    balances = ledger.account_balances(ledger.double_entry(txns(spark, CASH5)))
    assert balances.count() == 28
    total = ledger.trial_balance(balances).where("account = 'TOTAL'").first()
    assert total.balanced and total.debit_balance == total.credit_balance


def test_balances_from_sums_equal_balances_from_entries(spark):
    df = txns(spark, CASH5 + [(date(2024, 1, 6), "Consulting service", "10.00", "EUR", "x"), (date(2024, 1, 6), "z", "0.00", "EUR", "Rent")])
    a = ledger.account_balances(ledger.double_entry(df)).select("account", "debit_total", "credit_total", "balance")
    b = ledger.transaction_balances(df).select("account", "debit_total", "credit_total", "balance")
    assert sorted(a.collect()) == sorted(b.collect())


def test_zero_amount_takes_the_expense_branch(spark):
    rows = ledger.double_entry(txns(spark, [(date(2024, 1, 1), "x", "0.00", "EUR", "Rent")])).collect()
    assert {r.account for r in rows} == {"5200", "1000"}


def test_profit_and_loss(spark):
    row = statements.profit_loss(txns(spark, CASH5)).first()
    assert abs(row.net_income - 3961.01 * 0.8) < 1e-6 and row.confidence == 60


def test_credit_card_is_a_vehicle(spark):
    df = txns(spark, [(date(2024, 1, 1), "Credit Card", "-10.00", "EUR", "Other")])
    row = statements.asset_liability_rows(df).first()
    assert (row.type, row.subcategory) == ("asset", "Vehicle")


def test_budget_defaults_and_totals(spark):
    spend = budget.actuals(txns(spark, BUDGET5))
    perf = budget.performance(budget.budget_actual(spend))
    assert perf.count() == 8
    assert perf.agg(F.sum("monthly")).first()[0] == D("4100.00")
    total = budget.overall(spend, budget.tenant_budgets(spend)).first()
    assert total.actual == D("1138.99") and total.month == "2024-01"


def test_budget_without_spend_counts_zero(spark):
    spend = budget.actuals(txns(spark, BUDGET5))
    plan = spark.createDataFrame([("a", "Office", D("500")), ("a", "Software", D("200"))], "tenant string, category string, monthly decimal(18,2)")
    rows = budget.performance(budget.budget_actual(spend, plan, month="2023-05"))
    assert rows.agg(F.sum("monthly"), F.sum("variance")).first()[:] == (D("700.00"), D("-700.00"))


def test_budget_status_bounds(spark):
    df = spark.createDataFrame([(0.95,), (0.8,), (0.5,), (0.6,)], "u double")
    assert [r[0] for r in df.select(budget.budget_status(F.col("u"))).collect()] == ["critical", "warning", "underutilized", "healthy"]


def test_conversion_rounds_half_up_and_keeps_unknown(spark):
    df = txns(spark, [(date(2024, 1, 1), "a", "118.00", "USD", "x"), (date(2024, 1, 1), "b", "5.00", "XXX", "x")])
    rates = spark.createDataFrame([("EUR", 1.0), ("USD", 1.18)], "currency string, rate double")
    got = {r.currency: (r.converted_amount, r.was_converted) for r in currency.convert(df, rates).collect()}
    assert got == {"USD": (D("100.00"), True), "XXX": (D("5.00"), False)}


def test_rate_as_of_uses_the_last_rate_before(spark):
    df = txns(spark, [(date(2024, 1, 31), "a", "10.00", "USD", "x"), (date(2024, 2, 1), "b", "10.00", "USD", "x"), (date(2023, 1, 1), "c", "10.00", "USD", "x")])
    rates = spark.createDataFrame(
        [("EUR", date(2020, 1, 1), 1.0), ("USD", date(2024, 1, 1), 2.0), ("USD", date(2024, 2, 1), 4.0)], "currency string, valid_from date, rate double"
    )
    got = [r.converted_amount for r in currency.convert_as_of(df, rates).orderBy("txn_id").collect()]
    assert got == [D("5.00"), D("2.50"), D("10.00")]


def test_shares_sum_to_one_hundred(spark):
    df = txns(spark, [(date(2024, 1, 1), "a", a, c, "x") for a, c in (("10", "EUR"), ("-30", "USD"), ("60", "GBP"))])
    e = currency.exposure(df)
    assert abs(e.agg(F.sum("share_pct")).first()[0] - 100) < 1e-6
    assert abs(currency.concentration(e).first().hhi - (0.01 + 0.09 + 0.36)) < 1e-6


def test_short_words_hit_social_security(spark):
    df = txns(spark, [(date(2024, 1, 1), "Evening course", "-112.00", "EUR", "Other"), (date(2024, 1, 1), "Plain", "-1.00", "EUR", "Other")])
    rows = tax.tax_entries(df, "2024-05-20").collect()
    assert [(r.subcategory, float(r.tax_part)) for r in rows] == [("Social Security", 12.0)]


def test_week_number_counts_from_sunday(spark):
    from datetime import timedelta

    from tallyframe.functions.periods import week_number

    days = [date(2023, 1, 1) + timedelta(days=i) for i in range(800)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", week_number(F.col("d")).alias("w"))
    for r in df.collect():
        first = date(r.d.year, 1, 1)
        assert r.w == -(-((r.d - first).days + (first.weekday() + 1) % 7 + 1) // 7)


def test_forecast_needs_two_buckets_for_a_trend(spark):
    base = forecast.daily_base(txns(spark, CASH5[:1]))
    rows = forecast.horizon_forecast(base, "short").collect()
    assert len(rows) == 30 and all(r.expense == 150.0 for r in rows)


def test_outlier_flag(spark):
    df = txns(spark, [(date(2024, 1, 1), "a", a, "EUR", "x") for a in ("1.00", "2.00", "3.00", "-25.00")])
    flagged = clean.flag_outliers(df).where("flag_reason is not null").collect()
    assert [r.amount for r in flagged] == []
    df = txns(spark, [(date(2024, 1, 1), "a", a, "EUR", "x") for a in ("1.00", "2.00", "3.00", "-26.00")])
    assert [r.amount for r in clean.flag_outliers(df).where("flag_reason is not null").collect()] == [D("-26.00")]


def test_rows_with_null_keys_stay(spark):
    """Running totals, positions, duplicate marks, outlier flags and conversion lose no row to a NULL key."""
    from pyspark.sql import functions as F

    from tallyframe.operators import clean, currency, invoice_rules
    from tallyframe.operators.running import position, running_total

    rows = spark.createDataFrame(
        [("a", "2024-01-01", 1, 2.0), ("a", None, 2, 3.0), (None, "2024-01-01", 3, 5.0), (None, None, 4, 7.0), ("a", None, 5, 11.0)],
        "tenant string, day string, k int, amount double",
    )
    got = {r["k"]: r["run"] for r in running_total(rows, ["tenant"], ["day", "k"], F.col("amount"), "run").collect()}
    assert {k: float(v) for k, v in got.items()} == {1: 16.0, 2: 3.0, 3: 12.0, 4: 7.0, 5: 14.0}
    assert {r["k"]: r["p"] for r in position(rows, ["tenant"], ["day", "k"], "p").collect()} == {1: 3, 2: 1, 3: 2, 4: 1, 5: 2}

    invoices = spark.createDataFrame(
        [(1, "h", "2024-01-01"), (2, "h", "2024-01-09"), (3, None, "2024-01-09"), (4, None, "2024-01-10"), (5, "h", None)],
        "invoice_id int, duplicate_hash string, invoice_date string",
    ).withColumn("invoice_date", F.col("invoice_date").cast("date"))
    marks = {r["invoice_id"]: r["is_duplicate"] for r in invoice_rules.duplicates(invoices).collect()}
    assert marks == {1: False, 2: True, 3: False, 4: False, 5: False}

    priced = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 99.0), ("a", None), (None, 5.0)], "tenant string, amount double")
    flagged = clean.flag_outliers(priced.withColumn("amount", F.col("amount").cast("decimal(18,2)"))).collect()
    assert len(flagged) == 5 and sum(r["flag_reason"] is not None for r in flagged) == 1

    money = spark.createDataFrame([(None, 10.0), ("USD", 10.0)], "currency string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    rates = spark.createDataFrame([("EUR", 0.5), ("USD", 1.0)], "currency string, rate double")
    assert {r["currency"]: float(r["converted_amount"]) for r in currency.convert(money, rates, "USD").collect()} == {"EUR": 20.0, "USD": 10.0}


def test_append_files_follow_size(spark, tmp_path):
    """One small day of one tenant is one file; nothing is cut."""
    from pyspark.sql import functions as F

    from tallyframe.sources import sinks

    rows = spark.range(500).select(
        F.col("id").cast("string").alias("txn_id"), F.lit("t").alias("tenant"), F.lit("2024-01-01").cast("date").alias("date"),
        F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("currency"),
    )
    sinks.append_transactions(rows, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("part-*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "t")).where("currency = 'EUR'").count() == 500
