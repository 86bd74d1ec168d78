"""Currency reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import currency
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, table, transactions

# Current rates against EUR; JPY and CHF dated in half-years.
RATES = {"EUR": 1.0, "USD": 1.18, "GBP": 0.85, "JPY": 130.5}
DATED = [
    (c, f"{y}-{m}-01", round(base * (1 + 0.01 * (y - 1992)) + (0.005 if m == "07" else 0.0), 4))
    for c, base in (("EUR", 1.0), ("USD", 1.1), ("GBP", 0.8), ("JPY", 120.0), ("CHF", 1.6))
    for y in range(1993, 2002)
    for m in ("01", "07")
]
SQL_RATES = "rates(currency, rate) AS (VALUES " + ", ".join(f"('{c}', CAST({r} AS DOUBLE))" for c, r in RATES.items()) + ")"
SQL_DATED = "dated(currency, valid_from, rate) AS (VALUES " + ", ".join(
    f"('{c}', DATE '{v}', CAST({r} AS DOUBLE))" for c, v, r in DATED
) + ")"


def rates(spark):
    return spark.createDataFrame(list(RATES.items()), "currency string, rate double")


def dated_rates(spark):
    return spark.createDataFrame(DATED, "currency string, valid_from string, rate double").withColumn(
        "valid_from", F.col("valid_from").cast("date")
    )


def txn(spark, d):
    """Transactions of which the yen ones name no currency: they count as base currency."""
    t = transactions(spark, d, "tenant", "txn_id", "date", "amount", "currency")
    return t.withColumn("currency", F.when(F.col("currency") != "JPY", F.col("currency")))


#: The same for the checks.
BASED = "based AS (SELECT * REPLACE (CASE WHEN currency = 'JPY' THEN 'EUR' ELSE currency END AS currency) FROM txn)"


CONV = f"""{TXN}, {BASED}, {SQL_RATES}, cv AS (SELECT tenant, txn_id, t.currency, amount, f.rate AS fr, 1.18 AS tr,
  t.currency <> 'USD' AND f.rate IS NOT NULL AS was_converted FROM based t LEFT JOIN rates f ON f.currency = t.currency WHERE amount <> 0),
 conv AS (SELECT *, CAST(CASE WHEN was_converted THEN floor(CAST(amount AS DOUBLE) / fr * CAST(tr AS DOUBLE) * 100 + 0.5) / 100 ELSE CAST(amount AS DOUBLE) END AS DECIMAL(18,2)) AS converted_amount,
  CASE WHEN was_converted THEN CAST(tr AS DOUBLE) / fr ELSE 1 END AS rate, CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS type FROM cv)"""


@report(
    "dj_currency_convert",
    f"WITH {CONV} SELECT tenant, txn_id, currency, CAST(amount AS DOUBLE) AS amount, CAST(converted_amount AS DOUBLE) AS converted_amount, rate, was_converted, type FROM conv",
)
def dj_currency_convert(spark, d):
    return currency.convert(txn(spark, d).drop("date"), rates(spark), "USD")


@report(
    "ag_currency_dist",
    f"""WITH {CONV} SELECT tenant, currency, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total_original, CAST(sum(converted_amount) AS DOUBLE) AS total_converted,
      count(*) FILTER (was_converted) AS conversions FROM conv GROUP BY ALL""",
)
def ag_currency_dist(spark, d):
    return currency.distribution(currency.convert(txn(spark, d).drop("txn_id", "date"), rates(spark), "USD"))


@report(
    "jn_fx_rate",
    f"""WITH {TXN}, {SQL_RATES} SELECT txn.currency, f.rate AS from_rate, CAST(0.85 AS DOUBLE) AS to_rate, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount
    FROM txn LEFT JOIN rates f ON f.currency = txn.currency GROUP BY ALL""",
)
def jn_fx_rate(spark, d):
    joined = currency.with_rates(transactions(spark, d, "amount", "currency"), rates(spark), "GBP")
    # a currency without a rate has no row on the rate side, hence no target rate either
    return joined.groupBy("currency", "from_rate").agg(
        F.lit(0.85).alias("to_rate"), F.count("*").alias("n"), F.sum("amount").alias("amount")
    )


@report(
    "jn_fx_asof",
    f"""WITH {TXN}, {BASED}, {SQL_DATED}, x AS (SELECT t.tenant, t.txn_id, t.date, t.currency, t.amount,
       (SELECT arg_max(rate, valid_from) FROM dated r WHERE r.currency = t.currency AND r.valid_from <= t.date) AS fr,
       (SELECT arg_max(rate, valid_from) FROM dated r WHERE r.currency = 'USD' AND r.valid_from <= t.date) AS tr FROM based t WHERE amount <> 0),
     y AS (SELECT *, currency <> 'USD' AND fr IS NOT NULL AND tr IS NOT NULL AS ok FROM x)
    SELECT tenant, txn_id, CAST(date AS VARCHAR) AS date, currency, CAST(amount AS DOUBLE) AS amount,
      CAST(CASE WHEN ok THEN floor(CAST(amount AS DOUBLE) / fr * tr * 100 + 0.5) / 100 ELSE CAST(amount AS DOUBLE) END AS DOUBLE) AS converted_amount,
      CASE WHEN ok THEN tr / fr ELSE 1 END AS rate, ok AS was_converted, CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS type FROM y""",
)
def jn_fx_asof(spark, d):
    return currency.convert_as_of(txn(spark, d), dated_rates(spark), "USD")


EXPO = f"""{TXN}, e AS (SELECT tenant, currency, sum(abs(amount)) AS ta, count(*) AS n FROM txn GROUP BY ALL),
 ex AS (SELECT tenant, currency, ta, n, CASE WHEN sum(ta) OVER w > 0 THEN round(CAST(ta AS DOUBLE) / CAST(sum(ta) OVER w AS DOUBLE) * 100, 6) ELSE 0 END AS share_pct,
   round(CAST(ta AS DOUBLE) / n, 4) AS average FROM e WINDOW w AS (PARTITION BY tenant)),
 con AS (SELECT tenant, count(*) AS currencies, CAST(sum(CAST(share_pct / 100 * (share_pct / 100) AS DECIMAL(20,12))) AS DOUBLE) AS h,
   arg_max(currency, (ta, currency)) AS top, arg_max(share_pct, (ta, currency)) AS top_share FROM ex GROUP BY tenant)"""


def multi(spark, d):
    """Transactions keyed by market: the tenant is the vendor's nation group of five,
    so one tenant holds several currencies."""
    t = transactions(spark, d, "tenant", "amount", "currency")
    return t.withColumn("tenant", F.concat(F.lit("G"), (F.col("tenant").cast("int") / 7).cast("int").cast("string")))


EXPO_G = EXPO.replace("FROM txn GROUP BY ALL),\n ex", "FROM grouped GROUP BY ALL),\n ex").replace(
    ", e AS (", ", grouped AS (SELECT 'G' || CAST(CAST(tenant AS INTEGER) // 7 AS VARCHAR) AS tenant, amount, currency FROM txn), e AS ("
)


@report(
    "ag_currency_exposure",
    f"WITH {EXPO_G} SELECT tenant, currency, CAST(ta AS DOUBLE) AS total_amount, n, share_pct, average FROM ex",
)
def ag_currency_exposure(spark, d):
    return currency.exposure(multi(spark, d)).orderBy("tenant", F.desc("total_amount"))


@report(
    "ag_hhi",
    f"""WITH {EXPO_G} SELECT tenant, currencies, round(h, 6) AS hhi, round(1 - h, 6) AS diversification,
      CASE WHEN currencies = 1 THEN 'high' WHEN currencies >= 3 THEN 'low' ELSE 'medium' END AS volatility,
      CASE WHEN top_share > 80 THEN top END AS dominant_currency FROM con""",
)
def ag_hhi(spark, d):
    return currency.concentration(currency.exposure(multi(spark, d)))


@report(
    "so_fx_upsert",
    f"""WITH {TXN}, {SQL_DATED}, obs AS (SELECT currency, count(*) AS n, max(date) AS d FROM txn GROUP BY currency)
    SELECT currency, CASE WHEN currency = 'CHF' THEN CAST(n AS DOUBLE) / 1000 ELSE r.rate END AS rate
    FROM obs JOIN (SELECT currency, arg_max(rate, valid_from) AS rate FROM dated GROUP BY currency) r USING (currency) WHERE currency <> 'JPY'""",
)
def so_fx_upsert(spark, d):
    """Old rates: the latest dated rate of each traded currency. Changes: CHF gets a
    rate from its traffic, JPY is removed."""
    traded = transactions(spark, d, "currency").groupBy("currency").agg(F.count("*").alias("n"))
    latest = dated_rates(spark).groupBy("currency").agg(F.max_by("rate", "valid_from").alias("rate"))
    old = traded.join(latest, "currency").select("currency", "rate")
    changes = traded.where("currency in ('CHF', 'JPY')").select(
        "currency", F.when(F.col("currency") == "CHF", F.col("n").cast("double") / 1000).alias("rate")
    )
    return currency.upsert_rates(old, changes)


@report(
    "fn_rate_stale",
    """SELECT user_id, max(ts) < TIMESTAMP '2024-01-30 00:00:00' AS stale, count(*) AS n FROM events GROUP BY user_id""",
)
def fn_rate_stale(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"), F.count("*").alias("n"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return last.select("user_id", currency.rates_stale(F.col("last"), now).alias("stale"), "n")


@report("so_category_set", f"""WITH {TXN} SELECT 'category' AS kind, category AS value FROM txn GROUP BY ALL
    UNION ALL SELECT 'currency', currency FROM txn GROUP BY ALL""")
def so_category_set(spark, d):
    t = transactions(spark, d, "category", "currency")
    pairs = t.select("category", "currency").distinct()
    long = pairs.select(F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("currency").alias("kind"), F.col("currency").alias("value")),
    )).alias("x"))
    return long.select("x.*").distinct()


@report(
    "so_concat",
    f"""WITH {TXN} SELECT tenant, txn_id, CAST(abs(amount) AS DOUBLE) AS amount FROM txn""",
)
def so_concat(spark, d):
    """Income rows and sign-flipped expense rows as one set, bound by name although the columns stand in another order."""
    t = transactions(spark, d, "tenant", "txn_id", "amount")
    income = t.where("amount > 0")
    expenses = t.where("amount <= 0").select((-F.col("amount")).alias("amount"), "txn_id", "tenant")
    return income.unionByName(expenses)
