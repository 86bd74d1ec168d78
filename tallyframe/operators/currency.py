"""Currency conversion, as-of rates, exposure and concentration."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import dbl, ratio, round_floor, rounded, total


def with_rates(df: DataFrame, rates: DataFrame, target: str) -> DataFrame:
    """Add from_rate and to_rate; a missing rate stays NULL.

    ``rates`` holds one row per currency. The target rate is attached to the rate
    rows before the join, so the big side joins once.
    """
    to_side = rates.select(F.col("currency").alias("_to"), F.col("rate").alias("to_rate"))
    from_side = rates.select("currency", F.col("rate").alias("from_rate"), F.lit(target).alias("_to"))
    both = from_side.join(to_side, "_to", "left").drop("_to")
    return df.join(both, "currency", "left")


def based(df: DataFrame, base: str) -> DataFrame:
    """Rows with an amount other than 0; those without a currency are in the base currency."""
    return df.where(F.col("amount").isNotNull() & (F.col("amount") != 0)).withColumn("currency", F.coalesce("currency", F.lit(base)))


def convert(df: DataFrame, rates: DataFrame, target: str = "EUR", base: str = "EUR") -> DataFrame:
    """Converted amount (2 decimals, half up), rate and type per row; rows of amount
    0 are dropped, a missing rate keeps the original amount, a missing currency is ``base``."""
    joined = with_rates(based(df, base), rates, target)
    return _converted(joined, target)


def _converted(joined: DataFrame, target: str) -> DataFrame:
    known = F.coalesce(
        (F.col("currency") != target) & (F.col("from_rate") > 0) & (F.col("to_rate") > 0), F.lit(False)
    )
    amount = dbl(F.col("amount"))
    moved = round_floor(amount / F.col("from_rate") * F.col("to_rate"))
    return joined.select(
        *[c for c in joined.columns if c not in ("from_rate", "to_rate")],
        F.when(known, moved).otherwise(amount).cast("decimal(18,2)").alias("converted_amount"),
        F.when(known, F.col("to_rate") / F.col("from_rate")).otherwise(F.lit(1.0)).alias("rate"),
        known.alias("was_converted"),
        F.when(F.col("amount") > 0, "income").otherwise("expense").alias("type"),
    )


def distribution(converted: DataFrame) -> DataFrame:
    """Count, original and converted sums per original currency."""
    return converted.groupBy("tenant", "currency").agg(
        F.count("*").alias("n"), total(F.col("amount")).alias("total_original"),
        total(F.col("converted_amount")).alias("total_converted"), F.count(F.when(F.col("was_converted"), 1)).alias("conversions"),
    )


def rate_intervals(rates: DataFrame) -> DataFrame:
    """(currency, start, stop, rate): each dated rate holds until the currency's next one; the last has no stop."""
    daily = rates.groupBy("currency", F.col("valid_from").alias("start")).agg(F.max("rate").alias("rate"))
    return daily.withColumn("stop", F.lead("start").over(Window.partitionBy("currency").orderBy("start")))


def rate_pairs(rates: DataFrame, target: str) -> DataFrame:
    """(currency, start, stop, from_rate, to_rate): intervals in which both the currency and the target have one rate."""
    own = rate_intervals(rates).select(F.col("currency"), F.col("start").alias("_a"), F.col("stop").alias("_b"), F.col("rate").alias("from_rate"), F.lit(target).alias("_to"))
    to = rate_intervals(rates.where(F.col("currency") == target)).select(F.col("currency").alias("_to"), F.col("start").alias("_c"), F.col("stop").alias("_d"), F.col("rate").alias("to_rate"))
    both = own.join(to, "_to").where((F.col("_d").isNull() | (F.col("_a") < F.col("_d"))) & (F.col("_b").isNull() | (F.col("_c") < F.col("_b"))))
    return both.select(F.col("currency").alias("_currency"), F.greatest("_a", "_c").alias("_start"), F.least("_b", "_d").alias("_stop"), "from_rate", "to_rate")


#: Join keys per currency for what lies after the last change of any rate.
SALTS = 16


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def convert_as_of(df: DataFrame, rates: DataFrame, target: str = "EUR", base: str = "EUR") -> DataFrame:
    """Conversion with the rates of the transaction date on both sides; a missing currency is ``base``.

    Intervals are made from the rates alone and laid out by calendar month, so transactions are
    read once and meet, by (currency, month), only the intervals of their month; the exact
    dates are checked inside. After the last change of any rate each currency has one interval:
    these transactions are dealt over ``SALTS`` keys. Rows without a date keep their amount.
    """
    pairs = rate_pairs(rates, target)
    last = pairs.agg(F.max(_month(F.col("_start")))).first()[0]  # one number
    last = F.lit(last if last is not None else 0)
    until = F.coalesce(_month(F.date_sub("_stop", 1)), last)
    months = F.sequence(_month(F.col("_start")), F.least(until, last))
    later = F.when(F.col("_stop").isNull(), F.sequence(F.lit(-SALTS), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    calendar = pairs.withColumn("_bin", F.explode(F.concat(months, later)))
    dated = based(df, base).withColumn("_month", F.when(_month(F.col("date")) > last, -1 - F.pmod(F.xxhash64("date", "amount"), F.lit(SALTS)).cast("int")).otherwise(_month(F.col("date"))))
    within = (F.col("date") >= F.col("_start")) & (F.col("_stop").isNull() | (F.col("date") < F.col("_stop")))
    joined = dated.join(calendar, (F.col("currency") == F.col("_currency")) & (F.col("_month") == F.col("_bin")) & within, "left")
    return _converted(joined.drop("_currency", "_start", "_stop", "_bin", "_month"), target)


def exposure(df: DataFrame, base: str = "EUR") -> DataFrame:
    """Absolute sum, count, share in percent and mean per currency."""
    size = F.abs(F.coalesce("amount", F.lit(0).cast("decimal(18,2)")))
    sums = df.groupBy("tenant", F.coalesce("currency", F.lit(base)).alias("currency")).agg(
        total(size).alias("total_amount"), F.count("*").alias("n")
    )
    whole = F.sum("total_amount").over(Window.partitionBy("tenant"))
    return sums.select(
        "*",
        F.when(whole > 0, rounded(dbl(F.col("total_amount")) / dbl(whole) * 100, 6)).otherwise(F.lit(0.0)).alias("share_pct"),
        rounded(dbl(F.col("total_amount")) / F.col("n"), 4).alias("average"),
    )


def concentration(exposed: DataFrame) -> DataFrame:
    """Herfindahl index, diversification, volatility class and a >80 % top share."""
    share = F.col("share_pct") / 100
    out = exposed.groupBy("tenant").agg(
        F.sum((share * share).cast("decimal(20,12)")).alias("_hhi"), F.count("*").alias("currencies"),
        F.max(F.struct("total_amount", "currency", "share_pct")).alias("_top"),
    )
    hhi = dbl(F.col("_hhi"))
    return out.select(
        "tenant", "currencies", rounded(hhi, 6).alias("hhi"), rounded(1 - hhi, 6).alias("diversification"),
        F.when(F.col("currencies") == 1, "high").when(F.col("currencies") >= 3, "low").otherwise("medium").alias("volatility"),
        F.when(F.col("_top.share_pct") > 80, F.col("_top.currency")).alias("dominant_currency"),
    )


def upsert_rates(rates: DataFrame, changes: DataFrame) -> DataFrame:
    """New rates replace old ones; a NULL rate removes the currency."""
    merged = rates.select("currency", "rate", F.lit(0).alias("_v")).unionByName(
        changes.select("currency", "rate", F.lit(1).alias("_v"))
    )
    return merged.groupBy("currency").agg(F.max_by(F.struct("rate"), "_v").alias("_r")).select(
        "currency", F.col("_r.rate").alias("rate")
    ).where(F.col("rate").isNotNull())


def rates_stale(last_updated: Column, now: Column, hours: int = 24) -> Column:
    """True when rates were never loaded or are older than ``hours``."""
    age = F.unix_micros(now) - F.unix_micros(last_updated)
    return F.coalesce(age > hours * 3_600_000_000, F.lit(True))
