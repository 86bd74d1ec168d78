"""Confidence and complexity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import rounded


def complexity(lines: DataFrame) -> DataFrame:
    """Score per invoice from line count, distinct texts, spread of totals and missing fields, at most 1."""
    n = F.col("n").cast("double")
    base = lines.groupBy("invoice_id").agg(
        F.count("*").alias("n"), F.count_distinct("description").alias("k"), F.avg(F.col("total").cast("double")).alias("m"),
        F.stddev_pop(F.col("total").cast("double")).alias("s"), F.bool_or("missing").alias("miss"),
    )
    spread = F.coalesce(F.try_divide(F.col("s"), F.col("m")), F.lit(0.0)) / 2
    score = (
        F.least(n / 100, F.lit(0.3)) + F.least(F.col("k") / n, F.lit(0.2)) + F.least(spread, F.lit(0.2))
        + F.when(F.col("miss"), 0.1).otherwise(0.0)
    )
    return base.select("invoice_id", rounded(F.least(F.lit(1.0), score), 5).alias("complexity"))


def score(facts: DataFrame) -> DataFrame:
    """Base by completeness, then count, invalid rows, missing insight, errors and
    recognition quality; clamped to 0..95, with explanation and completeness class."""
    income, expenses, n = F.col("income") > 0, F.col("expenses") > 0, F.col("txn_count")
    pen = lambda col, per, cap: F.least(F.coalesce(F.col(col), F.lit(0)) * per, F.lit(cap))
    raw = (
        F.when(income & expenses, 95).when(income | expenses, 75).otherwise(50)
        + F.when(n == 0, -20).when(n < 5, -5).when(n > 50, 5).otherwise(0)
        - pen("invalid_count", 2, 15) - F.when(F.col("has_insights"), 0).otherwise(15)
        - pen("validation_errors", 3, 20) - pen("consistency_errors", 2, 15)
        - F.when(F.col("ocr_confidence") < 40, 20).when(F.col("ocr_confidence") < 60, 10).otherwise(0)
    )
    s = F.col("score")
    return facts.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(95), raw)).cast("int")).withColumn(
        "explanation",
        F.when(s >= 90, "High confidence - data is complete and consistent").when(s >= 75, "Good confidence - minor issues detected")
        .when(s >= 60, "Moderate confidence - some validation issues").when(s >= 40, "Low confidence - significant issues detected")
        .otherwise("Very low confidence - major data or processing issues"),
    ).withColumn(
        "completeness",
        F.when(income & expenses & (n > 0), "complete").when((income | expenses) & (n > 0), "partial").when(n > 0, "minimal")
        .otherwise("incomplete"),
    )


def dynamic(facts: DataFrame) -> DataFrame:
    """100 minus penalties for missing income, discarded, few and generic rows; 20..95."""
    none = F.col("income") == 0
    kept, dropped = F.col("txn_count"), F.col("discarded")
    ratio = F.try_divide(dropped.cast("double"), (kept + dropped).cast("double"))
    vague = F.coalesce(F.col("business_type").rlike("Unable to determine|not explicitly stated"), F.lit(False))
    raw = (
        F.when(none, 65).otherwise(100)
        - F.when(dropped > 0, F.least(F.lit(30), F.floor(ratio * 50 + 0.5))).otherwise(0)
        - F.when(kept < 3, 10).otherwise(0) - F.when(vague, 15).otherwise(0) + F.when(kept >= 5, 5).otherwise(0)
    )
    return facts.withColumn("confidence", F.greatest(F.lit(20), F.least(F.lit(95), raw)).cast("int"))


# Weights of the five parts.
WEIGHTS = {"completeness": 0.25, "consistency": 0.30, "pattern": 0.20, "history": 0.15, "cross": 0.10}


def file_facts(df: DataFrame, keys: list[str]) -> DataFrame:
    """What the multi-part score needs from the rows of a file, in one aggregate.

    Distinct categories are counted through an aggregate per category first.
    """
    amount = F.col("amount")
    filled = sum(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in ("date", "description", "amount", "category"))
    size = F.abs(amount)
    per = df.groupBy(*keys, "category").agg(
        F.sum(filled).alias("_f"), F.count("*").alias("_n"), F.sum(F.when(amount > 0, amount)).alias("_i"),
        F.sum(F.when(amount < 0, -amount)).alias("_e"), F.sum(size).alias("_s"),
    )
    named = F.col("category").isNotNull() & ~F.col("category").isin("", "Other")
    zero = F.lit(0).cast("decimal(28,2)")
    return per.groupBy(*keys).agg(
        F.sum("_f").alias("filled"), F.sum("_n").alias("n"), F.coalesce(F.sum("_i"), zero).alias("income"),
        F.coalesce(F.sum("_e"), zero).alias("expenses"), F.sum("_s").alias("size"), F.count(F.when(named, 1)).alias("kinds"),
    )


def multi(files: DataFrame, variant: str = "js") -> DataFrame:
    """Weighted mean of completeness, consistency, pattern, history and cross-check.

    ``files`` holds file_facts joined with reported totals, alert and highlight counts,
    and optionally insight, history_score and validation_confidence columns. The two
    variants differ in completeness fields and in how checks are counted.
    """
    d = lambda c: F.col(c).cast("double")
    yes = lambda c: F.when(c, 1).otherwise(0)
    n = F.coalesce(F.col("n"), F.lit(0))
    present = (
        yes(n > 0) + 1 + yes(F.col("n_alerts") > 0) + yes(F.col("n_highlights") > 0) + F.coalesce("filled", F.lit(0))
        + sum(yes(F.col(c).isNotNull()) for c in ("total_income", "total_expenses", "net_cashflow"))
    )
    fields = n * 4 + 7
    if variant == "ts":
        present, fields = present + yes(F.col("has_insights")), fields + 1
    net_off = F.abs(d("total_income") - d("total_expenses") - d("net_cashflow"))
    inc_off, exp_off = F.abs(d("income") - d("total_income")), F.abs(d("expenses") - d("total_expenses"))
    negative = (d("total_income") < 0) | (d("total_expenses") < 0)
    both, either = (F.col("income") > 0) & (F.col("expenses") > 0), (F.col("income") > 0) | (F.col("expenses") > 0)
    mean = F.try_divide(d("size"), n.cast("double"))
    mean_ok, kinds_ok = (mean > 0) & (mean < 100000), F.col("kinds") > 1
    serious = F.coalesce(F.col("serious_alerts") > 0, F.lit(False))
    if variant == "ts":
        consistency = (yes(net_off < 0.01) + yes((inc_off < 0.01) & (exp_off < 0.01)) + yes(~negative)) / F.lit(3.0)
        pattern = (yes(both) + yes(mean_ok) + yes(kinds_ok) + yes(serious)) / F.lit(4.0)
    else:
        high = (d("total_income") > 1e7) | (d("total_expenses") > 1e7)
        consistency = F.greatest(
            F.lit(0.0),
            1.0 - F.when(net_off > 0.01, 0.3).otherwise(0.0) - F.when(inc_off > 0.01, 0.2).otherwise(0.0)
            - F.when(exp_off > 0.01, 0.2).otherwise(0.0) - F.when(negative, 0.4).otherwise(0.0) - F.when(high, 0.1).otherwise(0.0),
        )
        pattern = F.least(
            F.lit(1.0),
            0.5 + F.when(both, 0.2).when(either, 0.1).otherwise(0.0) + F.when(mean_ok, 0.1).otherwise(0.0)
            + F.when(kinds_ok, 0.1).otherwise(0.0) + F.when(serious, 0.1).otherwise(0.0),
        )
    like = totals_similarity(
        [(d("income"), d("total_income")), (d("expenses"), d("total_expenses")), (d("income") - d("expenses"), d("net_cashflow"))]
    )
    base = F.coalesce(F.col("validation_confidence"), F.lit(0.5)) if "validation_confidence" in files.columns else F.lit(0.5)
    cross = F.least(F.lit(1.0), base + F.when(like != 0, 0.2).otherwise(0.0 if variant == "js" else -0.2))
    history = F.coalesce(F.col("history_score"), F.lit(0.5)) if "history_score" in files.columns else F.lit(0.5)
    out = files.withColumns({
        "completeness": present.cast("double") / fields, "consistency": consistency, "pattern": pattern, "history": history,
        "cross": F.greatest(F.lit(0.0), cross),
    })
    overall = sum(F.col(k) * w for k, w in WEIGHTS.items())
    o = F.col("overall")
    if variant == "ts":
        level = F.when(o >= 0.9, "very high").when(o >= 0.8, "high").when(o >= 0.6, "medium").when(o >= 0.4, "low").otherwise("very low")
        advice = F.array_compact(F.array(
            F.when(o < 0.6, "overall"), *[F.when(F.col(c) < 0.7, c) for c in ("completeness", "consistency", "pattern", "history", "cross")]
        ))
    else:
        level = F.when(o >= 0.85, "high").when(o >= 0.70, "medium").when(o >= 0.50, "low").otherwise("very_low")
        advice = F.array_compact(F.array(
            F.when(F.col("completeness") < 0.7, "completeness"), F.when(F.col("consistency") < 0.8, "consistency"),
            F.when(F.col("pattern") < 0.6, "pattern"), F.when(o < 0.5, "overall"),
        ))
    return out.withColumn("overall", rounded(rounded(overall, 9), 3)).withColumn("level", level).withColumn("advice", advice)


def totals_similarity(pairs):
    """Mean of 1 - relative difference over pairs of values."""
    part = lambda a, b: 1 - F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) / F.greatest(F.abs(F.coalesce(a, F.lit(0.0))), F.abs(F.coalesce(b, F.lit(0.0))), F.lit(1.0))
    return sum(part(a, b) for a, b in pairs) / float(len(pairs))


def jaccard(a, b):
    """Overlap of two arrays of alert types; two empty arrays are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def result_similarity(pairs: DataFrame, fixed: bool = True) -> DataFrame:
    """Weighted similarity of two results (columns a_* and b_*): count 0.3, totals 0.4, alerts 0.3.

    With ``fixed`` the sum is divided by the weights, else by the number of parts.
    """
    d = lambda c: F.col(c).cast("double")
    counts = 1 - F.abs(d("a_n") - d("b_n")) / F.greatest(d("a_n"), d("b_n"), F.lit(1.0))
    totals = totals_similarity([(d(f"a_{c}"), d(f"b_{c}")) for c in ("income", "expenses", "net")])
    alerts = jaccard(F.col("a_alerts"), F.col("b_alerts"))
    value = counts * 0.3 + totals * 0.4 + alerts * 0.3
    return pairs.withColumn("similarity", rounded(value if fixed else value / 3.0, 6))


def history_score(similar: DataFrame, keys: list[str], least: float = 0.7) -> DataFrame:
    """(0.5 + sum of 0.3 x accuracy) / matches over similar past results; 0.5 without any."""
    hit = F.col("similarity") > least
    sums = similar.groupBy(*keys).agg(
        F.count(F.when(hit, 1)).alias("matches"), F.sum(F.when(hit, (F.col("accuracy") * 0.3).cast("decimal(12,6)"))).alias("_s")
    )
    raw = (0.5 + F.coalesce(F.col("_s").cast("double"), F.lit(0.0))) / F.greatest("matches", F.lit(1))
    return sums.select(*keys, "matches", rounded(F.least(F.lit(1.0), raw), 6).alias("history_score"))


def cap_history(df: DataFrame, key: str, order: list[str], keep: int = 100) -> DataFrame:
    """The newest ``keep`` rows per user; a group limit before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def best_result(df: DataFrame, key: str) -> DataFrame:
    """Successful results first, then the highest confidence; an aggregate, not a sort."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col("success").cast("int"), F.col("confidence"), -F.col("result_id"))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def page_confidence(df: DataFrame, key: str) -> DataFrame:
    """Rounded mean of the positive page confidences, 0 if none."""
    return df.groupBy(key).agg(F.sum(F.when(F.col("confidence") > 0, F.col("confidence").cast("decimal(18,2)"))).alias("_s"), F.count(F.when(F.col("confidence") > 0, 1)).alias("_n")).select(
        key, F.coalesce(F.floor(F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double")) + 0.5), F.lit(0)).alias("confidence")
    )
