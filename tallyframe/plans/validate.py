"""Validation and confidence reports.

A file is one tenant's month. Reported totals are the actual ones, spoiled in a
fixed share of files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import clean, confidence, validate
from tallyframe.functions.money import dbl, rounded
from tallyframe.functions.periods import as_date
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, table, transactions

KEYS = ["tenant", "month"]


def files(spark, d, *columns):
    t = transactions(spark, d, "tenant", "date", "amount", *columns)
    return t.withColumn("month", F.date_format("date", "yyyy-MM"))


def reported(txn):
    act = validate.actual_totals(txn, KEYS)
    k = F.substring("month", 6, 2).cast("int") % 4
    zero = F.lit(0).cast("decimal(28,2)")
    return act.select(
        *KEYS, F.when(k == 1, zero).otherwise(F.col("income")).cast("decimal(18,2)").alias("total_income"),
        F.when(k == 0, F.col("expenses") + 300).otherwise(F.col("expenses")).cast("decimal(18,2)").alias("total_expenses"),
        F.when(k == 1, -F.col("expenses")).when(k == 0, F.col("income") - F.col("expenses") - 300).otherwise(F.col("net")).cast("decimal(18,2)").alias("net_cashflow"),
    )


BASE = f"""{TXN}, f AS (SELECT *, strftime(date, '%Y-%m') AS month FROM txn),
 act AS (SELECT tenant, month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS income, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS expenses, sum(amount) AS net, count(*) AS n,
   count(*) FILTER (amount = 0 OR abs(amount) > 1000000) AS invalid FROM f GROUP BY tenant, month),
 rep AS (SELECT *, CAST(month[6:7] AS INTEGER) % 4 AS k FROM act),
 rp AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE income END AS ti, CASE WHEN k = 0 THEN expenses + 300 ELSE expenses END AS te,
   CASE WHEN k = 1 THEN -expenses WHEN k = 0 THEN income - expenses - 300 ELSE net END AS nc FROM rep)"""
TOP2 = """t2 AS (SELECT tenant, month, max(CASE WHEN rn = 1 THEN -amount END) AS largest, max(CASE WHEN rn = 2 THEN -amount END) AS second FROM
  (SELECT *, row_number() OVER (PARTITION BY tenant, month ORDER BY amount) AS rn FROM f WHERE amount < 0) WHERE rn <= 2 GROUP BY tenant, month)"""


@report(
    "dj_summary_validate",
    f"""WITH {BASE}, {TOP2} SELECT tenant, month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net,
      concat_ws(',', CASE WHEN abs(te - expenses) > 0.01 THEN 'error:totalExpenses' END, CASE WHEN abs(ti - income) > 0.01 THEN 'error:totalIncome' END, CASE WHEN abs(nc - net) > 0.01 THEN 'error:netCashflow' END,
        CASE WHEN expenses > 0 AND income = 0 THEN 'warning:sustainability' END, CASE WHEN income > 0 AND expenses = 0 THEN 'warning:data_completeness' END, CASE WHEN invalid > 0 THEN 'warning:transaction_quality' END) AS issues,
      concat_ws(',', CASE WHEN abs(nc - net) > 0.01 THEN 'net_mismatch' END, CASE WHEN income = 0 AND net <> 0 THEN 'zero_income_nonzero_net' END) AS anomalies,
      CAST(abs(te - expenses) > 0.01 AS INTEGER) + CAST(abs(ti - income) > 0.01 AS INTEGER) + CAST(abs(nc - net) > 0.01 AS INTEGER) AS errors,
      NOT (abs(te - expenses) > 0.01 OR abs(ti - income) > 0.01 OR abs(nc - net) > 0.01) AS is_valid, coalesce(largest > second * 5, false) AS suspicious, income = 0 AND expenses = 0 AS needs_review
    FROM rp LEFT JOIN t2 USING (tenant, month)""",
)
def dj_summary_validate(spark, d):
    t = files(spark, d)
    out = validate.validate_summary(reported(t), t, KEYS)
    return out.withColumns({c: F.array_join(c, ",") for c in ("issues", "anomalies")})


@report(
    "wn_second_largest",
    f"""WITH {BASE}, {TOP2} SELECT tenant, month, CAST(largest AS DOUBLE) AS largest, CAST(second AS DOUBLE) AS second, coalesce(largest > second * 5, false) AS suspicious FROM t2""",
)
def wn_second_largest(spark, d):
    return validate.top_two_expenses(files(spark, d), KEYS)


STORY = "CASE WHEN k = 2 THEN 'Weak: NO INCOME was seen' WHEN k = 3 THEN 'Strong, with an absence of expenses' ELSE 'Stable' END"


@report(
    "dj_consistency",
    f"""WITH {BASE}, r AS (SELECT *, CAST(ti AS DOUBLE) AS i, CAST(te AS DOUBLE) AS e, CAST(CASE WHEN k = 0 THEN nc + 1 ELSE nc END AS DOUBLE) AS c, {STORY} AS story, CASE WHEN k = 1 THEN 10.0 ELSE CASE WHEN ti > 0 THEN (CAST(ti AS DOUBLE) - CAST(te AS DOUBLE)) / CAST(ti AS DOUBLE) * 100 ELSE 0 END END AS pm FROM rp)
    SELECT tenant, month, concat_ws(',', CASE WHEN abs(i - e - c) > 0.01 THEN 'error:netCashflow' END, CASE WHEN abs(CASE WHEN i > 0 THEN (i - e) / i * 100 ELSE 0 END - pm) > 0.5 THEN 'warning:profitMargin' END,
      CASE WHEN i > 0 AND k = 2 THEN 'error:income_contradiction' END, CASE WHEN e > 0 AND k = 3 THEN 'error:expense_contradiction' END, CASE WHEN e > 0 AND k = 2 THEN 'error:alert_expenses' END, CASE WHEN i > 0 AND k = 0 THEN 'error:alert_income' END) AS issues FROM r""",
)
def dj_consistency(spark, d):
    k = F.substring("month", 6, 2).cast("int") % 4
    rep = reported(files(spark, d))
    i, e = dbl(F.col("total_income")), dbl(F.col("total_expenses"))
    stories = rep.withColumns({
        "net_cashflow": F.when(k == 0, F.col("net_cashflow") + 1).otherwise(F.col("net_cashflow")),
        "financial_health": F.when(k == 2, "Weak: NO INCOME was seen").when(k == 3, "Strong, with an absence of expenses").otherwise("Stable"),
        "profit_margin": F.when(k == 1, 10.0).otherwise(F.when(i > 0, (i - e) / i * 100).otherwise(F.lit(0.0))),
        "alerts": F.when(k == 2, F.array(F.lit("No expenses recorded"))).when(k == 0, F.array(F.lit("x"), F.lit("No income recorded"))),
    })
    return validate.check_consistency(stories).select("tenant", "month", F.array_join("issues", ",").alias("issues"))


def spoiled(spark, d):
    """Rows with a fixed share of missing dates, texts, amounts and categories."""
    t = transactions(spark, d, "tenant", "txn_id", "date", "amount", "description", "category")
    line, order = F.get(F.split("txn_id", "-"), 1).cast("int"), F.pmod(F.get(F.split("txn_id", "-"), 0).substr(2, 12).cast("bigint"), F.lit(7)).cast("int")
    n = F.coalesce(line, order)
    month = F.date_format("date", "yyyy-MM")
    return t.withColumn("month", month).withColumns({
        "date": F.when(n != 1, F.col("date")), "description": F.when(n == 2, "").otherwise(F.col("description")),
        "amount": F.when(n == 3, F.lit("invalid")).otherwise(F.col("amount").cast("string")), "category": F.when(n != 4, F.col("category")),
    })


SPOILED = f"""{TXN}, sp AS (SELECT tenant, txn_id, strftime(date, '%Y-%m') AS month, CASE WHEN txn_id LIKE 'L%' THEN CAST(split_part(txn_id, '-', 2) AS INTEGER) ELSE CAST(substr(txn_id, 2, 12) AS BIGINT) % 7 END AS n FROM txn),
 spr AS (SELECT *, CASE n WHEN 1 THEN 0.1 WHEN 2 THEN 0.1 WHEN 3 THEN 0.2 WHEN 4 THEN 0.05 ELSE 0 END AS pen FROM sp)"""


@report(
    "dj_row_validate",
    f"""WITH {SPOILED}, p AS (SELECT tenant, month, CAST(sum(CAST(pen AS DECIMAL(4,2))) AS DOUBLE) AS pen, count(*) FILTER (n BETWEEN 1 AND 4) AS iss, CAST(month[6:7] AS INTEGER) % 4 AS k FROM spr GROUP BY ALL)
    SELECT tenant, month, round(greatest(0.0, 1 - pen), 6) AS row_confidence, CAST(CASE WHEN k = 1 THEN 0.7 WHEN k = 2 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS totals_confidence,
      round(least(greatest(0.0, 1 - pen), CASE WHEN k = 1 THEN 0.7 WHEN k = 2 THEN 0.8 ELSE 1.0 END), 6) AS confidence, iss + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS issue_count, iss + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END = 0 AS is_valid FROM p""",
)
def dj_row_validate(spark, d):
    rows = validate.validate_rows(spoiled(spark, d))
    k = F.substring("month", 6, 2).cast("int") % 4
    m = lambda v: F.lit(v).cast("decimal(18,2)")
    rep = rows.select(*KEYS).distinct().select(
        *KEYS, m("10").alias("total_income"), F.when(k != 2, m("4")).alias("total_expenses"), F.when(k == 1, m("7")).otherwise(m("6")).alias("net_cashflow")
    )
    return validate.rows_confidence(rows, rep, KEYS)


@report(
    "dj_contract_validate",
    f"""SELECT l_linenumber AS form, concat_ws(',', CASE WHEN l_linenumber = 1 THEN 'date' END, CASE WHEN l_linenumber = 2 THEN 'description' END, CASE WHEN l_linenumber = 3 THEN 'amount' END, CASE WHEN l_linenumber = 4 THEN 'tax_amount' END,
      CASE WHEN l_linenumber = 5 THEN 'status' END) AS reject, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def dj_contract_validate(spark, d):
    n = F.col("l_linenumber")
    raw = table(spark, d, "lineitem").select(
        n.alias("form"), F.when(n == 1, "2024-13-45").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
        F.when(n != 2, F.lit("row")).alias("description"), F.when(n == 3, "invalid").otherwise(F.col("l_extendedprice").cast("string")).alias("amount"),
        F.when(n == 4, "x1").when(n == 6, F.col("l_tax").cast("string")).alias("tax_amount"), F.when(n == 5, "done").when(n == 6, "completed").alias("status"),
        F.lit(None).cast("string").alias("currency"),
    )
    return validate.validate_contract(raw).groupBy("form", F.array_join("reject", ",").alias("reject")).agg(F.count("*").alias("n"))


# --- confidence -------------------------------------------------------------------

def score_facts(spark, d):
    k = F.substring("month", 6, 2).cast("int")
    act = validate.actual_totals(files(spark, d), KEYS)
    return act.withColumns({
        "has_insights": k % 2 == 0, "validation_errors": k % 3, "consistency_errors": k % 5, "ocr_confidence": F.when(k % 4 == 0, 35).when(k % 4 == 1, 50),
        "income": F.when(k == 7, F.lit(0).cast("decimal(28,2)")).otherwise(F.col("income")),
    })


SCORE = f"""{BASE}, sf AS (SELECT *, CAST(month[6:7] AS INTEGER) AS m, CASE WHEN CAST(month[6:7] AS INTEGER) = 7 THEN 0 ELSE income END AS inc FROM act)"""


@report(
    "dj_confidence_score",
    f"""WITH {SCORE}, s AS (SELECT tenant, month, greatest(0, least(95, CASE WHEN inc > 0 AND expenses > 0 THEN 95 WHEN inc > 0 OR expenses > 0 THEN 75 ELSE 50 END
       + CASE WHEN n < 5 THEN -5 WHEN n > 50 THEN 5 ELSE 0 END - least(invalid * 2, 15) - CASE WHEN m % 2 = 0 THEN 0 ELSE 15 END - least(m % 3 * 3, 20) - least(m % 5 * 2, 15)
       - CASE m % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END)) AS score, CASE WHEN inc > 0 AND expenses > 0 THEN 'complete' WHEN inc > 0 OR expenses > 0 THEN 'partial' ELSE 'minimal' END AS completeness FROM sf)
    SELECT tenant, month, score, CASE WHEN score >= 90 THEN 'High confidence - data is complete and consistent' WHEN score >= 75 THEN 'Good confidence - minor issues detected' WHEN score >= 60 THEN 'Moderate confidence - some validation issues'
      WHEN score >= 40 THEN 'Low confidence - significant issues detected' ELSE 'Very low confidence - major data or processing issues' END AS explanation, completeness FROM s""",
)
def dj_confidence_score(spark, d):
    return confidence.score(score_facts(spark, d)).select(*KEYS, "score", "explanation", "completeness")


@report(
    "dj_confidence_dynamic",
    f"""WITH {SCORE} SELECT tenant, month, CAST(greatest(20, least(95, CASE WHEN inc = 0 THEN 65 ELSE 100 END - CASE WHEN m % 5 > 0 THEN least(30, floor(CAST(m % 5 * 20 AS DOUBLE) / (n + m % 5 * 20) * 50 + 0.5)) ELSE 0 END
      - CASE WHEN n < 3 THEN 10 ELSE 0 END - CASE WHEN m % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN n >= 5 THEN 5 ELSE 0 END)) AS INTEGER) AS confidence FROM sf""",
)
def dj_confidence_dynamic(spark, d):
    k = F.substring("month", 6, 2).cast("int")
    facts = score_facts(spark, d).withColumn("discarded", k % 5 * 20).withColumn(
        "business_type", F.when(k % 3 == 0, "Unable to determine").otherwise("General Business")
    )
    return confidence.dynamic(facts).select(*KEYS, "confidence")


def multi_files(spark, d):
    t = files(spark, d, "description", "category")
    k = F.substring("month", 6, 2).cast("int")
    return confidence.file_facts(t, KEYS).join(reported(t), KEYS).withColumns({
        "n_alerts": k % 3, "serious_alerts": k % 2, "n_highlights": k % 4, "has_insights": k % 5 > 0, "validation_confidence": F.when(k % 2 == 0, 0.9),
    })


MULTI = f"""{BASE}, kd AS (SELECT tenant, month, count(DISTINCT category) AS kinds, CAST(sum(abs(amount)) AS DOUBLE) AS size FROM f GROUP BY tenant, month),
 mf AS (SELECT *, CAST(month[6:7] AS INTEGER) AS m, CAST(income AS DOUBLE) AS i, CAST(expenses AS DOUBLE) AS e, CAST(ti AS DOUBLE) AS xi, CAST(te AS DOUBLE) AS xe, CAST(nc AS DOUBLE) AS xn FROM rp JOIN kd USING (tenant, month)),
 sim AS (SELECT *, ((1 - abs(i - xi) / greatest(abs(i), abs(xi), 1)) + (1 - abs(e - xe) / greatest(abs(e), abs(xe), 1)) + (1 - abs(i - e - xn) / greatest(abs(i - e), abs(xn), 1))) / 3.0 AS sm FROM mf)"""


def multi_sql(variant):
    ts = variant == "ts"
    comp = "(CASE WHEN n > 0 THEN 1 ELSE 0 END + 1 + CAST(m % 3 > 0 AS INTEGER) + CAST(m % 4 > 0 AS INTEGER) + n * 4 + 3" + (" + CAST(m % 5 > 0 AS INTEGER)" if ts else "") + f") / CAST(n * 4 + {8 if ts else 7} AS DOUBLE)"
    if ts:
        cons = "(CAST(abs(xi - xe - xn) < 0.01 AS INTEGER) + CAST(abs(i - xi) < 0.01 AND abs(e - xe) < 0.01 AS INTEGER) + CAST(NOT (xi < 0 OR xe < 0) AS INTEGER)) / CAST(3 AS DOUBLE)"
        patt = "(CAST(i > 0 AND e > 0 AS INTEGER) + CAST(size / n > 0 AND size / n < 100000 AS INTEGER) + CAST(kinds > 1 AS INTEGER) + CAST(m % 2 > 0 AS INTEGER)) / CAST(4 AS DOUBLE)"
        level = "CASE WHEN o >= 0.9 THEN 'very high' WHEN o >= 0.8 THEN 'high' WHEN o >= 0.6 THEN 'medium' WHEN o >= 0.4 THEN 'low' ELSE 'very low' END"
        advice = "concat_ws(',', CASE WHEN o < 0.6 THEN 'overall' END, CASE WHEN completeness < 0.7 THEN 'completeness' END, CASE WHEN consistency < 0.7 THEN 'consistency' END, CASE WHEN pattern < 0.7 THEN 'pattern' END, 'history', CASE WHEN crossed < 0.7 THEN 'cross' END)"
    else:
        cons = "greatest(0.0, 1.0 - CASE WHEN abs(xi - xe - xn) > 0.01 THEN 0.3 ELSE 0 END - CASE WHEN abs(i - xi) > 0.01 THEN 0.2 ELSE 0 END - CASE WHEN abs(e - xe) > 0.01 THEN 0.2 ELSE 0 END - CASE WHEN xi < 0 OR xe < 0 THEN 0.4 ELSE 0 END - CASE WHEN xi > 1e7 OR xe > 1e7 THEN 0.1 ELSE 0 END)"
        patt = "least(1.0, 0.5 + CASE WHEN i > 0 AND e > 0 THEN 0.2 WHEN i > 0 OR e > 0 THEN 0.1 ELSE 0 END + CASE WHEN size / n > 0 AND size / n < 100000 THEN 0.1 ELSE 0 END + CASE WHEN kinds > 1 THEN 0.1 ELSE 0 END + CASE WHEN m % 2 > 0 THEN 0.1 ELSE 0 END)"
        level = "CASE WHEN o >= 0.85 THEN 'high' WHEN o >= 0.70 THEN 'medium' WHEN o >= 0.50 THEN 'low' ELSE 'very_low' END"
        advice = "concat_ws(',', CASE WHEN completeness < 0.7 THEN 'completeness' END, CASE WHEN consistency < 0.8 THEN 'consistency' END, CASE WHEN pattern < 0.6 THEN 'pattern' END, CASE WHEN o < 0.5 THEN 'overall' END)"
    miss = "-0.2" if ts else "0.0"
    return f"""WITH {MULTI}, pr AS (SELECT tenant, month, {comp} AS completeness, CAST({cons} AS DOUBLE) AS consistency, CAST({patt} AS DOUBLE) AS pattern, greatest(0.0, least(1.0, CASE WHEN m % 2 = 0 THEN 0.9 ELSE 0.5 END + CASE WHEN sm <> 0 THEN 0.2 ELSE {miss} END)) AS crossed FROM sim),
      ov AS (SELECT *, round(round(completeness * 0.25 + consistency * 0.30 + pattern * 0.20 + 0.5 * 0.15 + crossed * 0.10, 9), 3) AS o FROM pr)
      SELECT tenant, month, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(pattern, 6) AS pattern, round(CAST(crossed AS DOUBLE), 6) AS crossed, round(CAST(o AS DOUBLE), 3) AS overall, {level} AS level, {advice} AS advice FROM ov"""


def _multi(variant):
    def plan(spark, d):
        out = confidence.multi(multi_files(spark, d), variant)
        return out.select(
            *KEYS, *[rounded(c, 6).alias(c) for c in ("completeness", "consistency", "pattern")], rounded("cross", 6).alias("crossed"),
            "overall", "level", F.array_join("advice", ",").alias("advice"),
        )

    return plan


report("dj_confidence_multi", multi_sql("js"))(_multi("js"))
report("dj_confidence_multi_ts", multi_sql("ts"))(_multi("ts"))


def results(spark, d):
    """One result per tenant and month with its alert types."""
    act = validate.actual_totals(files(spark, d), KEYS)
    alerts = F.array_compact(F.array(
        F.when(F.col("net") < 0, "negative_cashflow"), F.when(F.col("expenses") > F.col("income") * 2, "expense_high"), F.when(F.col("txn_count") < 30, "few_rows"),
    ))
    return act.withColumn("alerts", alerts).withColumn("accuracy", (F.substring("month", 6, 2).cast("int") % 10) / F.lit(10.0))


RES = f"""{BASE}, rs AS (SELECT tenant, month, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses, CAST(net AS DOUBLE) AS net, CAST(n AS DOUBLE) AS n, (CAST(month[6:7] AS INTEGER) % 10) / 10.0 AS accuracy,
   list_filter([CASE WHEN net < 0 THEN 'negative_cashflow' END, CASE WHEN expenses > income * 2 THEN 'expense_high' END, CASE WHEN n < 30 THEN 'few_rows' END], lambda x: x IS NOT NULL) AS alerts FROM act),
 cur AS (SELECT tenant, max(month) AS month FROM rs GROUP BY tenant),
 pa AS (SELECT a.tenant, b.month AS past_month, b.accuracy, (1 - abs(a.n - b.n) / greatest(a.n, b.n, 1)) AS c, ((1 - abs(a.income - b.income) / greatest(abs(a.income), abs(b.income), 1)) + (1 - abs(a.expenses - b.expenses) / greatest(abs(a.expenses), abs(b.expenses), 1))
   + (1 - abs(a.net - b.net) / greatest(abs(a.net), abs(b.net), 1))) / 3.0 AS t, CASE WHEN len(list_distinct(list_concat(a.alerts, b.alerts))) = 0 THEN 1.0 ELSE len(list_intersect(a.alerts, b.alerts)) / CAST(len(list_distinct(list_concat(a.alerts, b.alerts))) AS DOUBLE) END AS j
   FROM rs a JOIN cur USING (tenant, month) JOIN (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY month DESC) AS rn FROM rs) b ON b.tenant = a.tenant AND b.month < a.month AND b.rn <= 101),
 sm AS (SELECT *, round(c * 0.3 + t * 0.4 + j * 0.3, 6) AS similarity FROM pa)"""


def history_pairs(spark, d):
    """The latest result of each tenant beside its newest earlier results, at most 100."""
    res = results(spark, d)
    latest = res.groupBy("tenant").agg(F.max_by(F.struct("income", "expenses", "net", F.col("txn_count").alias("n"), "alerts", "month"), "month").alias("a")).select("tenant", *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("income", "expenses", "net", "n", "alerts", "month")])
    past = confidence.cap_history(res, "tenant", ["month"], 101).select(
        "tenant", F.col("month").alias("past_month"), "accuracy", F.col("txn_count").alias("b_n"), *[F.col(c).alias(f"b_{c}") for c in ("income", "expenses", "net", "alerts")]
    )
    return latest.join(past, "tenant").where(F.col("past_month") < F.col("a_month"))


@report("dj_history_similarity", f"WITH {RES} SELECT tenant, past_month, similarity FROM sm")
def dj_history_similarity(spark, d):
    return confidence.result_similarity(history_pairs(spark, d)).select("tenant", "past_month", "similarity")


@report("so_jaccard", f"WITH {RES} SELECT tenant, past_month, round(j, 6) AS overlap FROM pa")
def so_jaccard(spark, d):
    return history_pairs(spark, d).select("tenant", "past_month", rounded(confidence.jaccard(F.col("a_alerts"), F.col("b_alerts")), 6).alias("overlap"))


@report(
    "wn_history_cap",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20""",
)
def wn_history_cap(spark, d):
    return confidence.cap_history(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id")


@report(
    "wn_best_result",
    """SELECT user_id, success, confidence, result_id FROM (SELECT user_id, event_type <> 'error' AS success, value AS confidence, event_id AS result_id,
      row_number() OVER (PARTITION BY user_id ORDER BY CAST(event_type <> 'error' AS INTEGER) DESC, value DESC, event_id) AS rn FROM events) WHERE rn = 1""",
)
def wn_best_result(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("success"), F.col("value").alias("confidence"), F.col("event_id").alias("result_id"))
    return confidence.best_result(e, "user_id")


@report(
    "ag_ocr_confidence",
    """SELECT user_id, CAST(coalesce(floor(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type <> 'error' AND value > 0) AS DOUBLE) / nullif(count(*) FILTER (event_type <> 'error' AND value > 0), 0) + 0.5), 0) AS BIGINT) AS confidence FROM events GROUP BY user_id""",
)
def ag_ocr_confidence(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("confidence"))
    return confidence.page_confidence(e, "user_id")


@report(
    "ag_median_outlier",
    f"""WITH {TXN}, z AS (SELECT tenant, txn_id, CASE WHEN txn_id LIKE '%-7' THEN CAST(amount * 20 AS DECIMAL(18,2)) WHEN txn_id LIKE '%-6' THEN NULL ELSE amount END AS amount FROM txn),
    m AS (SELECT tenant, quantile_cont(CAST(abs(amount) AS DOUBLE), 0.5) AS med FROM z GROUP BY tenant)
    SELECT tenant, txn_id, CAST(amount AS DOUBLE) AS amount, CASE WHEN med > 0 AND CAST(abs(amount) AS DOUBLE) > med * 10 THEN 'unrealistic_amount' END AS flag_reason FROM z LEFT JOIN m USING (tenant)""",
)
def ag_median_outlier(spark, d):
    t = transactions(spark, d, "tenant", "txn_id", "amount")
    odd = F.when(F.col("txn_id").endswith("-7"), (F.col("amount") * 20).cast("decimal(18,2)")).when(~F.col("txn_id").endswith("-6"), F.col("amount"))
    return clean.flag_outliers(t.withColumn("amount", odd))


@report(
    "wn_progressive_date",
    f"""WITH {TXN}, z AS (SELECT tenant, txn_id, amount, CASE WHEN category = 'Travel' THEN NULL ELSE date END AS date, row_number() OVER (PARTITION BY tenant ORDER BY txn_id, amount) AS rn FROM txn)
    SELECT tenant, txn_id, CAST(amount AS DOUBLE) AS amount, CAST(coalesce(date, DATE '1998-01-01' + CAST(rn - 1 AS INTEGER)) AS VARCHAR) AS date FROM z""",
)
def wn_progressive_date(spark, d):
    t = transactions(spark, d, "tenant", "txn_id", "date", "amount", "category")
    gaps = t.withColumn("date", F.when(F.col("category") != "Travel", F.col("date")))
    return clean.progressive_dates(gaps, ["tenant"], ["txn_id", "amount"], as_date("1998-01-01")).select("tenant", "txn_id", "amount", "date")
