"""Tax reports.

The tables name no taxes, so part types stand in as tax words in the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.constants import TAX_RULES
from tallyframe.functions.rules import sql_first_match
from tallyframe.functions.tax import percent_in_text
from tallyframe.operators import tax
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import TXN, lookup, transactions

AS_OF = "1998-05-20"
TAGS = {
    "Office": "VAT 7.5% ", "Software": "Withholding ", "Equipment": "Corporate tax 21% ", "Utilities": "Council tax ",
    "Marketing": "National insurance 13.8% ",
}
TAG = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " ELSE '' END"
ENTRIES = f"""cls AS (SELECT *, {sql_first_match('description', TAX_RULES, None)} AS word, CAST(nullif(regexp_extract(description, '(\\d+(?:\\.\\d+)?)%', 1), '') AS DOUBLE) AS pct FROM taxed),
 kinds AS (SELECT *, coalesce(word, CASE WHEN category IN ('VAT', 'Tax') THEN category END) AS k FROM cls),
 rates AS (SELECT *, coalesce(CASE WHEN word IS NOT NULL THEN nullif(pct / 100, 0) END,
   CASE k WHEN 'VAT by text' THEN 0.19 WHEN 'Income Tax' THEN 0.20 WHEN 'Corporate Tax' THEN 0.25 WHEN 'Property Tax' THEN 0.05
          WHEN 'Social Security' THEN 0.12 WHEN 'VAT' THEN 0.19 ELSE 0.20 END) AS rate FROM kinds WHERE k IS NOT NULL),
 ent AS (SELECT tenant, txn_id, date, description, amount, CASE WHEN k IN ('VAT by text', 'VAT') THEN 'vat' ELSE 'tax' END AS type,
   CASE WHEN k = 'VAT by text' THEN 'VAT' ELSE k END AS subcategory, rate,
   CAST(round(CAST(abs(amount) AS DOUBLE) / (1 + rate), 4) AS DECIMAL(18,4)) AS net_amount,
   CAST(round(CAST(abs(amount) AS DOUBLE) - CAST(abs(amount) AS DOUBLE) / (1 + rate), 4) AS DECIMAL(18,4)) AS tax_part,
   CASE k WHEN 'VAT by text' THEN DATE '1998-05-31' WHEN 'Income Tax' THEN DATE '1999-04-05' WHEN 'Corporate Tax' THEN DATE '1999-09-30'
          WHEN 'Property Tax' THEN DATE '1998-07-01' WHEN 'Social Security' THEN DATE '1998-06-01' ELSE DATE '1998-06-19' END AS due_date FROM rates)"""
TAXED = f"""{TXN}, taxed AS (SELECT tenant, txn_id, date, amount, {TAG} || description AS description,
  CASE WHEN category = 'Travel' THEN 'Tax' ELSE category END AS category FROM txn WHERE amount <> 0),
 {ENTRIES}"""


def taxed(spark, d, **days):
    txn = transactions(spark, d, "tenant", "txn_id", "date", "description", "amount", "category", **days)
    return txn.withColumn(
        "description", F.concat(lookup(F.col("category"), TAGS, ""), F.col("description"))
    ).withColumn("category", F.when(F.col("category") == "Travel", "Tax").otherwise(F.col("category")))


def entries(spark, d, **days):
    return tax.tax_entries(taxed(spark, d, **days), AS_OF)


@report(
    "fn_tax_class",
    f"""WITH {TAXED} SELECT tenant, txn_id, CAST(amount AS DOUBLE) AS amount, type, subcategory, rate, CAST(net_amount AS DOUBLE) AS net_amount,
      CAST(tax_part AS DOUBLE) AS tax_part FROM ent""",
)
def fn_tax_class(spark, d):
    return entries(spark, d).select("tenant", "txn_id", "amount", "type", "subcategory", "rate", "net_amount", "tax_part")


@report(
    "fn_tax_due_date",
    f"WITH {TAXED} SELECT subcategory, type, CAST(due_date AS VARCHAR) AS due_date, count(*) AS n FROM ent GROUP BY ALL",
)
def fn_tax_due_date(spark, d):
    return entries(spark, d).groupBy("subcategory", "type", "due_date").agg(F.count("*").alias("n"))


@report(
    "fn_percent",
    f"""WITH {TAXED} SELECT pct AS percent, count(*) AS n FROM cls GROUP BY ALL""",
)
def fn_percent(spark, d):
    return taxed(spark, d).where("amount <> 0").groupBy(percent_in_text(F.col("description")).alias("percent")).agg(
        F.count("*").alias("n")
    )


@report(
    "ag_tax_totals",
    f"""WITH {TAXED}, t AS (SELECT tenant, sum(CASE WHEN type = 'tax' THEN tax_part ELSE 0 END) AS tx, sum(CASE WHEN type = 'vat' THEN tax_part ELSE 0 END) AS vt,
      sum(net_amount) AS nt, count(*) FILTER (type = 'vat') AS vat_count, count(*) FILTER (type = 'tax') AS tax_count FROM ent GROUP BY tenant)
    SELECT tenant, CAST(tx AS DOUBLE) AS total_taxes, CAST(vt AS DOUBLE) AS total_vat, CAST(nt AS DOUBLE) AS total_net, vat_count, tax_count,
      CASE WHEN nt > 0 THEN round(CAST(tx AS DOUBLE) / CAST(nt AS DOUBLE), 6) ELSE 0 END AS effective_tax_rate,
      CASE WHEN nt > 0 THEN round(CAST(vt AS DOUBLE) / CAST(nt AS DOUBLE), 6) ELSE 0 END AS effective_vat_rate FROM t""",
)
def ag_tax_totals(spark, d):
    return tax.tax_totals(entries(spark, d))


@report(
    "ag_tax_liability",
    f"""WITH {TAXED} SELECT tenant, type, count(*) AS n, CAST(sum(tax_part) AS DOUBLE) AS total FROM ent
    WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY ALL""",
)
def ag_tax_liability(spark, d):
    return tax.tax_liability(
        entries(spark, d, since="1997-01-01", until="1997-12-31"), "1997-01-01", "1997-12-31"
    )


REMIND = """rem AS (SELECT tenant, 'tax' AS type, 'Income Tax' AS subcategory, 'Income Tax Q' || (q + 1) || ' 1998' AS description,
   CAST(DATE '1998-01-01' + INTERVAL (q * 3 + 2) MONTH AS DATE) + 30 AS due_date FROM (SELECT DISTINCT tenant FROM ent), range(0, 4) r(q)
  UNION ALL SELECT tenant, 'vat', 'VAT', 'VAT Return ' || strftime(DATE '1998-01-01' + INTERVAL (m) MONTH, '%Y-%m'),
   last_day(CAST(DATE '1998-01-01' + INTERVAL (m) MONTH AS DATE)) FROM (SELECT DISTINCT tenant FROM ent), range(0, 12) r(m))"""


@report(
    "tk_calendar",
    f"""WITH {TAXED}, {REMIND} SELECT tenant, type, subcategory, description, CAST(due_date AS VARCHAR) AS due_date, CAST(tax_part AS DOUBLE) AS amount FROM ent
    UNION ALL SELECT tenant, type, subcategory, description, CAST(due_date AS VARCHAR), 0 FROM rem WHERE due_date > DATE '{AS_OF}'""",
)
def tk_calendar(spark, d):
    return tax.calendar(entries(spark, d), AS_OF)


@report(
    "tk_deadlines",
    f"""WITH {TAXED}, dl AS (SELECT *, CASE WHEN due_date BETWEEN DATE '1998-06-10' AND DATE '1998-07-10' THEN 'upcoming' WHEN due_date < DATE '1998-06-10' THEN 'overdue' END AS kind FROM ent)
    SELECT tenant, txn_id, type, subcategory, CAST(tax_part AS DOUBLE) AS amount, CAST(due_date AS VARCHAR) AS due_date, kind,
      CASE WHEN kind = 'overdue' THEN date_diff('day', due_date, DATE '1998-06-10') END AS days_overdue FROM dl WHERE kind IS NOT NULL""",
)
def tk_deadlines(spark, d):
    return tax.deadlines(entries(spark, d), "1998-06-10", 30).select(
        "tenant", "txn_id", "type", "subcategory", F.col("tax_part").alias("amount"), "due_date", "kind", "days_overdue"
    )


@report(
    "so_mark_paid",
    f"""WITH {TAXED}, pay AS (SELECT DISTINCT 'L' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || CAST(l_linenumber AS VARCHAR) AS id FROM lineitem WHERE l_returnflag = 'R')
    SELECT 'entry' AS kind, txn_id AS id, CASE WHEN pay.id IS NULL THEN 'pending' ELSE 'paid' END AS status, count(*) AS n FROM ent LEFT JOIN pay ON pay.id = txn_id GROUP BY ALL
    UNION ALL SELECT 'unknown', id, 'missing', 1 FROM pay WHERE id NOT IN (SELECT txn_id FROM ent)""",
)
def so_mark_paid(spark, d):
    from tallyframe.sources.adapters import table

    ent = entries(spark, d).withColumnRenamed("txn_id", "id")
    pays = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("L"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
        F.lit(AS_OF).cast("date").alias("payment_date"),
    ).distinct()
    updated, unknown = tax.mark_paid(ent, pays)
    out = updated.groupBy(F.lit("entry").alias("kind"), "id", "status").agg(F.count("*").alias("n"))
    return out.unionByName(
        unknown.select(F.lit("unknown").alias("kind"), "id", F.lit("missing").alias("status"), F.lit(1).cast("bigint").alias("n"))
    )
