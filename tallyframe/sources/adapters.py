"""Canonical views over the star-schema tables.

Each view joins only what the requested columns need, so a query that reads
``amount`` alone never touches ``part`` or ``region``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.money import MONEY, money, rounded

TRANSACTION_COLUMNS = (
    "txn_id", "tenant", "date", "description", "vendor", "amount", "currency", "category", "tax_amount",
)

# Expense category by part type, currency by region.
TYPE_CATEGORY = {
    "STANDARD": "Office", "SMALL": "Software", "LARGE": "Equipment", "ECONOMY": "Utilities",
    "MEDIUM": "Marketing", "PROMO": "Travel",
}
REGION_CURRENCY = {"EUROPE": "EUR", "AMERICA": "USD", "ASIA": "JPY", "AFRICA": "GBP", "MIDDLE EAST": "CHF"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(col, mapping: dict[str, str], default: str):
    """Literal map lookup; one hash probe instead of a chain of comparisons."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(default))


def net_price() -> "F.Column":
    return money(F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast(MONEY)))


def unit_price() -> "F.Column":
    return money(rounded(F.col("l_extendedprice") / F.col("l_quantity"), 2))


def line_tax() -> "F.Column":
    return money(F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast(MONEY))


def _nation_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", lookup(F.col("r_name"), REGION_CURRENCY, "EUR").alias("currency")
    )


def transactions(
    spark: SparkSession, sf_dir: str, *columns: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Signed transactions: orders are income of the customer's nation, lines are
    expenses of the supplier's nation.

    ``since`` and ``until`` (inclusive days) compare the stored timestamps, so they
    reach the parquet scan; a filter on the derived ``date`` would not.
    """
    wanted = columns or TRANSACTION_COLUMNS
    need = set(wanted)
    income = income_side(spark, sf_dir, need, since, until)
    expense = expense_side(spark, sf_dir, need, since, until)
    return income.select(*wanted).unionByName(expense.select(*wanted))


def _days(df: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    if since:
        df = df.where(F.col(column) >= F.lit(f"{since} 00:00:00").cast("timestamp_ntz"))
    if until:
        last = datetime.date.fromisoformat(until) + datetime.timedelta(days=1)
        df = df.where(F.col(column) < F.lit(f"{last} 00:00:00").cast("timestamp_ntz"))
    return df


def income_side(
    spark: SparkSession, sf_dir: str, need: set[str], since: str | None = None, until: str | None = None
) -> DataFrame:
    out = _days(table(spark, sf_dir, "orders"), "o_orderdate", since, until)
    if need & {"tenant", "vendor", "description", "currency"}:
        out = out.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if "currency" in need:
        out = out.join(_nation_currency(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    made = {
        "txn_id": F.concat(F.lit("O"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")),
        "tenant": F.col("c_nationkey").cast("string") if "c_nationkey" in out.columns else None,
        "date": F.col("o_orderdate").cast("date"),
        "description": F.concat(F.lit("Client Payment - "), F.col("c_name")) if "c_name" in out.columns else None,
        "vendor": F.col("c_name") if "c_name" in out.columns else None,
        "amount": F.col("o_totalprice").cast(MONEY),
        "currency": F.col("currency") if "currency" in out.columns else None,
        "category": F.lit("Income"),
        "tax_amount": money(0),
    }
    return out.select(*[made[c].alias(c) for c in TRANSACTION_COLUMNS if c in need])


def expense_side(
    spark: SparkSession, sf_dir: str, need: set[str], since: str | None = None, until: str | None = None
) -> DataFrame:
    out = _days(table(spark, sf_dir, "lineitem"), "l_shipdate", since, until)
    if need & {"tenant", "vendor", "currency"}:
        out = out.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if need & {"description", "category"}:
        out = out.join(
            table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
            "left",
        )
    if "currency" in need:
        out = out.join(_nation_currency(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    have = set(out.columns)
    made = {
        "txn_id": F.concat(
            F.lit("L"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("-"),
            F.col("l_linenumber").cast("string"),
        ),
        "tenant": F.col("s_nationkey").cast("string") if "s_nationkey" in have else None,
        "date": F.col("l_shipdate").cast("date"),
        "description": F.concat_ws(" ", "p_name", "p_type") if "p_name" in have else None,
        "vendor": F.col("s_name") if "s_name" in have else None,
        "amount": -net_price(),
        "currency": F.col("currency") if "currency" in have else None,
        "category": lookup(F.col("p_type"), TYPE_CATEGORY, "Other") if "p_type" in have else None,
        "tax_amount": line_tax(),
    }
    return out.select(*[made[c].alias(c) for c in TRANSACTION_COLUMNS if c in need])


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines from order lines."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").cast("string").alias("invoice_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("quantity"),
        unit_price().alias("unit_price"),
        net_price().alias("total"),
        line_tax().alias("tax_amount"),
        F.col("l_tax").alias("tax_rate"),
        money(F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast(MONEY)).alias("discount"),
        F.col("l_extendedprice").cast(MONEY).alias("gross"),
        F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag"),
    )


def invoice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice headers from orders, without what their lines add up to."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("invoice_id"),
        F.col("o_custkey"),
        F.col("o_orderkey").cast("string").alias("number"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("due_date"),
        F.col("o_totalprice").cast(MONEY).alias("grand_total"),
        F.col("o_orderstatus").alias("order_status"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice headers from orders; subtotal and tax come from the lines, so an
    order without lines has none."""
    sums = (
        invoice_lines(spark, sf_dir)
        .groupBy("invoice_id")
        .agg(
            money(F.sum("total")).alias("subtotal"),
            money(F.sum("tax_amount")).alias("tax_amount"),
            F.count("*").alias("n_lines"),
        )
    )
    return invoice_headers(spark, sf_dir).join(sums, "invoice_id", "left")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries from events: job = user, stage by event type, duration = value."""
    return table(spark, sf_dir, "events").select(*audit_columns())


def audit_columns():
    stage = (
        F.when(F.col("event_type") == "view", "ocr")
        .when(F.col("event_type") == "click", "extraction")
        .when(F.col("event_type") == "signup", "validation")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("error")
    )
    return (
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("job_id"),
        stage.alias("stage"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


# --- the same views as SQL, for the checks ---------------------------------

SQL_CURRENCY = (
    "CASE r_name WHEN 'EUROPE' THEN 'EUR' WHEN 'AMERICA' THEN 'USD' WHEN 'ASIA' THEN 'JPY' "
    "WHEN 'AFRICA' THEN 'GBP' WHEN 'MIDDLE EAST' THEN 'CHF' ELSE 'EUR' END"
)
SQL_CATEGORY = (
    "CASE p_type WHEN 'STANDARD' THEN 'Office' WHEN 'SMALL' THEN 'Software' WHEN 'LARGE' THEN 'Equipment' "
    "WHEN 'ECONOMY' THEN 'Utilities' WHEN 'MEDIUM' THEN 'Marketing' WHEN 'PROMO' THEN 'Travel' ELSE 'Other' END"
)
SQL_NET = (
    "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,2))"
)
SQL_LINE_TAX = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(18,2))"

TXN = f"""txn AS (
  SELECT 'O' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS txn_id, CAST(c_nationkey AS VARCHAR) AS tenant,
         CAST(o_orderdate AS DATE) AS date, 'Client Payment - ' || c_name AS description, c_name AS vendor,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, {SQL_CURRENCY} AS currency, 'Income' AS category,
         CAST(0 AS DECIMAL(18,2)) AS tax_amount
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'L' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || CAST(l_linenumber AS VARCHAR),
         CAST(s_nationkey AS VARCHAR), CAST(l_shipdate AS DATE), concat_ws(' ', p_name, p_type), s_name,
         -{SQL_NET}, {SQL_CURRENCY}, {SQL_CATEGORY}, {SQL_LINE_TAX}
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""

LINE = f"""line AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice_id, l_linenumber AS line_no, l_quantity AS quantity,
         CAST(round(l_extendedprice / l_quantity, 2) AS DECIMAL(18,2)) AS unit_price,
         {SQL_NET} AS total, {SQL_LINE_TAX} AS tax_amount, l_tax AS tax_rate,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS discount,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS gross, l_partkey, l_suppkey, l_returnflag
  FROM lineitem
)"""

INVOICE = f"""{LINE}, inv AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, o_custkey, CAST(o_orderkey AS VARCHAR) AS number,
         CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate AS DATE) + 30 AS due_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS grand_total, o_orderstatus AS order_status,
         CAST(s.subtotal AS DECIMAL(18,2)) AS subtotal, CAST(s.tax_amount AS DECIMAL(18,2)) AS tax_amount, n_lines
  FROM orders LEFT JOIN (SELECT invoice_id, sum(total) AS subtotal, sum(tax_amount) AS tax_amount, count(*) AS n_lines
                         FROM line GROUP BY invoice_id) s ON s.invoice_id = CAST(o_orderkey AS VARCHAR)
)"""

AUDIT = """aud AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS job_id,
         CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'extraction' WHEN 'signup' THEN 'validation'
                         WHEN 'purchase' THEN 'completed' ELSE 'error' END AS stage,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS duration_ms,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""


# --- rendered invoice documents ----------------------------------------------

def rendered_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per order, so that extraction has a known answer.

    The list gathers the lines of one invoice only.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    price = F.col("l_extendedprice").cast(MONEY)
    qty = F.col("l_quantity").cast("int").cast("string")
    unit = unit_price().cast("string")
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select("l_orderkey", line_tax().alias("tax"), F.concat_ws(" ", "p_name", "p_type", qty, unit, price.cast("string")).alias("line"))
        .groupBy("l_orderkey")
        .agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("items"), money(F.sum("tax")).alias("tax"))
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("doc_id"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.concat_ws(
                "\n",
                F.concat(F.lit("Invoice No: INV-"), F.col("o_orderkey").cast("string")),
                F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")),
                F.concat(F.lit("From: "), F.lower(F.col("c_mktsegment")), F.lit(" goods")),
                F.lit("Currency EUR"),
                F.lit("Items"),
                F.col("items"),
                F.lit("Summary"),
                F.concat(F.lit("Tax: "), F.coalesce("tax", money(0)).cast("string")),
                F.concat(F.lit("Total: "), F.col("o_totalprice").cast(MONEY).cast("string")),
                F.lit("Payment terms: net 30 days"),
            ).alias("text"),
        )
    )


RENDERED = f"""rl AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY line) AS items, CAST(sum(tax) AS DECIMAL(18,2)) AS tax FROM (
   SELECT l_orderkey, {SQL_LINE_TAX} AS tax, concat_ws(' ', p_name, p_type, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),
     CAST(CAST(round(l_extendedprice / l_quantity, 2) AS DECIMAL(18,2)) AS VARCHAR),
     CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS line FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey),
 docs AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_orderdate AS DATE) AS day,
   concat_ws(chr(10), 'Invoice No: INV-' || o_orderkey, 'Date: ' || strftime(o_orderdate, '%Y-%m-%d'), 'From: ' || lower(c_mktsegment) || ' goods',
     'Currency EUR', 'Items', items, 'Summary', 'Tax: ' || CAST(coalesce(tax, 0.00) AS VARCHAR), 'Total: ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR),
     'Payment terms: net 30 days') AS text
   FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN rl ON o_orderkey = l_orderkey)"""
