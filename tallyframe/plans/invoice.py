"""Invoice reports: tokens, fields, lines, rules, routing, patches and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import constants as C
from tallyframe.functions.hashing import duplicate_hash
from tallyframe.functions.money import money, rounded
from tallyframe.functions.rules import any_word
from tallyframe.functions.text import amounts_in_text
from tallyframe.operators import fields, invoice_rules, lines, tokens
from tallyframe.plans.registry import report
from tallyframe.plans.text import all_text
from tallyframe.session import fresh_dir
from tallyframe.sources import sinks
from tallyframe.sources.adapters import INVOICE, LINE, RENDERED, invoice_headers, invoice_lines, invoices, rendered_invoices, table

# --- tokens --------------------------------------------------------------------

ALLTEXT = f"{RENDERED}, alltext AS (SELECT doc_id, text FROM docs UNION ALL SELECT 'd' || doc_id, text FROM documents)"
TOK = r"""tl AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line FROM
  (SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS ls FROM {src})),
 tok0 AS (SELECT doc_id, 0 AS page, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t0 FROM tl WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 0),
 tok AS (SELECT doc_id, page, line_no, trim(regexp_replace(regexp_replace(t0, '\s+([.,:;!?])', '\1', 'g'), '([.,:;!?])\s*([.,:;!?])', '\1\2', 'g')) AS text FROM tok0)"""
RTOK = f"{RENDERED}, {TOK.format(src='docs')}"


def rendered_tokens(spark, d):
    """Tokens of the rendered invoices, an array per invoice."""
    return tokens.document_tokens(rendered_invoices(spark, d))


@report("dj_tokenise", f"WITH {ALLTEXT}, {TOK.format(src='alltext')} SELECT doc_id, page, line_no, text, CAST(line_no * 20 AS DOUBLE) AS top FROM tok")
def dj_tokenise(spark, d):
    t = tokens.tokenise(all_text(spark, d))
    return t.select("doc_id", "page", "line_no", "text", F.col("bbox")[1].alias("top"))


@report(
    "fn_layout_hash",
    f"""WITH {RTOK}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS rn FROM tok)
    SELECT doc_id, md5(string_agg(text, '|' ORDER BY rn)) AS layout_hash FROM r WHERE rn <= 15 GROUP BY doc_id""",
)
def fn_layout_hash(spark, d):
    return tokens.layout_hash(rendered_tokens(spark, d))


CTX_SQL = """SELECT doc_id, page, line_no, md5(string_agg(t2, ' ' ORDER BY gap, l2)) AS context FROM (
      SELECT a.doc_id, a.page, a.line_no, b.text AS t2, b.line_no AS l2, abs(a.line_no - b.line_no) AS gap,
        row_number() OVER (PARTITION BY a.doc_id, a.page, a.line_no ORDER BY abs(a.line_no - b.line_no), b.line_no) AS rn
      FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(a.line_no - b.line_no) < 2) WHERE rn <= 5 GROUP BY ALL"""


@report("jn_token_context", f"WITH {RTOK} {CTX_SQL}")
def jn_token_context(spark, d):
    return tokens.context(rendered_tokens(spark, d)).select("doc_id", "page", "line_no", F.md5("context").alias("context"))


def _label(field):
    return f"regexp_matches(lower(text), '{any_word([w.lower() for w in C.FIELD_LABELS[field]])}')"


VALUE = {
    **{f: "regexp_matches(text, '[0-9.,]') AND length(text) < 50" for f in ("total", "tax", "discount", "shipping")},
    "invoice_number": "regexp_matches(text, '[A-Za-z0-9]') AND length(text) < 30",
    "date": r"regexp_matches(text, '\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}')",
    "vendor": "length(text) > 2 AND length(text) < 100 AND NOT regexp_matches(text, '[0-9.,]')",
}
NEAR = f"""lab AS ({' UNION ALL '.join(f"SELECT *, '{f}' AS field FROM tok WHERE {_label(f)}" for f in C.FIELD_LABELS)}),
 val AS ({' UNION ALL '.join(f"SELECT *, '{f}' AS field FROM tok WHERE {VALUE[f]}" for f in C.FIELD_LABELS)}),
 near AS (SELECT * FROM (SELECT l.doc_id, l.page, l.field, l.line_no, v.line_no AS value_line, v.text AS value_text, CAST(abs(l.line_no - v.line_no) * 20 AS DOUBLE) AS distance,
   row_number() OVER (PARTITION BY l.doc_id, l.page, l.field, l.line_no ORDER BY abs(l.line_no - v.line_no), v.line_no) AS rn
   FROM lab l JOIN val v ON l.doc_id = v.doc_id AND l.page = v.page AND l.field = v.field AND abs(l.line_no - v.line_no) * 20 < 200) WHERE rn = 1)"""


@report("jn_near_token", f"WITH {RTOK}, {NEAR} SELECT doc_id, page, field, line_no, value_line, value_text, distance FROM near")
def jn_near_token(spark, d):
    return fields.labelled_pairs(rendered_tokens(spark, d)).select(
        "doc_id", "page", "field", "line_no", "value_line", "value_text", "distance"
    )


BARE = r"regexp_replace({t}, '[^0-9.,\-]', '', 'g')"


def amount_sql(t):
    b = BARE.format(t=t)
    num = (
        f"CASE WHEN contains({b}, ',') AND NOT contains({b}, '.') AND length({b}) - length(replace({b}, ',', '')) = 1 AND length(split_part({b}, ',', 2)) <= 2 "
        f"THEN replace({b}, ',', '.') ELSE replace({b}, ',', '') END"
    )
    return rf"(CASE WHEN regexp_full_match({num}, '-?(\d+\.?\d*|\.\d+)') THEN TRY_CAST({num} AS DECIMAL(20,4)) END)"


DATED = "coalesce(" + ", ".join(
    f"CAST(try_strptime(nullif(regexp_extract(value_text, '{p}'), ''), '{f}') AS DATE)"
    for p, f in ((r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"), (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"), (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"))
) + ")"
# Some invoices write their date another way, some have no label for it.
OWN_DATE = "replace(text, 'Date: ', 'Day ')", "regexp_replace(text, 'Date: (\\d{4})-(\\d{2})-(\\d{2})', 'Issue date \\3/\\2/\\1')"
OWN_DATES = f"vdocs AS (SELECT doc_id, CASE CAST(doc_id AS BIGINT) % 3 WHEN 0 THEN {OWN_DATE[0]} WHEN 1 THEN {OWN_DATE[1]} ELSE text END AS text FROM docs)"


@report(
    "dj_field_extract",
    f"""WITH {RENDERED}, {OWN_DATES}, {TOK.format(src='vdocs')}, {NEAR}, sc AS (SELECT *, greatest(0.1, 1 - distance / 500.0) * 0.8 AS score FROM near),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, page, line_no) AS rn FROM (SELECT * EXCLUDE (rn) FROM sc)) WHERE rn = 1),
    req AS (SELECT doc_id, unnest([{', '.join(f"'{f}'" for f in C.REQUIRED_FIELDS)}]) AS field FROM docs)
    SELECT doc_id, field, coalesce(round(score, 6), 0.0) AS confidence, trim(value_text) AS value, CASE WHEN field IN ('total', 'tax', 'discount', 'shipping') THEN CAST({amount_sql('value_text')} AS DOUBLE) END AS amount,
      CASE WHEN field = 'date' THEN {DATED} END AS date, page, value_line AS line_no FROM best FULL JOIN req USING (doc_id, field)""",
)
def dj_field_extract(spark, d):
    docs = rendered_invoices(spark, d)
    kind = F.pmod(F.col("doc_id").cast("bigint"), F.lit(3))
    other = F.regexp_replace("text", r"Date: (\d{4})-(\d{2})-(\d{2})", "Issue date $3/$2/$1")
    docs = docs.withColumn("text", F.when(kind == 0, F.replace("text", F.lit("Date: "), F.lit("Day "))).when(kind == 1, other).otherwise(F.col("text")))
    out = fields.extract_fields(tokens.document_tokens(docs)).drop("bbox")
    return out.withColumn("confidence", rounded("confidence", 6))


# A mark per invoice and the code it must give: shared marks go to the first currency that lists them.
MARKED = [("€ 5", "EUR"), ("5 $", "USD"), ("pounds", "GBP"), ("yen", "JPY"), ("riyal", "SAR"), ("AED 1", "AED"), ("EGP", "EGP"), ("QAR", "QAR"), ("dinar", "KWD"), ("BHD", "BHD"), ("none", None), ("ريال", "SAR")]


@report(
    "fn_currency_iso",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE o_orderkey % {len(MARKED)} {' '.join(f"WHEN {i} THEN '{c or 'EUR'}'" for i, (_, c) in enumerate(MARKED))} END AS currency,
      CAST(CASE WHEN o_orderkey % {len(MARKED)} = 10 THEN 0.1 ELSE 0.9 END AS DOUBLE) AS confidence FROM orders""",
)
def fn_currency_iso(spark, d):
    """Heads of all invoices, whose currency line carries one of twelve marks."""
    head = tokens.tokenise(rendered_invoices(spark, d)).where("line_no <= 3")
    mark = F.get(F.array(*[F.lit(m) for m, _ in MARKED]), F.pmod(F.col("doc_id").cast("bigint"), F.lit(len(MARKED))).cast("int"))
    return fields.currency_field(head.withColumn("text", F.when(F.col("text") == "Currency EUR", mark).otherwise(F.col("text"))))


GROUPS = rf"""lk AS (SELECT *, regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '\d') AND length(text) > 5 AS lk FROM tok),
 rn AS (SELECT *, sum(CASE WHEN lk THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS run FROM lk),
 am AS (SELECT *, nullif({amount_sql('text')}, 0) AS a, nullif(TRY_CAST(nullif(regexp_extract(text, '(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE), 0) AS pct FROM rn WHERE lk)"""


@report(
    "dj_line_group",
    f"""WITH {RTOK}, {GROUPS} SELECT doc_id, 0 AS page, min(line_no) AS line_no, count(*) AS tokens, arg_max(text, (length(text), -line_no)) AS description, CAST(NULL AS DOUBLE) AS quantity,
      CAST(arg_min(a, line_no) FILTER (a IS NOT NULL) AS DOUBLE) AS unit_price, CAST(arg_max(a, line_no) FILTER (a IS NOT NULL) AS DOUBLE) AS total,
      CAST(arg_min(a, line_no) FILTER (a IS NOT NULL AND regexp_matches(lower(text), 'tax|vat')) AS DOUBLE) AS tax_amount, arg_min(pct, line_no) FILTER (pct IS NOT NULL) AS tax_rate
    FROM am GROUP BY doc_id, run""",
)
def dj_line_group(spark, d):
    return fields.line_groups(rendered_tokens(spark, d))


@report(
    "dj_notes_terms_po",
    f"""WITH {ALLTEXT}, {TOK.format(src='alltext')} SELECT doc_id, md5(string_agg(text, ' ' ORDER BY page, line_no) FILTER (length(text) > 20 AND NOT (regexp_matches(text, '[0-9.,]') AND length(trim(text)) < 50))) AS notes,
      arg_min(text, line_no) FILTER (regexp_matches(lower(text), 'payment|terms|due|net|days')) AS payment_terms,
      arg_min(text, line_no) FILTER (regexp_matches(lower(text), 'po|purchase order|order no|order number')) AS po_number FROM tok GROUP BY doc_id""",
)
def dj_notes_terms_po(spark, d):
    return fields.notes_terms_po(tokens.document_tokens(all_text(spark, d))).withColumn("notes", F.md5("notes"))


@report(
    "jn_layout_cache",
    """WITH v AS (SELECT o_orderkey AS doc_id, md5(o_orderpriority || o_custkey % 50) AS layout_hash, o_orderdate AS seen_at, CASE WHEN o_orderkey % 3 = 0 THEN 'addr ' || o_orderkey END AS address,
      CASE WHEN o_orderkey % 5 = 0 THEN 'tax ' || o_orderkey END AS tax_id FROM orders),
    f AS (SELECT layout_hash, first(address ORDER BY seen_at, doc_id) AS a, first(tax_id ORDER BY seen_at, doc_id) AS t FROM v GROUP BY layout_hash)
    SELECT doc_id, layout_hash, coalesce(address, a) AS address, coalesce(tax_id, t) AS tax_id FROM v JOIN f USING (layout_hash)""",
)
def jn_layout_cache(spark, d):
    key = F.col("o_orderkey").cast("string")
    v = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.md5(F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string"))).alias("layout_hash"),
        F.col("o_orderdate").alias("seen_at"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("addr "), key)).alias("address"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("tax "), key)).alias("tax_id"),
    )
    return fields.layout_cache(v, ["address", "tax_id"]).select("doc_id", "layout_hash", "address", "tax_id")


# --- lines ---------------------------------------------------------------------

FORMS = [
    r"(\w+(?:\s+\w+)*)\s+(\d+)\s+(\d+(?:[.,]\d+)?)\s+(\d+(?:[.,]\d+)?)",
    r"(\w+(?:\s+\w+)*)\s*-\s*(\d+)\s*-\s*(\d+(?:[.,]\d+)?)\s*-\s*(\d+(?:[.,]\d+)?)",
    r"(\w+(?:\s+\w+)*):\s*(\d+)\s*x\s*(\d+(?:[.,]\d+)?)\s*=\s*(\d+(?:[.,]\d+)?)",
]
FLAT = rf"""flat AS (SELECT doc_id, trim(regexp_replace(replace(regexp_replace(translate(text, '٠١٢٣٤٥٦٧٨٩٫', '0123456789.'), '(\d+)\s*,\s*(\d+)', '\1.\2', 'g'), ',', ''), '\s+', ' ', 'g')) AS t FROM alltext),
 ms AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS form, unnest(regexp_extract_all(t, '{p}')) AS m FROM flat" for i, p in enumerate(FORMS))}),
 mg AS (SELECT doc_id, form, CASE form {' '.join(f"WHEN {i} THEN regexp_extract(m, '{p}', ['d', 'q', 'p', 't'])" for i, p in enumerate(FORMS))} END AS g FROM ms),
 mn AS (SELECT doc_id, form, trim(g.d) AS description, TRY_CAST(g.q AS DOUBLE) AS quantity, TRY_CAST(replace(g.p, ',', '.') AS DOUBLE) AS unit_price, TRY_CAST(replace(g.t, ',', '.') AS DOUBLE) AS total FROM mg),
 good AS (SELECT * FROM mn WHERE quantity BETWEEN 1 AND 10000 AND unit_price BETWEEN 0.01 AND 100000 AND total > 0 AND abs((total - quantity * unit_price) / (quantity * unit_price)) * 100 <= 5),
 bigs AS (SELECT doc_id, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(v AS DOUBLE) DESC) AS rn FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\b\d{{4,6}}\b')) AS v FROM flat WHERE doc_id NOT IN (SELECT doc_id FROM good)) WHERE CAST(v AS DOUBLE) > 0)"""


@report(
    "dj_line_extract",
    f"""WITH {ALLTEXT}, {FLAT} SELECT doc_id, form, description, quantity, unit_price, total FROM good
    UNION ALL SELECT doc_id, 9, 'Service ' || rn, 1.0, v, v FROM bigs WHERE rn <= 20 AND v BETWEEN 0.01 AND 100000""",
)
def dj_line_extract(spark, d):
    return lines.lines_in_text(all_text(spark, d))


@report(
    "dj_line_extract_fallback",
    r"""WITH src AS (SELECT 'd' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'p' || p_partkey, p_name || ' $' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) || chr(10) || '1,50 €' || p_size FROM part),
    a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d+[,.]\d+)\s*[€$£¥]\s*(\d+)')) AS m FROM src),
    b AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z\s]+)\s*[€$£¥]\s*(\d+[,.]\d+)')) AS m FROM src),
    x AS (SELECT doc_id, 'price_qty' AS form, 'Transaction' AS description, CAST(regexp_extract(m, '(\d+[,.]\d+)\s*[€$£¥]\s*(\d+)', 2) AS DOUBLE) AS quantity, CAST(replace(regexp_extract(m, '(\d+[,.]\d+)', 1), ',', '.') AS DOUBLE) AS unit_price FROM a
      UNION ALL SELECT doc_id, 'named', regexp_replace(regexp_extract(m, '([A-Za-z\s]+)', 1), '^\s+|\s+$', '', 'g'), 1.0, CAST(replace(regexp_extract(m, '[€$£¥]\s*(\d+[,.]\d+)', 1), ',', '.') AS DOUBLE) FROM b)
    SELECT doc_id, form, description, quantity, unit_price, quantity * unit_price AS total FROM x WHERE quantity > 0 AND unit_price > 0 AND (form = 'price_qty' OR length(description) > 2)""",
)
def dj_line_extract_fallback(spark, d):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    parts = table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("doc_id"),
        F.concat(F.col("p_name"), F.lit(" $"), price, F.lit("\n1,50 €"), F.col("p_size").cast("string")).alias("text"),
    )
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return lines.fallback_lines(docs.unionByName(parts))


@report(
    "tk_amounts",
    r"""WITH a AS (SELECT o_custkey AS doc_id, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
    SELECT doc_id, o_orderkey, CAST(amount AS DOUBLE) AS amount, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY amount DESC, o_orderkey) AS rank FROM a) WHERE rank <= 15""",
)
def tk_amounts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return lines.top_amounts(rows, 15)


def priced_lines(spark, d):
    """Lines with list price and gross as total; every seventh total is off, every ninth missing."""
    k = F.col("l_partkey")
    base = invoice_lines(spark, d)
    total = F.when(k % 7 == 0, money(F.col("gross") * F.lit("1.07").cast("decimal(3,2)"))).when(k % 9 == 0, F.lit(None).cast("decimal(18,2)")).otherwise(F.col("gross"))
    return base.withColumn("total", total)


PRICED = f"{LINE}, pl AS (SELECT invoice_id, line_no, quantity, unit_price, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN CAST(gross * CAST(1.07 AS DECIMAL(3,2)) AS DECIMAL(18,2)) WHEN l_partkey % 9 = 0 THEN NULL ELSE gross END AS total FROM line)"
LV = f"""{PRICED}, lv0 AS (SELECT *, coalesce(quantity = 0 OR unit_price = 0 OR total = 0, true) AS miss FROM pl),
 lv1 AS (SELECT *, CASE WHEN NOT miss THEN abs((CAST(total AS DOUBLE) - quantity * CAST(unit_price AS DOUBLE)) / (quantity * CAST(unit_price AS DOUBLE))) * 100 END AS off FROM lv0),
 lv AS (SELECT *, concat_ws(',', CASE WHEN miss THEN 'missing_fields' END, CASE WHEN off > 5 THEN 'calculation_mismatch' END, CASE WHEN unit_price < 0.01 OR unit_price > 100000 THEN 'unit_price_range' END,
   CASE WHEN quantity < 1 OR quantity > 10000 THEN 'quantity_range' END) AS reasons FROM lv1)"""


@report(
    "dj_line_validate",
    f"""WITH {LV} SELECT invoice_id, line_no, CAST(total AS DOUBLE) AS total, reasons, reasons = '' AS is_valid, round(CASE WHEN NOT miss AND off <= 5 THEN greatest(0.0, 100 - off) ELSE 0 END, 4) AS confidence FROM lv""",
)
def dj_line_validate(spark, d):
    out = lines.validate_lines(priced_lines(spark, d))
    return out.select("invoice_id", "line_no", "total", F.array_join("reasons", ",").alias("reasons"), "is_valid", rounded("confidence", 4).alias("confidence"))


@report(
    "dj_line_validate10",
    f"""WITH {LV} SELECT invoice_id, line_no, coalesce(NOT miss AND off <= 10, false) AS is_valid, round(CASE WHEN NOT miss AND off <= 10 THEN 100 - off ELSE 0 END, 4) AS confidence, coalesce(total <= 60000, true) AS reasonable FROM lv""",
)
def dj_line_validate10(spark, d):
    out = lines.validate_lines_wide(priced_lines(spark, d), ceiling=60000)
    return out.select("invoice_id", "line_no", "is_valid", rounded("confidence", 4).alias("confidence"), "reasonable")


@report(
    "ag_invoice_totals",
    f"""WITH {LV}, s AS (SELECT invoice_id, coalesce(sum(total) FILTER (reasons = ''), 0) AS net, count(*) FILTER (reasons = '') AS valid_items, count(*) AS total_items FROM lv GROUP BY invoice_id)
    SELECT invoice_id, CAST(net AS DOUBLE) AS net, valid_items, total_items, round(CAST(net AS DOUBLE) * CAST(0.19 AS DOUBLE), 4) AS vat, round(CAST(net AS DOUBLE) + CAST(net AS DOUBLE) * CAST(0.19 AS DOUBLE), 4) AS gross,
      round(valid_items / total_items * 100, 6) AS success_rate FROM s""",
)
def ag_invoice_totals(spark, d):
    return lines.invoice_totals(lines.validate_lines(priced_lines(spark, d)))


@report(
    "ag_invoice_fill",
    f"""WITH {PRICED}, s AS (SELECT invoice_id, sum(CAST(coalesce(CAST(total AS DOUBLE), CAST(unit_price AS DOUBLE) * quantity, 0) AS DECIMAL(18,4))) AS ls FROM pl GROUP BY invoice_id),
    h AS (SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS gross_total, CASE WHEN o_orderkey % 3 = 0 THEN 19.0 END AS vat_rate,
      CASE WHEN o_orderkey % 3 = 1 THEN 150.0 END AS vat_amount, CASE WHEN o_orderkey % 5 = 0 THEN 1000.0 END AS net_total FROM orders),
    j AS (SELECT h.invoice_id, gross_total, CAST(vat_rate AS DOUBLE) AS vat_rate, CAST(vat_amount AS DOUBLE) AS vat_amount, CAST(coalesce(net_total, CAST(ls AS DOUBLE), 0) AS DOUBLE) AS net FROM h LEFT JOIN s USING (invoice_id)),
    k AS (SELECT *, coalesce(vat_amount, net * vat_rate / 100) AS vat, coalesce(vat_rate, CASE WHEN vat_amount IS NOT NULL AND net > 0 THEN floor(vat_amount / net * 100 + 0.5) END) AS rate FROM j),
    e AS (SELECT *, net + coalesce(vat, 0) AS expected FROM k)
    SELECT invoice_id, round(net, 4) AS net_total, round(vat, 4) AS vat_amount, rate AS vat_rate, round(CASE WHEN abs(coalesce(gross_total, expected) - expected) > 0.01 THEN expected ELSE coalesce(gross_total, expected) END, 4) AS gross_total,
      abs(coalesce(gross_total, expected) - expected) > 0.01 AS corrected FROM e""",
)
def ag_invoice_fill(spark, d):
    k = F.col("o_orderkey")
    heads = table(spark, d, "orders").select(
        k.cast("string").alias("invoice_id"), F.when(k % 2 == 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("gross_total"),
        F.when(k % 3 == 0, F.lit(19.0)).alias("vat_rate"), F.when(k % 3 == 1, F.lit(150.0)).alias("vat_amount"),
        F.when(k % 5 == 0, F.lit(1000.0)).alias("net_total"),
    )
    return lines.fill_invoices(heads, priced_lines(spark, d))


# --- rules, routing, patches -----------------------------------------------------

def graded_lines(spark, d):
    return invoice_lines(spark, d).withColumn("category_confidence", F.when(F.col("l_partkey") % 3 == 0, 0.6).otherwise(0.9))


def fact_invoices(spark, d):
    """Headers with the facts of their lines: one aggregate of the lines serves headers, rules and routing."""
    facts = invoice_rules.line_facts(graded_lines(spark, d))
    return invoice_headers(spark, d).join(facts, "invoice_id", "left").withColumns({"subtotal": money(F.col("line_net")), "tax_amount": money(F.col("line_tax"))})


def case_invoices(spark, d):
    """Invoices with a share of each defect: dates, currency, sign, decimals, unreadable amount, hash."""
    k = F.col("invoice_id").cast("bigint")
    day = F.date_format("invoice_date", "yyyy-MM-dd")
    base = fact_invoices(spark, d)
    return base.select(
        "invoice_id", "line_total", "line_tax", "line_confidence", "grand_total", "subtotal", "tax_amount", F.when(k % 2 == 1, F.lit(4.0)).alias("tax_rate"),
        F.when(k % 13 == 0, F.lit("-1.00").cast("decimal(18,2)")).alias("discount"), F.when(k % 17 == 0, "5.125").when(k % 23 == 0, "to be agreed").alias("shipping_text"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, "soon").otherwise(day).alias("invoice_date_text"),
        F.when(k % 11 == 0, F.date_format(F.date_sub("invoice_date", 1), "yyyy-MM-dd")).when(k % 11 == 1, "later").otherwise(F.date_format("due_date", "yyyy-MM-dd")).alias("due_date_text"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "XXX").otherwise("EUR").alias("currency"),
        F.when(k % 19 != 0, F.md5("invoice_id")).alias("duplicate_hash"),
    ).withColumn("invoice_date", F.try_to_date("invoice_date_text", "yyyy-MM-dd")).withColumn(
        "due_date", F.try_to_date("due_date_text", "yyyy-MM-dd")
    ).withColumn("shipping", F.col("shipping_text").try_cast("decimal(18,3)"))


CASES = f"""{INVOICE}, ci AS (SELECT invoice_id, CAST(invoice_id AS BIGINT) AS k, grand_total, subtotal, tax_amount, CASE WHEN CAST(invoice_id AS BIGINT) % 2 = 1 THEN 4.0 END AS tax_rate,
   CASE WHEN CAST(invoice_id AS BIGINT) % 13 = 0 THEN CAST(-1 AS DECIMAL(18,2)) END AS discount, CASE WHEN CAST(invoice_id AS BIGINT) % 17 = 0 THEN CAST(5.125 AS DECIMAL(18,3)) END AS shipping,
   CASE WHEN CAST(invoice_id AS BIGINT) % 7 > 1 THEN invoice_date END AS invoice_date, CASE CAST(invoice_id AS BIGINT) % 11 WHEN 0 THEN invoice_date - 1 WHEN 1 THEN NULL ELSE due_date END AS due_date,
   CASE CAST(invoice_id AS BIGINT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'XXX' ELSE 'EUR' END AS currency FROM inv),
 ls AS (SELECT invoice_id, sum(CAST(CAST(quantity AS DECIMAL(18,2)) * unit_price AS DECIMAL(30,6))) AS line_total, sum(tax_amount) AS line_tax FROM line GROUP BY invoice_id),
 cj AS (SELECT ci.*, CAST(coalesce(line_total, 0) AS DOUBLE) AS lt, CAST(coalesce(line_tax, 0) AS DOUBLE) AS lx, CAST(coalesce(subtotal, 0) AS DOUBLE) AS st, CAST(coalesce(ci.tax_amount, 0) AS DOUBLE) AS ta, CAST(grand_total AS DOUBLE) AS gt,
   CAST(CASE WHEN coalesce(subtotal, 0) <> 0 THEN subtotal ELSE grand_total END + coalesce(ci.tax_amount, 0) + coalesce(shipping, 0) - coalesce(discount, 0) AS DOUBLE) AS ex,
   CAST(subtotal AS DOUBLE) * coalesce(tax_rate, 0) / 100 AS tx FROM ci LEFT JOIN ls USING (invoice_id)),
 fl AS (
  SELECT invoice_id, 'arithmetic_balance' AS rule, '/amounts/grand_total' AS path, ex AS expected, gt AS actual FROM cj WHERE ex <> 0 AND abs(gt - ex) / abs(ex) > 0.02
  UNION ALL SELECT invoice_id, 'line_sum_subtotal', '/amounts/subtotal', lt, st FROM cj WHERE st <> 0 AND abs(st - lt) / abs(st) > 0.02
  UNION ALL SELECT invoice_id, 'line_sum_tax', '/amounts/tax_amount', lx, ta FROM cj WHERE ta <> 0 AND abs(ta - lx) / abs(ta) > 0.02
  UNION ALL SELECT invoice_id, 'required_date', '/invoice_date', NULL, NULL FROM cj WHERE k % 7 = 0
  UNION ALL SELECT invoice_id, 'date_format', '/invoice_date', NULL, NULL FROM cj WHERE k % 7 = 1
  UNION ALL SELECT invoice_id, 'date_format', '/due_date', NULL, NULL FROM cj WHERE k % 11 = 1
  UNION ALL SELECT invoice_id, 'date_logic', '/due_date', NULL, NULL FROM cj WHERE k % 11 = 0 AND k % 7 > 1
  UNION ALL SELECT invoice_id, 'required_currency', '/amounts/currency', NULL, NULL FROM cj WHERE currency = ''
  UNION ALL SELECT invoice_id, 'currency_format', '/amounts/currency', NULL, NULL FROM cj WHERE currency = 'XXX'
  UNION ALL SELECT invoice_id, 'non_negative_amount', '/amounts/discount', NULL, NULL FROM cj WHERE discount < 0
  UNION ALL SELECT invoice_id, 'duplicate_hash', '/duplicate_hash', NULL, NULL FROM cj WHERE k % 19 = 0
  UNION ALL SELECT invoice_id, 'rounding_policy', '/amounts/shipping', NULL, NULL FROM cj WHERE shipping IS NOT NULL
  UNION ALL SELECT invoice_id, 'amount_format', '/amounts/shipping', NULL, NULL FROM cj WHERE k % 23 = 0 AND k % 17 <> 0
  UNION ALL SELECT invoice_id, 'tax_coherence', '/amounts/tax_amount', tx, ta FROM cj WHERE tax_rate <> 0 AND ta <> 0 AND tx <> 0 AND abs(ta - tx) / abs(tx) > 0.02)"""


@report("dj_invoice_rules", f"WITH {CASES} SELECT invoice_id, rule, path, round(expected, 2) AS expected, actual FROM fl")
def dj_invoice_rules(spark, d):
    rows = invoice_rules.failure_rows(invoice_rules.check_rules(case_invoices(spark, d)))
    return rows.withColumn("expected", rounded("expected", 2))


def with_confidence(df):
    k = F.col("invoice_id").cast("bigint")
    conf = F.create_map(*[x for f in invoice_rules.REQUIRED_FIELDS for x in (F.lit(f), F.when(k % 4 == 0, 0.7).otherwise(0.95))])
    return df.withColumn("field_confidence", conf)


def clean_invoices(spark, d):
    """Half of the invoices repaired so that all rules pass: grand total and subtotal from the lines."""
    k = F.col("invoice_id").cast("bigint")
    fixed = k % 2 == 0
    base = case_invoices(spark, d).withColumn("_lt", money(F.col("line_total")))
    day = F.coalesce("invoice_date", F.lit("1998-01-01").cast("date"))
    return base.withColumns({
        "subtotal": F.when(fixed, F.col("_lt")).otherwise(F.col("subtotal")),
        "grand_total": F.when(fixed, money(F.coalesce("_lt", money(10)) + F.coalesce("tax_amount", money(0)))).otherwise(F.col("grand_total")),
        "discount": F.when(~fixed, F.col("discount")), "shipping": F.when(~fixed, F.col("shipping")), "shipping_text": F.when(~fixed, F.col("shipping_text")),
        "currency": F.when(fixed, "EUR").otherwise(F.col("currency")), "duplicate_hash": F.when(fixed, F.md5("invoice_id")).otherwise(F.col("duplicate_hash")),
        "invoice_date": F.when(fixed, day).otherwise(F.col("invoice_date")), "due_date": F.when(fixed, day).otherwise(F.col("due_date")),
        "invoice_date_text": F.when(fixed, "1998-01-01").otherwise(F.col("invoice_date_text")), "due_date_text": F.when(fixed, "1998-01-01").otherwise(F.col("due_date_text")),
    }).drop("_lt")


@report(
    "dj_route_decision",
    f"""WITH {CASES}, cc AS (SELECT invoice_id, min(CASE WHEN l_partkey % 3 = 0 THEN 0.6 ELSE 0.9 END) AS c FROM line GROUP BY invoice_id),
    fr AS (SELECT invoice_id, bool_or(rule IN ({', '.join(f"'{r}'" for r in C.FIXABLE_RULES)})) AS fixable FROM fl WHERE CAST(invoice_id AS BIGINT) % 2 = 1 GROUP BY invoice_id),
    x AS (SELECT ci.invoice_id, k % 4 <> 0 AS fields_ok, fr.invoice_id IS NULL AS rules_ok, coalesce(c, 1.0) >= 0.75 AS category_ok, coalesce(fixable, false) AS fixable FROM ci LEFT JOIN cc USING (invoice_id) LEFT JOIN fr USING (invoice_id))
    SELECT invoice_id, fields_ok, rules_ok, category_ok, CASE WHEN fields_ok AND rules_ok AND category_ok THEN 'auto_post' WHEN NOT rules_ok AND fixable THEN 'patch' ELSE 'needs_review' END AS action FROM x""",
)
def dj_route_decision(spark, d):
    checked = invoice_rules.check_rules(with_confidence(clean_invoices(spark, d)))
    return invoice_rules.decide(checked).select("invoice_id", "fields_ok", "rules_ok", "category_ok", "action")


def patches(spark, d):
    fails = invoice_rules.failure_rows(invoice_rules.check_rules(case_invoices(spark, d)))
    return invoice_rules.propose_patches(fails, tokens.tokenise(rendered_invoices(spark, d)))


PATCHES = f"""pt AS (SELECT invoice_id, CASE WHEN rule = 'arithmetic_balance' THEN 1 ELSE 2 END AS seq, path, CASE WHEN rule = 'arithmetic_balance' THEN CAST(CAST(round(expected, 2) AS DECIMAL(18,2)) AS VARCHAR) ELSE 'EUR' END AS value
  FROM fl WHERE rule IN ('arithmetic_balance', 'currency_format'))"""


@report("dj_patch_propose", f"WITH {CASES}, {PATCHES} SELECT invoice_id, seq, 'replace' AS op, path, CASE WHEN seq = 1 THEN CAST(value AS DOUBLE) END AS amount, CASE WHEN seq = 2 THEN value END AS code, 1 AS cites FROM pt")
def dj_patch_propose(spark, d):
    p = patches(spark, d)
    return p.select(
        "invoice_id", "seq", "op", "path", F.when(F.col("seq") == 1, F.col("value").try_cast("double")).alias("amount"),
        F.when(F.col("seq") == 2, F.col("value")).alias("code"), F.size("cites").alias("cites"),
    )


@report(
    "dj_patch_validate",
    f"""WITH {CASES}, {PATCHES} SELECT seq, count(*) AS n FROM pt WHERE CAST(invoice_id AS BIGINT) % 3 <> 0 GROUP BY seq""",
)
def dj_patch_validate(spark, d):
    """A third of the patches is spoiled in turn: bad path, operation, rationale or citation."""
    k = F.col("invoice_id").cast("bigint")
    p = patches(spark, d)
    spoiled = p.withColumns({
        "path": F.when(k % 12 == 0, F.substring("path", 2, 99)).otherwise(F.col("path")), "op": F.when(k % 12 == 3, "remove").otherwise(F.col("op")),
        "rationale": F.when(k % 12 == 6, "short").otherwise(F.col("rationale")), "cites": F.when(k % 12 == 9, F.array().cast("array<string>")).otherwise(F.col("cites")),
    })
    return invoice_rules.valid_patches(spoiled).groupBy("seq").agg(F.count("*").alias("n"))


@report(
    "jn_patch_apply",
    f"""WITH {CASES}, {PATCHES} SELECT ci.invoice_id, CAST(coalesce(CAST(a.value AS DECIMAL(18,2)), grand_total) AS DOUBLE) AS grand_total, coalesce(c.value, currency) AS currency
    FROM ci LEFT JOIN pt a ON a.invoice_id = ci.invoice_id AND a.seq = 1 LEFT JOIN pt c ON c.invoice_id = ci.invoice_id AND c.seq = 2""",
)
def jn_patch_apply(spark, d):
    return invoice_rules.apply_patches(case_invoices(spark, d), patches(spark, d)).select("invoice_id", "grand_total", "currency")


@report(
    "dj_review_rerun",
    f"""WITH {CASES}, left_over AS (SELECT invoice_id, count(*) AS n FROM fl WHERE rule NOT IN ('arithmetic_balance', 'currency_format') GROUP BY invoice_id)
    SELECT invoice_id, CASE WHEN n IS NULL THEN 'auto_posted' ELSE 'needs_review' END AS status, coalesce(n, 0) AS failures FROM ci LEFT JOIN left_over USING (invoice_id)""",
)
def dj_review_rerun(spark, d):
    out = invoice_rules.rerun(case_invoices(spark, d), patches(spark, d))
    return out.select("invoice_id", "status", F.size("failures").alias("failures"))


@report(
    "wn_dup_window",
    """WITH i AS (SELECT o_orderkey AS invoice_id, CASE WHEN o_custkey % 50 <> 0 THEN md5(CAST(o_custkey AS VARCHAR)) END AS h, CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders),
    w AS (SELECT *, lag(d) OVER (PARTITION BY h ORDER BY d, invoice_id) AS p FROM i) SELECT invoice_id, h AS duplicate_hash, CAST(d AS VARCHAR) AS invoice_date, coalesce(h IS NOT NULL AND date_diff('day', p, d) <= 180, false) AS is_duplicate FROM w""",
)
def wn_dup_window(spark, d):
    """The customer stands for the hash, so hashes repeat; some invoices have no hash, some no date."""
    i = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.when(F.col("o_custkey") % 50 != 0, F.md5(F.col("o_custkey").cast("string"))).alias("duplicate_hash"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate").cast("date")).alias("invoice_date"),
    )
    return invoice_rules.duplicates(i).select("invoice_id", "duplicate_hash", "invoice_date", "is_duplicate")


@report(
    "jn_source_merge",
    f"""WITH {INVOICE}, a AS (SELECT invoice_id, CASE WHEN CAST(invoice_id AS BIGINT) % 4 = 0 THEN NULL ELSE number END AS number, CAST(grand_total AS VARCHAR) AS gt, CASE WHEN CAST(invoice_id AS BIGINT) % 6 = 0 THEN 0 ELSE coalesce(n_lines, 0) END AS n, subtotal AS s FROM inv WHERE CAST(invoice_id AS BIGINT) % 9 <> 0),
    b AS (SELECT invoice_id, 'B' || number AS number, '1.00' AS gt, coalesce(n_lines, 0) + CASE WHEN CAST(invoice_id AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS n, subtotal + CASE WHEN CAST(invoice_id AS BIGINT) % 5 = 0 THEN 11 ELSE 9 END AS s FROM inv WHERE CAST(invoice_id AS BIGINT) % 8 <> 0),
    j AS (SELECT coalesce(a.invoice_id, b.invoice_id) AS invoice_id, a.number AS an, b.number AS bn, a.gt AS ag, b.gt AS bg, b.n IS NOT NULL AND (coalesce(a.n, 0) = 0 OR coalesce(b.n > a.n, false) OR abs(coalesce(CAST(a.s AS DOUBLE), 0) - coalesce(CAST(b.s AS DOUBLE), 0)) > 10) AS ub FROM a FULL JOIN b ON a.invoice_id = b.invoice_id)
    SELECT invoice_id, CASE WHEN ub THEN 'secondary' ELSE 'primary' END AS source, CASE WHEN ub THEN bn ELSE coalesce(an, bn) END AS number, CASE WHEN ub THEN bg ELSE coalesce(ag, bg) END AS grand_total FROM j""",
)
def jn_source_merge(spark, d):
    k = F.col("invoice_id").cast("bigint")
    inv = invoices(spark, d)
    n = F.coalesce("n_lines", F.lit(0))
    a = inv.where(k % 9 != 0).select("invoice_id", F.when(k % 4 != 0, F.col("number")).alias("number"), F.col("grand_total").cast("string").alias("grand_total"), F.when(k % 6 == 0, 0).otherwise(n).alias("n_lines"), F.col("subtotal").alias("line_total"))
    b = inv.where(k % 8 != 0).select("invoice_id", F.concat(F.lit("B"), "number").alias("number"), F.lit("1.00").alias("grand_total"), (n + F.when(k % 7 == 0, 1).otherwise(0)).alias("n_lines"), (F.col("subtotal") + F.when(k % 5 == 0, 11).otherwise(9)).alias("line_total"))
    return invoice_rules.merge_sources(a, b, ["number", "grand_total"])


# --- export -----------------------------------------------------------------------

HEAD_BOXES = ("invoice_number", "invoice_date", "vendor_name", "vendor_tax_id", "grand_total", "currency")
LINE_BOXES = ("quantity", "unit_price", "total")


def seen_at(page, x, y):
    return F.struct(page.cast("int").alias("page"), F.array(*[v.cast("int") for v in (x, y, x + 90, y + 12)]).alias("bbox"))


def export_invoices(spark, d):
    """Headers of the export with evidence for six fields; every tenth invoice has a patched total, cited from page 2."""
    k = F.col("invoice_id").cast("bigint")
    c = F.col("c_custkey")
    vendor = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("vendor_name"), F.concat(F.lit("Box "), c.cast("string"), F.lit(", "), "c_mktsegment").alias("vendor_address"),
        F.when(c % 3 == 0, F.concat(F.lit("DE"), c.cast("string"))).alias("vendor_tax_id"), F.when(c % 4 == 0, F.concat(F.lit("+49 30 "), c.cast("string"))).alias("vendor_phone"),
        F.when(c % 5 == 0, F.concat(F.lit("v"), c.cast("string"), F.lit("@example.org"))).alias("vendor_email"),
    )
    boxes = F.create_map(*[x for i, f in enumerate(HEAD_BOXES) for x in (F.lit(f), seen_at(k % 2, F.lit(40 + 100 * i), k % 700))])
    base = invoices(spark, d).join(vendor, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("evidence", boxes)
    patch = invoice_headers(spark, d).where(k % 10 == 3).select(
        "invoice_id", F.lit(1).alias("seq"), F.lit("replace").alias("op"), F.lit("/amounts/grand_total").alias("path"), (F.col("grand_total") + 1).cast("string").alias("value"),
        F.lit("Total read again on its page").alias("rationale"), F.array(F.lit("p2#l4")).alias("cites"),
    )
    patched = invoice_rules.apply_patches(base, invoice_rules.valid_patches(patch))
    return with_confidence(patched).select(
        "invoice_id", F.lit("deterministic").alias("method"), (F.col("order_status") == "F").alias("reviewed"), "field_confidence", "evidence", F.col("number").alias("invoice_number"),
        "invoice_date", "vendor_name", "vendor_address", "vendor_tax_id", "vendor_phone", "vendor_email", "grand_total", F.lit("EUR").alias("currency"), "due_date", "subtotal", "tax_amount",
    )


def export_lines(spark, d):
    boxes = F.create_map(*[x for i, f in enumerate(LINE_BOXES) for x in (F.lit(f), seen_at(F.lit(0), F.lit(40 + 100 * i), F.col("line_no") * 20))])
    return invoice_lines(spark, d).select(
        "invoice_id", "line_no", F.lit(None).cast("string").alias("description"), F.col("quantity").cast("int").alias("quantity"), "unit_price", "total", "tax_amount",
        F.col("l_returnflag").alias("category"), F.lit(0.9).alias("category_confidence"), boxes.alias("evidence"),
    )


def _head_arm(field, value, sure, need=None):
    """One arm of the export's SQL: a header field with its evidence; a patched total has a page and no box."""
    page, box = "NULL", "NULL"
    if field in HEAD_BOXES:
        x = 40 + 100 * HEAD_BOXES.index(field)
        page, box = "k % 2", f"'[{x}, ' || k % 700 || ', {x + 90}, ' || (k % 700 + 12) || ']'"
    if field == "grand_total":
        page, box = f"CASE WHEN k % 10 = 3 THEN 2 ELSE {page} END", f"CASE WHEN k % 10 <> 3 THEN {box} END"
    where = f" WHERE {need} IS NOT NULL" if need else ""
    return f"SELECT invoice_id, 'deterministic' AS method, reviewed, '{field}' AS field_name, {value} AS field_value, {sure} AS confidence, CAST({page} AS INTEGER) AS evidence_page, CAST({box} AS VARCHAR) AS evidence_bbox FROM hx{where}"


def _line_arm(field, value, method="deterministic", sure="1.0"):
    page, box = "NULL", "NULL"
    if field in LINE_BOXES:
        x = 40 + 100 * LINE_BOXES.index(field)
        page, box = "0", f"'[{x}, ' || line_no * 20 || ', {x + 90}, ' || (line_no * 20 + 12) || ']'"
    return f"SELECT line.invoice_id, '{method}', reviewed, 'line_item_' || line_no || '_{field}', {value}, {sure}, CAST({page} AS INTEGER), CAST({box} AS VARCHAR) FROM line JOIN hx ON hx.invoice_id = line.invoice_id"


EXPORT = f"""{INVOICE}, hx AS (SELECT inv.* REPLACE (CASE WHEN CAST(invoice_id AS BIGINT) % 10 = 3 THEN CAST(grand_total + 1 AS DECIMAL(18,2)) ELSE grand_total END AS grand_total), CAST(invoice_id AS BIGINT) AS k, c_name,
   'Box ' || c_custkey || ', ' || c_mktsegment AS address, CASE WHEN c_custkey % 3 = 0 THEN 'DE' || c_custkey END AS tax_id, CASE WHEN c_custkey % 4 = 0 THEN '+49 30 ' || c_custkey END AS phone,
   CASE WHEN c_custkey % 5 = 0 THEN 'v' || c_custkey || '@example.org' END AS email,
   CASE WHEN CAST(invoice_id AS BIGINT) % 4 = 0 THEN 0.7 ELSE 0.95 END AS fc, order_status = 'F' AS reviewed FROM inv LEFT JOIN customer ON o_custkey = c_custkey),
 ex AS (""" + " UNION ALL ".join([
    _head_arm("invoice_number", "number", "fc"), _head_arm("invoice_date", "CAST(invoice_date AS VARCHAR)", "fc"), _head_arm("vendor_name", "c_name", "0.0"),
    _head_arm("grand_total", "CAST(grand_total AS VARCHAR)", "fc"), _head_arm("currency", "'EUR'", "fc"), _head_arm("due_date", "CAST(due_date AS VARCHAR)", "0.0", "due_date"),
    _head_arm("vendor_address", "address", "0.0", "address"), _head_arm("vendor_tax_id", "tax_id", "0.0", "tax_id"), _head_arm("vendor_phone", "phone", "0.0", "phone"), _head_arm("vendor_email", "email", "0.0", "email"),
    _head_arm("subtotal", "CAST(subtotal AS VARCHAR)", "0.0", "subtotal"), _head_arm("tax_amount", "CAST(tax_amount AS VARCHAR)", "0.0", "tax_amount"),
    _line_arm("quantity", "CAST(CAST(quantity AS INTEGER) AS VARCHAR)"), _line_arm("unit_price", "CAST(unit_price AS VARCHAR)"), _line_arm("total", "CAST(total AS VARCHAR)"),
    _line_arm("tax_amount", "CAST(line.tax_amount AS VARCHAR)"), _line_arm("category", "l_returnflag", "ml_classification", "0.9"),
]) + ")"


@report("snk_export_long", f"WITH {EXPORT} SELECT invoice_id, method, reviewed, field_name, field_value, CAST(confidence AS DOUBLE) AS confidence, evidence_page, evidence_bbox FROM ex")
def snk_export_long(spark, d):
    return invoice_rules.export_long(export_invoices(spark, d), export_lines(spark, d))


@report(
    "snk_export_batch_csv",
    f"""WITH {EXPORT} SELECT ex.invoice_id AS job_id, hx.number AS invoice_number, c_name AS vendor_name, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(grand_total AS DOUBLE) AS grand_total, field_name, field_value,
      CAST(confidence AS DOUBLE) AS confidence, evidence_page, evidence_bbox, method, ex.reviewed FROM ex JOIN hx ON hx.invoice_id = ex.invoice_id""",
)
def snk_export_batch_csv(spark, d):
    """All invoices as CSV files, read back."""
    path = fresh_dir(spark, "export-batch")
    rows = invoice_rules.export_long(export_invoices(spark, d), export_lines(spark, d), carry=sinks.BATCH_KEYS)
    sinks.write_csv_parts(sinks.batch_rows(rows), path, "job_id")
    return spark.read.schema(sinks.BATCH_SCHEMA).option("header", True).csv(path)
