"""Cleaning, classification and text-extraction reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import constants as C
from tallyframe.functions import amounts, hashing, text
from tallyframe.functions.periods import as_date, report_period
from tallyframe.functions.rules import first_match, has_word, sql_first_match, sql_has_word
from tallyframe.plans.registry import report
from tallyframe.session import fresh_dir
from tallyframe.sources import csv_txn
from tallyframe.sources.adapters import RENDERED, TXN, rendered_invoices, table, transactions

AR = f"[{C.ARABIC_BLOCKS}]"


def q(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


# --- amounts ------------------------------------------------------------------

RAW_AMOUNT = """CASE l_linenumber % 5 WHEN 0 THEN '€' || format('{:,.2f}', l_extendedprice)
  WHEN 1 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
  WHEN 2 THEN '$ -' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 3 THEN 'n/a ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END"""
RAW = f"""raw AS (SELECT l_orderkey, l_linenumber, l_extendedprice, {RAW_AMOUNT} AS raw FROM lineitem)"""


def raw_amounts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _raw_col().alias("raw"))


STRICT = """CAST(TRY_CAST(nullif(regexp_extract(CASE WHEN regexp_matches(trim(regexp_replace(raw, '[€$£¥]', '', 'g')), ',\\d{2}$')
  THEN regexp_replace(trim(regexp_replace(raw, '[€$£¥]', '', 'g')), ',(\\d{2})$', '.\\1')
  ELSE replace(trim(regexp_replace(raw, '[€$£¥]', '', 'g')), ',', '') END, '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DECIMAL(18,2)) AS DOUBLE)"""


@report("cln_amount_text", f"WITH {RAW} SELECT l_orderkey, l_linenumber, raw, {STRICT} AS amount FROM raw")
def cln_amount_text(spark, d):
    return raw_amounts(spark, d).withColumn("amount", amounts.amount_text(F.col("raw")))


@report(
    "cln_amount_mixed",
    f"""WITH {RAW}, b AS (SELECT *, regexp_replace(raw, '[^0-9.,\\-]', '', 'g') AS bare FROM raw),
    n AS (SELECT *, CASE WHEN contains(bare, ',') AND NOT contains(bare, '.') AND length(bare) - length(replace(bare, ',', '')) = 1 AND length(split_part(bare, ',', 2)) <= 2
      THEN replace(bare, ',', '.') ELSE replace(bare, ',', '') END AS num FROM b)
    SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(num, '-?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(TRY_CAST(num AS DECIMAL(20,4)) AS DOUBLE) END AS amount FROM n""",
)
def cln_amount_mixed(spark, d):
    return raw_amounts(spark, d).select("l_orderkey", "l_linenumber", amounts.amount_mixed(F.col("raw")).alias("amount"))


@report(
    "cln_discard_split",
    f"""WITH {RAW}, a AS (SELECT *, {STRICT} AS amount FROM raw) SELECT CASE WHEN amount IS NULL OR amount = 0 THEN 'Invalid amount' END AS reason,
      l_linenumber % 5 AS form, count(*) AS n FROM a GROUP BY ALL""",
)
def cln_discard_split(spark, d):
    from tallyframe.operators.clean import split_valid

    kept, dropped = split_valid(raw_amounts(spark, d).withColumn("amount", amounts.amount_text(F.col("raw"))))
    both = kept.unionByName(dropped)
    return both.groupBy("reason", (F.col("l_linenumber") % 5).alias("form")).agg(F.count("*").alias("n"))


@report(
    "cln_txn_invalid",
    f"""WITH {RAW}, a AS (SELECT *, {STRICT} AS amount FROM raw) SELECT l_orderkey, l_linenumber, amount FROM a WHERE amount IS NOT NULL AND amount <> 0""",
)
def cln_txn_invalid(spark, d):
    from tallyframe.operators.clean import valid_amounts

    return valid_amounts(
        raw_amounts(spark, d).select("l_orderkey", "l_linenumber", amounts.amount_text(F.col("raw")).alias("amount"))
    )


@report(
    "cln_coalesce_category",
    f"""WITH {TXN} SELECT coalesce(nullif(CASE WHEN category = 'Travel' THEN '' WHEN category = 'Office' THEN NULL ELSE category END, ''), 'Other') AS category, count(*) AS n FROM txn GROUP BY ALL""",
)
def cln_coalesce_category(spark, d):
    from tallyframe.operators.clean import fill_category

    t = transactions(spark, d, "category").withColumn(
        "category", F.when(F.col("category") == "Travel", "").when(F.col("category") != "Office", F.col("category"))
    )
    return fill_category(t, "Other").groupBy("category").agg(F.count("*").alias("n"))


ARDIG = "translate(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' || CAST(l_partkey AS VARCHAR), '0123456789.', '٠١٢٣٤٥٦٧٨٩٫')"


@report(
    "cln_digits",
    f"""SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' || CAST(l_partkey AS VARCHAR) AS ascii FROM lineitem""",
)
def cln_digits(spark, d):
    """Digits are written in Arabic first and must come back."""
    plain = F.concat_ws("  ", F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.col("l_partkey").cast("string"))
    arabic = F.translate(plain, "0123456789.", C.ARABIC_DIGITS + "٫")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.normalize_digits(arabic).alias("ascii"))


@report(
    "cln_spacing",
    r"""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations),
    b AS (SELECT *, regexp_replace(t, '\s+([.,:;!?])', '\1', 'g') AS u FROM a)
    SELECT conv_id, turn, md5(trim(regexp_replace(u, '([.,:;!?])\s*([.,:;!?])', '\1\2', 'g'))) AS h FROM b""",
)
def cln_spacing(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.normalize_spacing(F.col("text"))).alias("h"))


@report(
    "cln_number_context",
    r"""WITH a AS (SELECT doc_id, trim(regexp_replace(translate(text, '٬،٫', ',,.'), '\s+', ' ', 'g')) AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\d),(\d{3})\b', '\1\2', 'g'), '(\d),(\d{3})\b', '\1\2', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(t, '(\d+)\s*,\s*(\d+)', '\1.\2', 'g') AS t FROM b)
    SELECT doc_id, md5(trim(regexp_replace(t, '(\d+)\s*\.\s*(\d+)\s*\.\s*(\d+)', '\1,\2.\3', 'g'))) AS h FROM c""",
)
def cln_number_context(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_numbers(F.col("text"))).alias("h"))


# --- signs and categories -----------------------------------------------------

@report(
    "prj_split_income_expense",
    f"""WITH {TXN} SELECT tenant, CASE WHEN amount > 0 THEN 'income' WHEN amount < 0 THEN 'expense' ELSE 'zero' END AS side, count(*) AS n,
      CAST(sum(abs(amount)) AS DOUBLE) AS size FROM txn GROUP BY ALL""",
)
def prj_split_income_expense(spark, d):
    amount = F.col("amount")
    side = F.when(amount > 0, "income").when(amount < 0, "expense").otherwise("zero")
    return transactions(spark, d, "tenant", "amount").groupBy("tenant", side.alias("side")).agg(
        F.count("*").alias("n"), F.sum(F.abs("amount")).alias("size")
    )


WORDY = f"""{TXN}, wordy AS (SELECT tenant, txn_id, amount, category, CASE category WHEN 'Office' THEN 'Office supplies ' WHEN 'Software' THEN 'Invoice refund '
  WHEN 'Equipment' THEN 'Hardware repair ' WHEN 'Utilities' THEN 'Internet service ' WHEN 'Marketing' THEN 'Advertising campaign ' WHEN 'Travel' THEN 'Hotel and flight ' ELSE '' END || description AS description FROM txn)"""
WORDS = {
    "Office": "Office supplies ", "Software": "Invoice refund ", "Equipment": "Hardware repair ",
    "Utilities": "Internet service ", "Marketing": "Advertising campaign ", "Travel": "Hotel and flight ",
}


def wordy(spark, d):
    """Transactions whose text also names what the category means."""
    from tallyframe.sources.adapters import lookup

    t = transactions(spark, d, "tenant", "txn_id", "amount", "category", "description")
    return t.withColumn("description", F.concat(lookup(F.col("category"), WORDS, ""), F.col("description")))


@report(
    "prj_sign_by_keyword",
    f"""WITH {WORDY} SELECT txn_id, CAST(CASE WHEN {sql_has_word('description', C.INCOME_WORDS)} AND NOT {sql_has_word('description', C.EXPENSE_WORDS)}
      THEN abs(amount) ELSE -abs(amount) END AS DOUBLE) AS amount FROM wordy""",
)
def prj_sign_by_keyword(spark, d):
    from tallyframe.operators.clean import sign_by_keyword

    return wordy(spark, d).select("txn_id", sign_by_keyword(F.col("description"), F.col("amount")).alias("amount"))


@report(
    "prj_sign_by_category",
    f"""WITH {TXN} SELECT txn_id, CAST(CASE WHEN {sql_has_word('category', C.INCOME_CATEGORY_WORDS)} THEN abs(amount) ELSE -abs(amount) END AS DOUBLE) AS amount FROM txn""",
)
def prj_sign_by_category(spark, d):
    from tallyframe.operators.clean import sign_by_category

    return transactions(spark, d, "txn_id", "amount", "category").select(
        "txn_id", sign_by_category(F.col("category"), F.col("amount")).alias("amount")
    )


for _name, _rules, _default in (
    ("fn_category_basic", C.CATEGORY_BASIC, "Other"),
    ("fn_category_fallback", C.CATEGORY_FALLBACK, "Other"),
    ("fn_category_server", C.CATEGORY_SERVER, "General"),
):
    report(
        _name,
        f"WITH {WORDY} SELECT tenant, {sql_first_match('description', _rules, _default)} AS label, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM wordy GROUP BY ALL",
    )(
        lambda spark, d, r=_rules, x=_default: wordy(spark, d)
        .groupBy("tenant", first_match(F.col("description"), r, x).alias("label"))
        .agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    )

GL_SQL = "[" + ", ".join(
    f"struct_pack(score := (CAST(regexp_matches(t, '\\b({en})\\b') AS INTEGER) + CAST(regexp_matches(t, '(^|[^{C.ARABIC_BLOCKS}])({ar})([^{C.ARABIC_BLOCKS}]|$)') AS INTEGER)) / 2.0, rank := {-i}, category := '{c}')"
    for i, (c, (en, ar)) in enumerate(C.GL_WORDS.items())
) + ", struct_pack(score := 0.0, rank := 1, category := 'other')]"
GL = f"""{WORDY}, gd AS (SELECT DISTINCT lower(trim(description)) AS t FROM wordy), gm AS (SELECT t, list_max({GL_SQL}) AS m FROM gd),
 gl AS (SELECT tenant, m.category AS category, CAST(m.score AS DOUBLE) AS score FROM wordy JOIN gm ON gm.t = lower(trim(description)))"""


def gl_rows(spark, d):
    return wordy(spark, d).select("tenant", text.gl_scores(F.col("description")).alias("m")).select(
        "tenant", F.col("m.category").alias("category"), F.col("m.score").alias("score")
    )


@report("fn_gl_category_pattern", f"WITH {GL} SELECT tenant, category, score, count(*) AS n FROM gl GROUP BY ALL")
def fn_gl_category_pattern(spark, d):
    return gl_rows(spark, d).groupBy("tenant", "category", "score").agg(F.count("*").alias("n"))


@report(
    "fn_gl_category_decide",
    f"""WITH {GL}, c AS (SELECT tenant, category, score, count(*) AS n FROM gl GROUP BY ALL), m AS (SELECT *, (length(category) % 10) / 10.0 AS ms FROM c)
    SELECT tenant, category AS pattern_category, CASE WHEN score > 0.7 THEN category WHEN ms > 0.6 THEN 'banking' WHEN score > 0.3 THEN category ELSE 'other' END AS category,
      CAST(CASE WHEN score > 0.7 THEN score WHEN ms > 0.6 THEN ms WHEN score > 0.3 THEN score ELSE 0.1 END AS DOUBLE) AS confidence, n FROM m""",
)
def fn_gl_category_decide(spark, d):
    """The model column is a stand-in: 'banking' with a score from the label length."""
    c = fn_gl_category_pattern(spark, d).withColumn("ms", (F.length("category") % 10) / F.lit(10.0))
    pick = text.gl_decide(F.col("category"), F.col("score"), F.lit("banking"), F.col("ms"))
    return c.select("tenant", F.col("category").alias("pattern_category"), pick.alias("p"), "n").select(
        "tenant", "pattern_category", "p.category", "p.confidence", "n"
    )


@report(
    "fn_gl_name",
    f"""WITH {GL} SELECT category, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.GL_NAMES.items())} ELSE 'Other Expenses' END AS name, count(*) AS n FROM gl GROUP BY ALL""",
)
def fn_gl_name(spark, d):
    return gl_rows(spark, d).groupBy("category").agg(F.count("*").alias("n")).withColumn("name", text.gl_name(F.col("category")))


# --- documents ----------------------------------------------------------------

def _count(p):
    return f"len(regexp_extract_all(text, {q(p)}))"


GARBLED = f"""gr AS (SELECT doc_id, text, CAST({_count(text.NUMBER_RUN)} + {_count(text.NUMBER_MARK_NUMBER)} + {_count(text.NON_PRINTABLE)} AS DOUBLE)
   / nullif(length(text), 0) AS ratio FROM documents)"""
WORD_SQL = rf"\b[a-zA-Z{C.ARABIC_BLOCKS}]{{2,}}\b"


@report(
    "flt_garbled",
    f"""WITH {GARBLED} SELECT doc_id, CASE WHEN {sql_has_word('text', C.INVOICE_WORDS).replace("$", "[$]").replace(chr(92) + "[$]", "[$]")}
      OR regexp_matches(text, {q(text.MONEY_LIKE)}) OR regexp_matches(text, {q(chr(92) + 'b' + chr(92) + 'd{1,3}(?:[.,]' + chr(92) + 'd{3})*(?:[.,]' + chr(92) + 'd{2})?' + chr(92) + 'b')}) OR regexp_matches(text, '{AR}')
      THEN ratio > 0.8 ELSE ratio > 0.05 END AS garbled FROM gr""",
)
def flt_garbled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("ratio", text.garbled_ratio(F.col("text")))
    return docs.select("doc_id", text.is_garbled(F.col("text"), F.col("ratio")).alias("garbled"))


@report(
    "flt_garbled_strict",
    f"""WITH {GARBLED} SELECT doc_id, CASE WHEN CAST({_count(AR)} AS DOUBLE) / nullif(length(text), 0) > 0.3 AND {_count(WORD_SQL)} < 5 THEN true
      WHEN {sql_has_word('text', C.INVOICE_WORDS_STRICT)} AND ratio < 0.1 THEN false ELSE ratio > 0.05 END AS garbled FROM gr""",
)
def flt_garbled_strict(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("ratio", text.garbled_ratio(F.col("text")))
    return docs.select("doc_id", text.is_garbled_strict(F.col("text"), F.col("ratio")).alias("garbled"))


PLAIN = r"\s.,!?()\-"


@report(
    "flt_needs_ocr",
    f"""WITH a AS (SELECT doc_id, text, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM documents),
    r AS (SELECT doc_id, n, CAST({_count(f"[a-zA-Z{C.ARABIC_BLOCKS}]")} AS DOUBLE) / nullif(n, 0) AS readable, CAST({_count(WORD_SQL)} AS DOUBLE) / nullif(CAST(n AS DOUBLE) / 10, 0) AS words,
      CAST({_count('[0-9]{8,}')} + {_count(f"[^{chr(92)}x00-{chr(92)}x7F{C.ARABIC_BLOCKS}{PLAIN}]")} + {_count(f"[^A-Za-z0-9_{C.ARABIC_BLOCKS}{PLAIN}]")} + {_count(f"[0-9]{{6,}}{text.MARKS}")} + {_count(text.NON_PRINTABLE)} AS DOUBLE) / nullif(n, 0) AS noise,
      CAST({_count(text.NUMBER_RUN)} + {_count(text.NUMBER_MARK_NUMBER)} + {_count(text.NON_PRINTABLE)} AS DOUBLE) / nullif(n, 0) AS spec FROM a)
    SELECT doc_id, n AS text_length, round(readable, 6) AS readable_ratio, round(words, 6) AS word_ratio, round(noise, 6) AS noise_ratio, round(spec, 6) AS specific_ratio,
      CASE WHEN n < 300 THEN 'short' WHEN readable < 0.6 THEN 'unreadable' WHEN words < 0.1 THEN 'few_words' WHEN noise > 0.15 THEN 'noise' WHEN spec > 0.1 THEN 'garbled' END AS reason FROM r""",
)
def flt_needs_ocr(spark, d):
    from tallyframe.functions.money import rounded

    docs = table(spark, d, "documents").select("doc_id", "text")
    staged = docs.select("doc_id", *[c.alias(n) for n, c in text.ocr_triage(F.col("text")).items()])
    flagged = staged.withColumn("reason", text.ocr_reason())
    return flagged.select(
        "doc_id", "text_length", *[rounded(c, 6).alias(c) for c in ("readable_ratio", "word_ratio", "noise_ratio", "specific_ratio")], "reason"
    )


@report(
    "flt_min_text",
    "SELECT conv_id, turn, CASE WHEN length(trim(text)) < 60 THEN 'No text extracted' END AS error FROM conversations",
)
def flt_min_text(spark, d):
    from tallyframe.operators.clean import min_text

    return min_text(table(spark, d, "conversations"), "text", 60).select("conv_id", "turn", "error")


@report("prj_arabic_flag", f"""SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS arabic FROM lineitem""")
def prj_arabic_flag(spark, d):
    """Every second part key is written with Arabic digits."""
    key = F.col("l_partkey").cast("string")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.translate(key, "0123456789", C.ARABIC_DIGITS)).otherwise(key)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.is_arabic(shown).alias("arabic"))


@report(
    "prj_is_html",
    """SELECT 'page' AS kind, page_id AS id, regexp_matches(html, '(?is)<[a-z].*>') AS is_html FROM pages
    UNION ALL SELECT 'document', doc_id, regexp_matches(text, '(?is)<[a-z].*>') FROM documents""",
)
def prj_is_html(spark, d):
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.is_html(F.col("html")).alias("is_html"))
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.is_html(F.col("text")).alias("is_html"))
    return pages.unionByName(docs)


@report(
    "fn_advice_category",
    f"""SELECT {sql_first_match('text', C.ADVICE_CATEGORIES, 'financial_analysis')} AS category, {sql_first_match('text', C.ADVICE_TITLES, 'General Financial Advice')} AS title,
      role, count(*) AS n FROM conversations GROUP BY ALL""",
)
def fn_advice_category(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").groupBy(
        first_match(t, C.ADVICE_CATEGORIES, "financial_analysis").alias("category"),
        first_match(t, C.ADVICE_TITLES, "General Financial Advice").alias("title"), "role",
    ).agg(F.count("*").alias("n"))


# --- extraction from rendered invoices -----------------------------------------

@report(
    "fn_invoice_number",
    f"""WITH {RENDERED} SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)(?:invoice|inv|bill|receipt)[\\s#:]*([A-Z0-9-]+)', 1), ''), 'AR-000000') AS number FROM docs""",
)
def fn_invoice_number(spark, d):
    return rendered_invoices(spark, d).select("doc_id", text.invoice_number(F.col("text"), F.lit("AR-000000")).alias("number"))


@report("fn_invoice_date", f"WITH {RENDERED} SELECT doc_id, CAST(day AS VARCHAR) AS date FROM docs")
def fn_invoice_date(spark, d):
    return rendered_invoices(spark, d).select("doc_id", text.invoice_date(F.col("text"), as_date("2000-01-01")).alias("date"))


@report(
    "fn_total_from_text",
    f"""WITH {RENDERED} SELECT doc_id, CAST(coalesce(nullif(regexp_extract(text, '(?i)total[:\\s]*€?(\\d+[.,]\\d{{2}})', 1), ''), '0') AS DOUBLE) AS total FROM docs""",
)
def fn_total_from_text(spark, d):
    return rendered_invoices(spark, d).select("doc_id", text.total_from_text(F.col("text")).alias("total"))


@report(
    "fn_vendor_from_text",
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> '') AS ls FROM documents)
    SELECT doc_id, md5(coalesce(list_filter(ls[1:5], lambda s: length(s) > 10 AND NOT regexp_full_match(s, '\d+') AND NOT contains(s, '€') AND NOT contains(s, 'Phone') AND NOT contains(s, 'Invoice'))[1], 'Unknown Vendor')) AS vendor FROM l""",
)
def fn_vendor_from_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.vendor_from_text(F.col("text"))).alias("vendor"))


DATE_FORMS = """CASE o_orderkey % 5 WHEN 0 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%m-%d-%Y')
  WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') || ' due' ELSE 'no date' END"""


@report(
    "fn_date_multi",
    f"""WITH a AS (SELECT o_orderkey, {DATE_FORMS} AS t FROM orders), b AS (SELECT o_orderkey, t, regexp_extract(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS iso, regexp_extract(t, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') AS sl,
      regexp_extract(t, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') AS da, regexp_extract(t, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') AS dt FROM a)
    SELECT o_orderkey, CAST(CAST(coalesce(try_strptime(iso, '%Y-%m-%d'), try_strptime(sl, '%d/%m/%Y'), try_strptime(sl, '%m/%d/%Y'), try_strptime(da, '%d-%m-%Y'), try_strptime(da, '%m-%d-%Y'),
      try_strptime(dt, '%d.%m.%Y'), try_strptime(dt, '%m.%d.%Y')) AS DATE) AS VARCHAR) AS date FROM b""",
)
def fn_date_multi(spark, d):
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    shown = (
        F.when(kind == 0, F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"))).when(kind == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 2, F.date_format(day, "MM-dd-yyyy")).when(kind == 3, F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" due")))
        .otherwise("no date")
    )
    return table(spark, d, "orders").select("o_orderkey", shown.alias("t")).select("o_orderkey", text.date_multi(F.col("t")).alias("date"))


@report(
    "src_excel_dates",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN DATE '1999-12-31' ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS date FROM orders""",
)
def src_excel_dates(spark, d):
    """Dates written as serial numbers, ISO or day-first text must come back; junk takes the fallback."""
    day, kind = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    shown = (
        F.when(kind == 0, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")).when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(day, "dd.MM.yyyy")).otherwise("soon")
    )
    return table(spark, d, "orders").select("o_orderkey", shown.alias("t")).select(
        "o_orderkey", amounts.spreadsheet_date(F.col("t"), as_date("1999-12-31")).alias("date")
    )


SYMBOLS = ["€ 5", "USD 5", "5 £", "5 JPY", "5 دينار", "فاتورة $5", "plain 5"]


@report(
    "fn_currency_symbol",
    f"""WITH s AS (SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY ALL)
    SELECT CAST(k AS BIGINT) AS k, CASE k WHEN 0 THEN '€' WHEN 1 THEN '$' WHEN 2 THEN '£' WHEN 3 THEN '¥' WHEN 4 THEN 'JOD' WHEN 5 THEN '$' ELSE '€' END AS currency, n FROM s""",
)
def fn_currency_symbol(spark, d):
    k = (F.col("o_orderkey") % 7).alias("k")
    shown = F.array(*[F.lit(s) for s in SYMBOLS])[(F.col("o_orderkey") % 7).cast("int")]
    return table(spark, d, "orders").groupBy(k, text.currency_symbol(shown).alias("currency")).agg(F.count("*").alias("n"))


@report(
    "fn_vat_rate",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_tax = 0 THEN 19 ELSE floor(CAST(CAST(l_extendedprice * l_tax AS DECIMAL(18,2)) AS DOUBLE) /
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_extendedprice * l_tax AS DECIMAL(18,2)) AS DOUBLE) * 100 + 0.5) END AS INTEGER) AS rate FROM lineitem""",
)
def fn_vat_rate(spark, d):
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    vat = (F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.vat_rate(vat, gross).alias("rate"))


def _sqlnum(p, cap=None):
    end = " AND v <= 1000000" if cap else ""
    return f"list_filter(list_transform(regexp_extract_all(text, '{p}', 1), lambda s: TRY_CAST(s AS DOUBLE)), lambda v: v > 0{end})"


@report(
    "fn_amounts_all",
    f"""WITH a AS (SELECT doc_id, list_concat(list_concat({_sqlnum(chr(92) + 'b(' + chr(92) + 'd{4,6})' + chr(92) + 'b', 1)}, {_sqlnum(chr(92) + 'b(' + chr(92) + 'd{6})' + chr(92) + 'b', 1)}),
      list_concat(list_concat(list_filter(list_transform(regexp_extract_all(text, '(\\d{{1,3}}(?:[.,]\\d{{3}})*(?:[.,]\\d{{2}})?)', 1),
         lambda s: TRY_CAST(regexp_replace(regexp_replace(s, '[.,]\\d{{2}}$', ''), '[.,]', '', 'g') || replace(regexp_extract(s, '[.,]\\d{{2}}$'), ',', '.') AS DOUBLE)), lambda v: v > 0),
        {_sqlnum(chr(92) + 'b(' + chr(92) + 'd+' + chr(92) + '.' + chr(92) + 'd{2})' + chr(92) + 'b')}), {_sqlnum(chr(92) + 'b(' + chr(92) + 'd{3,})' + chr(92) + 'b')})) AS xs FROM documents)
    SELECT doc_id, CAST(unnest AS DOUBLE) AS amount, count(*) AS n FROM (SELECT doc_id, unnest(xs) AS unnest FROM a) GROUP BY ALL""",
)
def fn_amounts_all(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(text.amounts_in_text(F.col("text"))).alias("amount"))
    return docs.groupBy("doc_id", "amount").agg(F.count("*").alias("n"))


@report(
    "fn_arabic_segments",
    """SELECT l_orderkey, l_linenumber, translate(CAST(l_extendedprice * 100 AS BIGINT)::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS segment FROM lineitem WHERE l_extendedprice >= 1""",
)
def fn_arabic_segments(spark, d):
    """The price in cents is written with Arabic digits inside Latin text, twice."""
    cents = F.translate((F.col("l_extendedprice") * 100).cast("decimal(18,0)").cast("string"), "0123456789", C.ARABIC_DIGITS)
    shown = F.concat_ws(" ", F.lit("item"), cents, F.lit("و"), F.lit("x"), cents)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(text.arabic_segments(shown)).alias("segment"))


@report(
    "fn_conservative_text",
    f"""WITH a AS (SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) % 2 AS inc FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN inc = 0 THEN 'cannot be confirmed as stable revenue suggests growth; suggests underlying revenue-generating activity, though not captured in the data provided'
      ELSE 'Stable revenue suggests growth; suggests underlying revenue-generating activity, though not captured in the data provided' END AS health FROM a""",
)
def fn_conservative_text(spark, d):
    inc = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)) % 2
    users = table(spark, d, "events").groupBy("user_id").agg(inc.alias("inc"))
    phrase = F.lit("Stable revenue shows growth; ability to cover expenses")
    return users.select("user_id", text.soften(phrase, F.col("inc"), F.lit(-1)).alias("health"))


# --- hashes and similarity ------------------------------------------------------

@report(
    "fn_dup_hash",
    """SELECT o_orderkey, md5(concat_ws('|', c_name, CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR))) AS hash
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def fn_dup_hash(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    h = hashing.duplicate_hash(F.col("c_name"), F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("date"), F.col("o_totalprice").cast("decimal(18,2)"))
    return o.select("o_orderkey", h.alias("hash"))


@report(
    "fn_content_hash16",
    """SELECT event_id, substring(sha256('{"event":"' || event_type || '","user":"' || CAST(user_id AS VARCHAR) || '"}'), 1, 16) AS hash FROM events""",
)
def fn_content_hash16(spark, d):
    h = hashing.content_hash16(user=F.col("user_id").cast("string"), event=F.col("event_type"))
    return table(spark, d, "events").select("event_id", h.alias("hash"))


@report("fn_tm_key", "SELECT conv_id, turn, sha256('auto:ar:' || text) AS key FROM conversations")
def fn_tm_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", hashing.translation_key(F.col("text"), F.lit("ar"), F.lit("auto")).alias("key"))


@report(
    "fn_string_similarity",
    """SELECT p_partkey, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0 ELSE (greatest(length(p_name), length(p_type)) - levenshtein(p_name, lower(p_type))) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE) END, 6) AS similarity FROM part""",
)
def fn_string_similarity(spark, d):
    from tallyframe.functions.money import rounded

    return table(spark, d, "part").select(
        "p_partkey", rounded(hashing.string_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("similarity")
    )


@report("fn_normalize_key", "SELECT lower(trim('  ' || p_type || ' ' || p_brand || ' ')) AS key, count(*) AS n FROM part GROUP BY ALL")
def fn_normalize_key(spark, d):
    key = hashing.normalize_key(F.concat(F.lit("  "), "p_type", F.lit(" "), "p_brand", F.lit(" ")))
    return table(spark, d, "part").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@report(
    "fn_ttl_valid",
    """WITH t(event_type, m) AS (VALUES ('view', 2.0), ('click', 1.5), ('signup', 1.0), ('purchase', 0.5), ('error', 0.3))
    SELECT event_id, epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) < CAST(m * 86400000 AS BIGINT) * 10000 AS valid FROM events JOIN t USING (event_type)""",
)
def fn_ttl_valid(spark, d):
    """Event types stand for tasks in the order of the multipliers; base is ten days."""
    tasks = F.create_map(*[F.lit(x) for pair in zip(("view", "click", "signup", "purchase", "error"), C.TTL_MULTIPLIERS) for x in pair])
    ttl = hashing.ttl_ms(10 * 86_400_000, tasks[F.col("event_type")])
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", hashing.still_valid(F.col("ts").cast("timestamp"), ttl, now).alias("valid"))


@report(
    "fn_period_bounds",
    """WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT CAST(d AS VARCHAR) AS d, 'daily' AS kind, CAST(d AS VARCHAR) AS period_start, CAST(d AS VARCHAR) AS period_end, day(d) || '/' || month(d) || '/' || year(d) AS label FROM o
    UNION ALL SELECT CAST(d AS VARCHAR), 'weekly', strftime(d, '%Y-%m-01'), strftime(d, '%Y-%m-07'), 'Week of 1/' || month(d) || '/' || year(d) FROM o
    UNION ALL SELECT CAST(d AS VARCHAR), 'monthly', strftime(d, '%Y-%m-01'), CAST(last_day(d) AS VARCHAR), strftime(d, '%B %Y') FROM o
    UNION ALL SELECT CAST(d AS VARCHAR), 'yearly', strftime(d, '%Y-01-01'), strftime(d, '%Y-12-31'), strftime(d, '%Y') FROM o""",
)
def fn_period_bounds(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    cells = []
    for kind in ("daily", "weekly", "monthly", "yearly"):
        p = report_period(kind, F.col("d"))
        cells.append(F.struct(F.lit(kind).alias("kind"), p["start"].alias("period_start"), p["end"].alias("period_end"), p["label"].alias("label")))
    return days.select("d", F.inline(F.array(*cells)))


@report(
    "fn_complexity",
    """WITH line AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS total, l_partkey, l_returnflag FROM lineitem),
    a AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS k, avg(CAST(total AS DOUBLE)) AS m, stddev_pop(CAST(total AS DOUBLE)) AS s, bool_or(l_returnflag = 'R') AS miss FROM line GROUP BY l_orderkey)
    SELECT l_orderkey AS invoice_id, round(least(1.0, least(n / 100.0, 0.3) + least(k / CAST(n AS DOUBLE), 0.2) + least(coalesce(s / nullif(m, 0), 0) / 2, 0.2) + 0.1 * CAST(miss AS INTEGER)), 5) AS complexity FROM a""",
)
def fn_complexity(spark, d):
    from tallyframe.operators.confidence import complexity

    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("total"),
        F.col("l_partkey").alias("description"), (F.col("l_returnflag") == "R").alias("missing"),
    )
    return complexity(line)


# --- file sources ---------------------------------------------------------------

CSV = f"""raw AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS d, p_name AS description, {RAW_AMOUNT} AS raw, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'USD' END AS currency,
   CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE p_type END AS category FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""


def csv_raw(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    price = line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_index"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
        F.col("p_name").alias("Description"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("USD").alias("Currency"),
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("p_type")).alias("Category"),
        _raw_col().alias("Amount"), "l_linenumber",
    )
    return price


def _raw_col():
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    kind = F.col("l_linenumber") % 5
    return (
        F.when(kind == 0, F.concat(F.lit("€"), F.format_number(price, 2)))
        .when(kind == 1, F.replace(price.cast("string"), F.lit("."), F.lit(",")))
        .when(kind == 2, F.concat(F.lit("$ -"), price.cast("string")))
        .when(kind == 3, F.concat(F.lit("n/a "), price.cast("string")))
        .otherwise("")
    )


@report(
    "src_csv_txn",
    f"""WITH {CSV} SELECT l_orderkey || '-' || l_linenumber AS row_index, d AS date, description, 'Unknown' AS vendor, coalesce(nullif(currency, ''), 'EUR') AS currency,
      coalesce(nullif(category, ''), 'General') AS category, CASE WHEN raw = '' THEN 0 ELSE {STRICT} END AS amount, CAST(NULL AS DOUBLE) AS tax_amount FROM raw""",
)
def src_csv_txn(spark, d):
    """Files in three header orders and cases, one of them without the category column, read back by name."""
    path, raw = fresh_dir(spark, "csv"), csv_raw(spark, d)
    kind = F.col("l_linenumber") % 3
    third = raw.where(kind == 0)  # these have no category
    layouts = (
        raw.where(kind == 1).select("row_index", "Date", "Description", "Amount", "Currency", "Category"),
        raw.where(kind == 2).select("Amount", "Category", "row_index", "Currency", "Date", "Description").toDF("AMOUNT", "CATEGORY", "ROW_INDEX", "CURRENCY", "DATE", "DESCRIPTION"),
        third.select("Currency", "Description", "row_index", "Amount", "Date").toDF("currency", "description", "row_index", "amount", "date"),
    )
    for rows in layouts:
        rows.write.mode("append").option("header", True).csv(path)
    return csv_txn.normalise(csv_txn.read_csv(spark, path, (*csv_txn.FIELDS, "row_index")), "1999-12-31").drop("filename", "_malformed")


LOOSE = """coalesce(CAST(TRY_CAST(nullif(regexp_extract(regexp_replace(raw, '[$€£¥,]', '', 'g'), '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DECIMAL(18,2)) AS DOUBLE), 0)"""


@report(
    "src_csv_fuzzy_header",
    f"""WITH {CSV}, a AS (SELECT *, abs({LOOSE}) AS amount FROM raw) SELECT l_orderkey || '-' || l_linenumber AS row_index, amount, description, coalesce(nullif(category, ''), 'Other') AS category, d AS date FROM a WHERE amount <> 0""",
)
def src_csv_fuzzy_header(spark, d):
    raw = csv_raw(spark, d).select(
        "row_index", F.col("Amount").alias("Unit Price"), F.col("Description").alias("Item Details"), F.col("Category").alias("Class"),
        F.col("Date").alias("Created At"),
    )
    return csv_txn.fuzzy(raw, "1999-12-31")


LINES_SQL = r"""SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_index, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {src})"""


@report(
    "src_text_txn",
    f"""WITH {RENDERED}, alltext AS (SELECT doc_id, text FROM docs UNION ALL SELECT 'd' || doc_id, text FROM documents),
    l AS (SELECT doc_id, line_index, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM ({LINES_SQL.format(src='alltext')})),
    m AS (SELECT *, regexp_extract(line, '\\d+[.,]\\d{{2}}') AS a FROM l WHERE length(line) >= 5)
    SELECT doc_id, CAST(line_index AS INTEGER) AS line_index, CAST(TRY_CAST(replace(a, ',', '.') AS DECIMAL(18,2)) AS DOUBLE) AS amount, coalesce(nullif(trim(replace(line, a, '')), ''), 'Transaction') AS description FROM m WHERE a <> ''""",
)
def src_text_txn(spark, d):
    return csv_txn.text_transactions(all_text(spark, d))


def all_text(spark, d):
    """Rendered invoices and the prose documents as one text table."""
    prose = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return rendered_invoices(spark, d).select("doc_id", "text").unionByName(prose)


@report(
    "src_pdf_line_txn",
    f"""WITH {RENDERED}, alltext AS (SELECT doc_id, text FROM docs UNION ALL SELECT 'd' || doc_id, text FROM documents),
    l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '') AS ls FROM alltext),
    g AS (SELECT doc_id, text, ls, list_filter(ls, lambda s: regexp_matches(s, '\\d+[.,]\\d{{2}}') AND regexp_matches(s, '[a-zA-Z]') AND NOT regexp_matches(s, '(?i)^(date|description|amount|total|subtotal)') AND length(s) > 10) AS gs FROM l),
    r AS (SELECT doc_id, CAST(generate_subscripts(gs, 1) - 1 AS INTEGER) AS idx, unnest(gs) AS line FROM g WHERE len(gs) > 0)
    SELECT doc_id, idx, CAST(TRY_CAST(replace(regexp_extract(line, '\\d+[.,]\\d{{2}}'), ',', '.') AS DECIMAL(18,2)) AS DOUBLE) AS amount,
      coalesce(nullif(trim(regexp_replace(line, '\\d+[.,]\\d{{2}}', '')), ''), 'Transaction') AS description, 'PDF Document' AS vendor, 'General' AS category FROM r
    UNION ALL SELECT doc_id, 0, CAST(coalesce(nullif(replace(regexp_extract(text, '(?i)total[:\\s]*€?(\\d+[.,]\\d{{2}})', 1), ',', '.'), ''), nullif(replace(regexp_extract(text, '(?i)sum[:\\s]*€?(\\d+[.,]\\d{{2}})', 1), ',', '.'), ''), '0') AS DOUBLE), 'Document',
      coalesce(list_filter(ls[1:5], lambda s: length(s) > 10 AND NOT regexp_full_match(s, '\\d+') AND NOT contains(s, '€') AND NOT contains(s, 'Phone') AND NOT contains(s, 'Invoice'))[1], 'Unknown Vendor'), 'Document' FROM g WHERE len(gs) = 0""",
)
def src_pdf_line_txn(spark, d):
    return csv_txn.pdf_transactions(all_text(spark, d))


@report(
    "src_table_row_txn",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CASE WHEN length(p_type) > 3 THEN p_type WHEN length(p_name) > 3 THEN p_name ELSE 'Transaction' END AS description
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 <> 0""",
)
def src_table_row_txn(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.lit("nan")).otherwise(price)
    rows = line.select("l_orderkey", "l_linenumber", F.array(F.col("p_name"), F.lit(" "), shown, F.col("p_type"), F.lit("7,25")).alias("cells"))
    rows = rows.withColumn("cells", F.when(F.col("l_linenumber") % 3 == 0, F.slice("cells", 1, 4)).otherwise(F.col("cells")))
    return csv_txn.table_rows(rows)
