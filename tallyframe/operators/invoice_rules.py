"""Invoice rules, duplicate windows, routing, patches and export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.constants import (
    ARITHMETIC_TOLERANCE, CATEGORY_CONFIDENCE_MIN, CURRENCY_DECIMALS, DUPLICATE_WINDOW_DAYS, FIELD_CONFIDENCE_MIN,
    FIXABLE_RULES, INVOICE_CURRENCIES,
)
from tallyframe.functions.money import dbl, rounded

AMOUNTS = ("grand_total", "subtotal", "tax_amount", "discount", "shipping")
REQUIRED_FIELDS = ("invoice_number", "invoice_date", "vendor", "grand_total", "currency")
WIDE = "decimal(30,6)"


def line_facts(lines: DataFrame) -> DataFrame:
    """What headers, rules and routing need of an invoice's lines, from one aggregate.

    Sums of quantity x price and of line tax, the number of lines; of lines with ``total``
    its sum, of lines with ``category_confidence`` its least value that is not 0.
    """
    facts = [
        F.sum((F.col("quantity").cast("decimal(18,2)") * F.col("unit_price")).cast(WIDE)).alias("line_total"),
        F.sum(F.col("tax_amount")).alias("line_tax"), F.count("*").alias("line_count"),
    ]
    if "total" in lines.columns:
        facts.append(F.sum("total").alias("line_net"))
    if "category_confidence" in lines.columns:
        facts.append(F.min(F.nullif(F.col("category_confidence"), F.lit(0.0))).alias("line_confidence"))
    return lines.groupBy("invoice_id").agg(*facts)


def _given(name: str) -> Column:
    """A value that is present and not 0, else 0."""
    return F.coalesce(F.col(name).cast(WIDE), F.lit(0).cast(WIDE))


def _off(actual: Column, expected: Column, base: Column) -> Column:
    return F.try_divide(F.abs(dbl(actual) - dbl(expected)), F.abs(dbl(base)))


def failures(invoices: DataFrame, lines: DataFrame, tolerance: float = ARITHMETIC_TOLERANCE) -> DataFrame:
    """Invoices joined with their ``line_facts``, and checked by ``check_rules``."""
    return check_rules(invoices.join(line_facts(lines), "invoice_id", "left"), tolerance)


def check_rules(joined: DataFrame, tolerance: float = ARITHMETIC_TOLERANCE) -> DataFrame:
    """Invoices that carry their ``line_facts``, with an array of rule failures (rule, path, expected, actual).

    Every rule is an expression over the row; nothing is joined. A value of 0 counts as absent
    where the rules say so. A column ``<amount>_text`` holds an amount as it was read: text
    without a number breaks ``amount_format``.
    """
    given = set(joined.columns)
    start = F.when(_given("subtotal") != 0, _given("subtotal")).otherwise(_given("grand_total"))
    joined = joined.withColumn("_expected", start + _given("tax_amount") + _given("shipping") - _given("discount"))
    joined = joined.withColumn("_tax_expected", dbl(F.col("subtotal")) * F.coalesce(F.col("tax_rate"), F.lit(0.0)) / 100)
    expected = F.col("_expected")
    line_total = F.coalesce(F.col("line_total"), F.lit(0).cast(WIDE))
    line_tax = F.coalesce(F.col("line_tax").cast(WIDE), F.lit(0).cast(WIDE))

    def fail(condition: Column, rule: str, path: str, want: Column | None = None, got: Column | None = None) -> Column:
        none = F.lit(None).cast("double")
        return F.when(
            condition,
            F.struct(
                F.lit(rule).alias("rule"), F.lit(path).alias("path"),
                (none if want is None else dbl(want)).alias("expected"), (none if got is None else dbl(got)).alias("actual"),
            ),
        )

    checks = [
        fail((expected != 0) & (_off(F.col("grand_total"), expected, expected) > tolerance), "arithmetic_balance", "/amounts/grand_total", expected, F.col("grand_total")),
        fail((_given("subtotal") != 0) & (_off(F.col("subtotal"), line_total, F.col("subtotal")) > tolerance), "line_sum_subtotal", "/amounts/subtotal", line_total, F.col("subtotal")),
        fail((_given("tax_amount") != 0) & (_off(F.col("tax_amount"), line_tax, F.col("tax_amount")) > tolerance), "line_sum_tax", "/amounts/tax_amount", line_tax, F.col("tax_amount")),
        fail(F.coalesce(F.col("invoice_date_text"), F.lit("")) == "", "required_date", "/invoice_date"),
        fail((F.col("invoice_date_text") != "") & F.col("invoice_date").isNull(), "date_format", "/invoice_date"),
        fail((F.col("due_date_text") != "") & F.col("due_date").isNull(), "date_format", "/due_date"),
        fail(F.col("due_date") < F.col("invoice_date"), "date_logic", "/due_date"),
        fail(F.coalesce(F.col("currency"), F.lit("")) == "", "required_currency", "/amounts/currency"),
        fail((F.col("currency") != "") & ~F.col("currency").isin(*INVOICE_CURRENCIES), "currency_format", "/amounts/currency"),
        fail(F.coalesce(F.col("duplicate_hash"), F.lit("")) == "", "duplicate_hash", "/duplicate_hash"),
        fail(
            (F.col("tax_rate") != 0) & (_given("tax_amount") != 0) & (F.col("_tax_expected") != 0)
            & (_off(F.col("tax_amount"), F.col("_tax_expected"), F.col("_tax_expected")) > tolerance),
            "tax_coherence", "/amounts/tax_amount", F.col("_tax_expected"), F.col("tax_amount"),
        ),
    ]
    checks += [fail(F.col(a) < 0, "non_negative_amount", f"/amounts/{a}") for a in AMOUNTS]
    for a in AMOUNTS:
        if f"{a}_text" in given:
            checks.append(fail(F.col(f"{a}_text").isNotNull() & F.col(a).isNull(), "amount_format", f"/amounts/{a}"))
            places = F.length(F.regexp_extract(F.col(f"{a}_text"), r"\.(\d+)$", 1))
            checks.append(fail(places > CURRENCY_DECIMALS, "rounding_policy", f"/amounts/{a}"))
        else:
            # more decimals than the policy allows
            scaled = F.col(a).cast(WIDE)
            checks.append(fail(scaled != F.round(scaled, CURRENCY_DECIMALS), "rounding_policy", f"/amounts/{a}"))
    return joined.withColumn("failures", F.array_compact(F.array(*checks))).drop("_expected", "_tax_expected")


def failure_rows(checked: DataFrame) -> DataFrame:
    """Failures as long rows."""
    return checked.select("invoice_id", F.inline("failures"))


def duplicates(invoices: DataFrame, days: int = DUPLICATE_WINDOW_DAYS) -> DataFrame:
    """Invoices whose hash was seen in the ``days`` days before (or earlier that day).

    Copies collapse to one row per hash and day before the window, so a hash carried
    by a third of all rows is scanned as its distinct days. An invoice without hash or
    date is no duplicate, and stays.
    """
    daily = invoices.dropna(subset=["duplicate_hash", "invoice_date"]).groupBy("duplicate_hash", "invoice_date").agg(F.min("invoice_id").alias("_first"))
    w = Window.partitionBy("duplicate_hash").orderBy("invoice_date")
    daily = daily.withColumn("_prev", F.lag("invoice_date").over(w))
    joined = invoices.join(daily, ["duplicate_hash", "invoice_date"], "left")
    later_copy = F.coalesce(F.col("invoice_id") != F.col("_first"), F.lit(False))
    recent = F.coalesce(F.datediff("invoice_date", "_prev") <= days, F.lit(False))
    return joined.withColumn("is_duplicate", later_copy | recent).drop("_first", "_prev")


def decide(checked: DataFrame, field_min: float = FIELD_CONFIDENCE_MIN, category_min: float = CATEGORY_CONFIDENCE_MIN) -> DataFrame:
    """auto_post, patch or needs_review from the field, rule and category checks of an invoice with its ``line_facts``.

    The category of an invoice without graded lines is sure.
    """
    weakest = F.coalesce("line_confidence", F.lit(1.0)) if "line_confidence" in checked.columns else F.lit(1.0)
    fields = F.least(*[F.coalesce(F.col("field_confidence")[f], F.lit(0.0)) for f in REQUIRED_FIELDS])
    rules = F.transform("failures", lambda f: f["rule"])
    fixable = F.arrays_overlap(rules, F.array(*[F.lit(r) for r in FIXABLE_RULES]))
    out = checked.select(
        "*", (fields >= field_min).alias("fields_ok"), (F.size("failures") == 0).alias("rules_ok"),
        (weakest >= category_min).alias("category_ok"),
    )
    action = (
        F.when(F.col("fields_ok") & F.col("rules_ok") & F.col("category_ok"), "auto_post")
        .when(~F.col("rules_ok") & fixable, "patch").otherwise("needs_review")
    )
    return out.withColumn("action", action)


def propose_patches(failure_table: DataFrame, tokens: DataFrame) -> DataFrame:
    """Deterministic patches: grand total to its expected value where a total is seen,
    currency to EUR where a mark is seen. The evidence is the first matching token."""
    low, at = F.lower("text"), F.struct("page", "line_no")
    total_seen = low.rlike("total|amount|sum|الإجمالي|المجموع")
    mark_seen = low.rlike(r"€|\$|£|eur|usd|gbp")
    evidence = tokens.groupBy("doc_id").agg(
        F.min(F.when(total_seen, at)).alias("total_at"), F.min(F.when(mark_seen, at)).alias("currency_at")
    )
    joined = failure_table.join(evidence, failure_table.invoice_id == evidence.doc_id)
    cite = lambda c: F.array(F.concat(F.lit("p"), F.col(f"{c}.page").cast("string"), F.lit("#l"), F.col(f"{c}.line_no").cast("string")))
    amount = (F.col("rule") == "arithmetic_balance") & (F.col("path") == "/amounts/grand_total") & F.col("total_at").isNotNull()
    money = (F.col("rule") == "currency_format") & (F.col("path") == "/amounts/currency") & F.col("currency_at").isNotNull()
    out = joined.where(amount | money)
    return out.select(
        "invoice_id", F.when(amount, 1).otherwise(2).alias("seq"), F.lit("replace").alias("op"), "path",
        F.when(amount, rounded("expected", 2).cast("decimal(18,2)").cast("string")).otherwise(F.lit("EUR")).alias("value"),
        F.when(amount, F.lit("Expected total makes the arithmetic balance within tolerance"))
        .otherwise(F.lit("Currency mark detected; converted to ISO code EUR")).alias("rationale"),
        F.when(amount, cite("total_at")).otherwise(cite("currency_at")).alias("cites"),
    )


def valid_patches(patches: DataFrame) -> DataFrame:
    """Absolute path, known operation, a rationale of 10 characters, a citation."""
    ok = (
        F.col("path").startswith("/") & F.col("op").isin("replace", "add")
        & (F.length(F.trim(F.coalesce("rationale", F.lit("")))) >= 10) & (F.coalesce(F.size("cites"), F.lit(0)) > 0)
    )
    return patches.where(ok)


# Invoice columns a patch may replace, by path.
PATCH_PATHS = {
    "/amounts/grand_total": ("grand_total", "decimal(18,2)"),
    "/amounts/subtotal": ("subtotal", "decimal(18,2)"),
    "/amounts/tax_amount": ("tax_amount", "decimal(18,2)"),
    "/amounts/currency": ("currency", "string"),
    "/invoice_number": ("number", "string"),
    "/invoice_date": ("invoice_date", "date"),
}


#: Where a value was read: by field, its page and box.
EVIDENCE = "map<string, struct<page: int, bbox: array<int>>>"


def apply_patches(invoices: DataFrame, patches: DataFrame) -> DataFrame:
    """Replace patched columns with the last patch per path; one aggregate, one join.

    Invoices with a column ``evidence`` (``EVIDENCE``) get, for each field that a patch
    changed, the page of the patch's first citation; a citation names no box.
    """
    usable = {p: t for p, t in PATCH_PATHS.items() if t[0] in invoices.columns}
    last = lambda value, p: F.max_by(value, F.when(F.col("path") == p, F.col("seq")))
    traced = "evidence" in invoices.columns
    wide = patches.where(F.col("op") == "replace").groupBy("invoice_id").agg(
        *[last("value", p).alias(f"_p_{c}") for p, (c, _) in usable.items()],
        *[last(F.get("cites", F.lit(0)), p).alias(f"_e_{c}") for p, (c, _) in usable.items() if traced],
    )
    joined = invoices.join(wide, "invoice_id", "left")
    if traced:
        page = lambda c: F.regexp_extract(F.col(f"_e_{c}"), r"^p(\d+)", 1).try_cast("int")
        entry = lambda c: F.struct(F.lit({"number": "invoice_number"}.get(c, c)).alias("key"), F.struct(page(c).alias("page"), F.lit(None).cast("array<int>").alias("bbox")).alias("value"))
        patched = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"_p_{c}").try_cast(t).isNotNull(), entry(c)) for c, t in usable.values()])))
        read = F.coalesce("evidence", F.create_map().cast(EVIDENCE))
        joined = joined.withColumn("_new", patched).withColumn("evidence", F.map_concat(F.map_filter(read, lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))).drop("_new")
    out = joined.withColumns({c: F.coalesce(F.col(f"_p_{c}").try_cast(t), F.col(c)) for c, t in usable.values()})
    return out.drop(*[f"{x}{c}" for c, _ in usable.values() for x in ("_p_", "_e_")])


def rerun(joined: DataFrame, patches: DataFrame) -> DataFrame:
    """Patch invoices that carry their ``line_facts`` and run the rules again: auto_posted or needs_review."""
    again = check_rules(apply_patches(joined, valid_patches(patches)))
    return again.withColumn("status", F.when(F.size("failures") == 0, "auto_posted").otherwise("needs_review"))


def merge_sources(primary: DataFrame, secondary: DataFrame, fields: list[str], gap: float = 10.0) -> DataFrame:
    """Prefer the primary extraction: the secondary wins when the primary has no lines,
    fewer lines, or totals that differ by more than ``gap``; else fields are coalesced."""
    a = primary.select("invoice_id", *[F.col(c).alias(f"a_{c}") for c in [*fields, "n_lines", "line_total"]])
    b = secondary.select("invoice_id", *[F.col(c).alias(f"b_{c}") for c in [*fields, "n_lines", "line_total"]])
    j = a.join(b, "invoice_id", "full")
    none = F.coalesce(F.col("a_n_lines"), F.lit(0)) == 0
    fewer = F.coalesce(F.col("b_n_lines") > F.col("a_n_lines"), F.lit(False))
    apart = F.abs(F.coalesce(dbl(F.col("a_line_total")), F.lit(0.0)) - F.coalesce(dbl(F.col("b_line_total")), F.lit(0.0))) > gap
    use_b = F.col("b_n_lines").isNotNull() & (none | fewer | apart)
    return j.withColumn("source", F.when(use_b, "secondary").otherwise("primary")).select(
        "invoice_id", "source",
        *[F.when(F.col("source") == "secondary", F.col(f"b_{c}")).otherwise(F.coalesce(f"a_{c}", f"b_{c}")).alias(c) for c in fields],
    )


# Header fields of the export, always written or only when present.
EXPORT_REQUIRED = ("invoice_number", "invoice_date", "vendor_name", "grand_total", "currency")
EXPORT_OPTIONAL = (
    "due_date", "vendor_address", "vendor_tax_id", "vendor_phone", "vendor_email",
    "subtotal", "tax_amount", "tax_rate", "discount", "shipping",
)
EXPORT_LINE = ("description", "quantity", "unit_price", "total", "tax_amount")


def export_long(invoices: DataFrame, lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Field rows (name, value, confidence, page and box of the evidence, method, reviewed) of headers and lines.

    Lines meet their header whole and are exploded after that, so a shuffle holds a line once and
    not once a field; nothing is gathered per invoice. Line numbers come from the line table. ``carry`` names invoice columns that each row repeats.
    Headers and lines may hold ``evidence`` (``EVIDENCE``); a field without any has NULL, and a
    box is written as a JSON array. Line confidences are 1 unless ``field_confidence`` has them.
    """
    none = F.lit(None)

    def seen(df: DataFrame, f: str) -> list[Column]:
        at = F.col("evidence")[f] if "evidence" in df.columns else none.cast("struct<page: int, bbox: array<int>>")
        box = at["bbox"]
        return [at["page"].alias("evidence_page"), F.when(box.isNotNull(), F.concat(F.lit("["), F.array_join(box.cast("array<string>"), ", "), F.lit("]"))).alias("evidence_bbox")]

    def sure(df: DataFrame, f: str, default: float) -> Column:
        return F.coalesce(F.col("field_confidence")[f], F.lit(default)) if "field_confidence" in df.columns else F.lit(default)

    keep = ["invoice_id", "method", "reviewed", *[F.col(c).alias(f"_{c}") for c in carry]]
    names = ["invoice_id", "method", "reviewed", "field_name", "field_value", "confidence", "evidence_page", "evidence_bbox"]
    names += [F.col(f"_{c}").alias(c) for c in carry]
    cell = lambda f, opt: F.struct(
        F.lit(f).alias("field_name"), F.col(f).cast("string").alias("field_value"), sure(invoices, f, 0.0).alias("confidence"),
        *seen(invoices, f), F.lit(opt).alias("optional"),
    )
    present = [f for f in (*EXPORT_REQUIRED, *EXPORT_OPTIONAL) if f in invoices.columns]
    head = invoices.select(*keep, F.inline(F.array(*[cell(f, f in EXPORT_OPTIONAL) for f in present])))
    head = head.where(~F.col("optional") | F.col("field_value").isNotNull())
    prefix = lambda f: F.concat(F.lit("line_item_"), F.col("line_no").cast("string"), F.lit(f"_{f}"))
    written = [f for f in EXPORT_LINE if f in lines.columns]
    # the evidence goes into the shuffle as it is written, not as a map
    read = [c.alias(f"_{n}_{f}") for f in (*written, "category") for n, c in zip(("page", "box"), seen(lines, f))]
    rated = ["field_confidence"] if "field_confidence" in lines.columns else []
    whole = lines.select("invoice_id", "line_no", *written, "category", "category_confidence", *rated, *read).join(invoices.select(*keep), "invoice_id")
    cell = lambda f, confidence, m: F.struct(
        prefix(f).alias("field_name"), F.col(f).cast("string").alias("field_value"), confidence.alias("confidence"),
        F.col(f"_page_{f}").alias("evidence_page"), F.col(f"_box_{f}").alias("evidence_bbox"), m.alias("m"),
    )
    cells = [cell(f, sure(lines, f, 1.0), none.cast("string")) for f in written] + [cell("category", F.col("category_confidence"), F.lit("ml_classification"))]
    body = whole.select("invoice_id", "method", "reviewed", *[f"_{c}" for c in carry], F.inline(F.array(*cells))).where(F.col("field_value").isNotNull())
    return head.select(*names).unionByName(body.withColumn("method", F.coalesce("m", "method")).select(*names))
