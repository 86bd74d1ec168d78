"""Text cleaning, triage and extraction as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.constants import (
    ARABIC_BLOCKS, ARABIC_DIGITS, CURRENCY_MARKS, GL_NAMES, GL_WORDS, INVOICE_WORDS, INVOICE_WORDS_STRICT,
    PERSIAN_DIGITS, SOFT_PHRASES, SOFT_STRONG_REPLACEMENT, SOFT_STRONG_WORDS,
)
from tallyframe.functions.rules import has_word, holds_any

# word boundary on ASCII letters, digits and underscore only
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ARABIC = f"[{ARABIC_BLOCKS}]"
MARKS = r"""[!@#$%^&*()_+=\[\]{}|;':",./<>?~`]"""
NUMBER_RUN = "000[0-9]{6,}"
NUMBER_MARK_NUMBER = rf"[0-9]{{3,}}{MARKS}[0-9]{{3,}}"
NON_PRINTABLE = rf"[^\x20-\x7E{ARABIC_BLOCKS}]"
MONEY_LIKE = r"\d+[.,]\d{2}|[€$£¥]\s*\d+|\d+\s*[€$£¥]"
PAGE_BREAK = "--- PAGE BREAK ---"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def normalize_digits(text: Column) -> Column:
    """Arabic-Indic and Persian digits and separators to ASCII, whitespace collapsed."""
    ascii_text = F.translate(
        F.coalesce(text, F.lit("")), ARABIC_DIGITS + PERSIAN_DIGITS + "٬،٫", "0123456789" * 2 + ",,."
    )
    return F.trim(F.regexp_replace(ascii_text, r"\s+", " "))


def normalize_spacing(text: Column) -> Column:
    """No space before punctuation, repeated punctuation joined."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    out = F.regexp_replace(out, r"\s+([.,:;!?])", "$1")
    return F.trim(F.regexp_replace(out, r"([.,:;!?])\s*([.,:;!?])", "$1$2"))


def translated(text: Column, marks: str, ascii_marks: str) -> Column:
    """``translate`` of marks that are not ASCII; a text of as many bytes as characters has none and is left as it is."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, marks, ascii_marks))


def normalize_lines(text: Column) -> Column:
    """Digits and spacing of every line of a text normalised at once; lines keep their ends and an outer space at most."""
    ascii_text = translated(F.coalesce(text, F.lit("")), ARABIC_DIGITS + PERSIAN_DIGITS + "٬،٫", "0123456789" * 2 + ",,.")
    out = F.regexp_replace(ascii_text, r"[^\S\n]+", " ")
    out = F.regexp_replace(out, r" ([.,:;!?])", "$1")
    return F.regexp_replace(out, r"([.,:;!?]) ?([.,:;!?])", "$1$2")


def normalize_numbers(text: Column) -> Column:
    """Digits, then thousands commas dropped, decimal comma to point, mixed separators ordered."""
    out = F.regexp_replace(normalize_digits(text), r"(?<=\d),(?=\d{3}(?![A-Za-z0-9_]))", "")
    out = F.regexp_replace(out, r"(\d+)\s*,\s*(\d+)", "$1.$2")
    return F.trim(F.regexp_replace(out, r"(\d+)\s*\.\s*(\d+)\s*\.\s*(\d+)", "$1,$2.$3"))


def normalize_flat(text: Column) -> Column:
    """Digits to ASCII, decimal commas to points, other commas dropped, whitespace collapsed."""
    out = translated(F.coalesce(text, F.lit("")), ARABIC_DIGITS + PERSIAN_DIGITS + "٫", "0123456789" * 2 + ".")
    points = F.replace(F.regexp_replace(out, r"(\d+)\s*,\s*(\d+)", "$1.$2"), F.lit(","), F.lit(""))
    return F.trim(F.regexp_replace(F.when(out.contains(","), points).otherwise(out), r"\s+", " "))


def is_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def is_html(text: Column) -> Column:
    return text.rlike(r"(?is)<[a-z].*>")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return has_word(text, words)


def garbled_ratio(text: Column) -> Column:
    hits = count_of(text, NUMBER_RUN) + count_of(text, NUMBER_MARK_NUMBER) + count_of(text, NON_PRINTABLE)
    return F.try_divide(hits.cast("double"), F.length(text).cast("double"))


def is_garbled(text: Column, ratio: Column | None = None) -> Column:
    """Above 5 % of hits; above 80 % where the text reads like an invoice or is Arabic."""
    ratio = garbled_ratio(text) if ratio is None else ratio
    lenient = contains_any(text, INVOICE_WORDS) | text.rlike(MONEY_LIKE + rf"|{EDGE}\d{{1,3}}(?:[.,]\d{{3}})*(?:[.,]\d{{2}})?{EDGE}") | is_arabic(text)
    return F.when(lenient, ratio > 0.8).otherwise(ratio > 0.05)


WORD = rf"{EDGE}[a-zA-Z{ARABIC_BLOCKS}]{{2,}}{EDGE}"


def is_garbled_strict(text: Column, ratio: Column | None = None) -> Column:
    """Mostly Arabic letters with under 5 words, or above 5 % of hits unless it reads like a clean invoice."""
    ratio = garbled_ratio(text) if ratio is None else ratio
    arabic_share = F.try_divide(count_of(text, ARABIC).cast("double"), F.length(text).cast("double"))
    return (
        F.when((arabic_share > 0.3) & (count_of(text, WORD) < 5), True)
        .when(contains_any(text, INVOICE_WORDS_STRICT) & (ratio < 0.1), False)
        .otherwise(ratio > 0.05)
    )


def ocr_triage(text: Column) -> dict[str, Column]:
    """Ratios that decide whether a document needs recognition again."""
    size = F.length(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))
    n = size.cast("double")
    letters = count_of(text, f"[a-zA-Z{ARABIC_BLOCKS}]").cast("double")
    words = count_of(text, WORD).cast("double")
    plain_marks = r"\s.,!?()\-"
    noise = (
        count_of(text, "[0-9]{8,}")
        + count_of(text, rf"[^\x00-\x7F{ARABIC_BLOCKS}{plain_marks}]")
        + count_of(text, rf"[^A-Za-z0-9_{ARABIC_BLOCKS}{plain_marks}]")
        + count_of(text, rf"[0-9]{{6,}}{MARKS}")
        + count_of(text, NON_PRINTABLE)
    ).cast("double")
    specific = (count_of(text, NUMBER_RUN) + count_of(text, NUMBER_MARK_NUMBER) + count_of(text, NON_PRINTABLE)).cast("double")
    return {
        "text_length": size,
        "readable_ratio": F.try_divide(letters, n),
        "word_ratio": F.try_divide(words, n / 10),
        "noise_ratio": F.try_divide(noise, n),
        "specific_ratio": F.try_divide(specific, n),
    }


def ocr_reason(t: dict[str, Column] | None = None) -> Column:
    """First reason a document fails triage, NULL when it passes (reads the triage columns)."""
    return (
        F.when(F.col("text_length") < 300, "short").when(F.col("readable_ratio") < 0.6, "unreadable")
        .when(F.col("word_ratio") < 0.1, "few_words").when(F.col("noise_ratio") > 0.15, "noise")
        .when(F.col("specific_ratio") > 0.1, "garbled")
    )


def gl_scores(description: Column) -> Column:
    """(category, score) of the best ledger category: matched patterns of two, the
    first category wins ties; no match gives ('other', 0)."""
    low = F.lower(F.trim(description))
    entries = []
    for rank, (category, patterns) in enumerate(GL_WORDS.items()):
        hits = sum(F.when(low.rlike(rf"(?iU)\b({p})\b"), 1).otherwise(0) for p in patterns)
        entries.append(
            F.struct((hits / F.lit(2.0)).alias("score"), F.lit(-rank).alias("rank"), F.lit(category).alias("category"))
        )
    entries.append(F.struct(F.lit(0.0).alias("score"), F.lit(1).alias("rank"), F.lit("other").alias("category")))
    return F.array_max(F.array(*entries))


def gl_decide(pattern_category: Column, pattern_score: Column, model_category: Column, model_score: Column,
              strong: float = 0.7, model_min: float = 0.6, weak: float = 0.3) -> Column:
    """Strong pattern, else confident model, else weak pattern, else ('other', 0.1)."""
    pick = lambda c, s: F.struct(c.alias("category"), s.alias("confidence"))
    return (
        F.when(pattern_score > strong, pick(pattern_category, pattern_score))
        .when(model_score > model_min, pick(model_category, model_score))
        .when(pattern_score > weak, pick(pattern_category, pattern_score))
        .otherwise(pick(F.lit("other"), F.lit(0.1)))
    )


def gl_name(code: Column) -> Column:
    pairs = [F.lit(x) for kv in GL_NAMES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code], F.lit("Other Expenses"))


def first_group(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, NULL if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def invoice_number(text: Column, default: Column | None = None) -> Column:
    found = first_group(
        text,
        [
            r"(?i)(?:invoice|inv|bill|receipt)[\s#:]*([A-Z0-9-]+)",
            r"(?i)(?:رقم|فاتورة)[\s#:]*([A-Z0-9-]+)",
            r"(?i)([A-Z]{2,3}-\d{6,})",
            r"(?i)(AR-\d{6})",
        ],
    )
    return found if default is None else F.coalesce(found, default)


def invoice_date(text: Column, as_of: Column) -> Column:
    """First date in the text; slashed and dashed forms read month first."""
    shapes = [
        (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (r"(\d{2}/\d{2}/\d{4})", "MM/dd/yyyy"),
        (r"(\d{2}-\d{2}-\d{4})", "MM-dd-yyyy"), (r"(\d{1,2}/\d{1,2}/\d{4})", "M/d/yyyy"),
    ]
    return F.coalesce(*[F.try_to_date(F.regexp_extract(text, p, 1), f) for p, f in shapes], as_of)


def date_multi(text: Column) -> Column:
    """First of the accepted shapes that parses: ISO, then day first, then month first."""
    slash, dash, dot = (rf"(\d{{1,2}}{s}\d{{1,2}}{s}\d{{4}})" for s in ("/", "-", r"\."))
    shapes = [
        (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), (slash, "d/M/yyyy"), (slash, "M/d/yyyy"), (dash, "d-M-yyyy"),
        (dash, "M-d-yyyy"), (dot, "d.M.yyyy"), (dot, "M.d.yyyy"),
    ]
    return F.coalesce(*[F.try_to_date(F.regexp_extract(text, p, 1), f) for p, f in shapes])


def currency_symbol(text: Column) -> Column:
    """Currency by contained mark; Arabic text defaults to JOD."""
    jod = text.rlike("دينار|JOD|JD")
    euro, dollar = text.rlike("€|EUR"), text.rlike(r"\$|USD")
    arabic = F.when(jod, "JOD").when(euro, "€").when(dollar, "$").otherwise("JOD")
    other = (
        F.when(euro, "€").when(dollar, "$").when(text.rlike("£|GBP"), "£").when(text.rlike("¥|JPY"), "¥")
        .when(jod, "JOD").otherwise("€")
    )
    return F.when(is_arabic(text), arabic).otherwise(other)


def currency_iso(text: Column) -> Column:
    """ISO code of the first currency whose mark is in the text, NULL if none."""
    chain = F
    for code, marks in CURRENCY_MARKS.items():
        chain = chain.when(holds_any(text, marks), F.lit(code))
    return chain.otherwise(F.lit(None).cast("string"))


def text_lines(text: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def vendor_from_text(text: Column) -> Column:
    """First of the first five lines that looks like a name, else 'Unknown Vendor'."""
    ok = lambda s: (
        (F.length(s) > 10) & ~s.rlike(r"^\d+$") & ~s.contains("€") & ~s.contains("Phone") & ~s.contains("Invoice")
    )
    hits = F.filter(F.slice(text_lines(text), 1, 5), ok)
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("Unknown Vendor"))


def total_from_text(text: Column) -> Column:
    """Amount behind total, sum or amount; 0 if there is none."""
    found = first_group(text, [rf"(?i){w}[:\s]*€?(\d+[.,]\d{{2}})" for w in ("total", "sum", "amount")])
    return F.coalesce(F.replace(found, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def vat_rate(vat: Column, gross: Column) -> Column:
    """Whole percent of VAT on net, 19 if it cannot be computed."""
    known = (vat != 0) & (gross != 0)
    pct = F.try_divide(vat.cast("double"), (gross - vat).cast("double")) * 100
    return F.when(known, F.coalesce(F.floor(pct + 0.5), F.lit(19))).otherwise(F.lit(19)).cast("int")


def amounts_in_text(text: Column) -> Column:
    """Array of amounts: 4-6 digit, grouped, decimal and integer forms, pattern by pattern."""
    edge = EDGE
    whole = lambda p, cap=None: F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: s.try_cast("double")),
        lambda v: (v > 0) if cap is None else (v > 0) & (v <= cap),
    )
    # the last separator before exactly two final digits is the decimal point, others group digits
    grouped = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)"), F.lit(1)),
            lambda s: F.concat(
                F.regexp_replace(F.regexp_replace(s, r"[.,]\d{2}$", ""), "[.,]", ""),
                F.regexp_replace(F.regexp_extract(s, r"([.,]\d{2})$", 1), ",", "."),
            ).try_cast("double"),
        ),
        lambda v: v > 0,
    )
    return F.concat(
        whole(rf"{edge}(\d{{4,6}}){edge}", 1_000_000), whole(rf"{edge}(\d{{6}}){edge}", 1_000_000), grouped,
        whole(rf"{edge}(\d+\.\d{{2}}){edge}"), whole(rf"{edge}(\d{{3,}}){edge}"),
    )


def arabic_segments(text: Column, limit: int = 15) -> Column:
    """Distinct Arabic runs of 3 to 49 letters in order of appearance."""
    runs = F.regexp_extract_all(text, F.lit(f"({ARABIC}+)"), F.lit(1))
    fit = F.filter(runs, lambda s: (F.length(s) > 2) & (F.length(s) < 50))
    return F.slice(F.array_distinct(fit), 1, limit)


def soften(text: Column, income: Column, net: Column) -> Column:
    """Softer phrases in a health narrative; a stronger list without income and with a loss."""
    strict = (income == 0) & (net < 0)
    out = F.when(strict, F.regexp_replace(text, f"(?i){SOFT_STRONG_WORDS}", SOFT_STRONG_REPLACEMENT)).otherwise(text)
    for phrase, replacement in SOFT_PHRASES:
        out = F.regexp_replace(out, f"(?i){phrase}", replacement)
    return out
