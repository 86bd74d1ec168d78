"""Transaction files: delimited text, spreadsheets exported as text, lines and table rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.amounts import amount_text, fuzzy_amount
from tallyframe.functions.periods import as_date
from tallyframe.functions.text import text_lines, total_from_text, vendor_from_text

# Header words per field, defaults of missing cells.
HEADER_WORDS = {
    "amount": ("amount", "price", "value", "total"),
    "description": ("description", "item", "name", "details"),
    "category": ("category", "type", "class"),
    "date": ("date", "time", "created", "timestamp"),
}
DEFAULTS = {"description": "Transaction", "vendor": "Unknown", "currency": "EUR", "category": "General"}
LINE_AMOUNT = r"(\d+[.,]\d{2})"


def header_of(lines: DataFrame) -> DataFrame:
    """(filename, header): the first line of each file, as the lowest-placed line with content.

    ``lines`` has filename, offset and value; one aggregate row per file comes out.
    """
    return lines.where(F.trim("value") != "").groupBy("filename").agg(F.min_by("value", "offset").alias("header"))


def raw_lines(df: DataFrame) -> DataFrame:
    """(value, filename, block) of text rows read from files, batch or stream."""
    return df.select("value", F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("block"))


def placed(lines: DataFrame) -> DataFrame:
    """Raw lines with their order inside the file: by block, then by row of the block."""
    return lines.withColumn("offset", F.struct("block", F.monotonically_increasing_id().alias("row")))


#: A cell up to its separator, in a line that ends with one: runs without quotes, and quoted parts.
CELL = r'((?:[^",]++|"(?:[^"\\]++|\\.|"")*+")*+),'
#: Columns that ``normalise`` looks for.
FIELDS = ("date", *DEFAULTS, "amount", "tax_amount")


def cells_of(line: Column) -> Column:
    """Cells of a delimited line, trimmed and without their quotes."""
    bare = F.regexp_replace(line, "^\ufeff|\r$", "")
    quoted = lambda c: c.startswith('"') & c.endswith('"') & (F.length(c) > 1)
    inner = lambda c: F.regexp_replace(F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')), r'\\(["\\])', "$1")
    trimmed = F.transform(F.regexp_extract_all(F.concat(bare, F.lit(",")), F.lit(CELL), F.lit(1)), lambda c: F.trim(c))
    return F.transform(trimmed, lambda c: F.when(quoted(c), inner(c)).otherwise(c))


def header_names(header: Column) -> Column:
    """Lower-case column names of a header line; a blank or repeated one is named by its place."""
    names = F.transform(cells_of(header), lambda c: F.lower(F.trim(c)))
    placed_name = lambda k: F.concat(F.lit("column_"), (k + 1).cast("string"))
    repeated = lambda c, k: F.array_position(names, c) != k + 1
    return F.transform(names, lambda c, k: F.when(c == "", placed_name(k)).when(repeated(c, k), F.concat(c, F.lit("_"), (k + 1).cast("string"))).otherwise(c))


def by_header(lines: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of all files as strings: filename, ``_malformed``, ``cells`` by name, and a column for each of ``names``.

    A line is cut into cells once, and its own file's header, one row a file that never leaves
    the executors, names them; so thousands of layouts are read in one pass. A column that a
    file lacks is NULL; a name also finds a header without its underscores. ``_malformed``
    marks rows with another number of cells than their header; cells beyond it are left out. Of
    equal names the first is kept. Lines equal to the header and blank lines are left out.
    """
    heads = header_of(placed(lines)).select("filename", "header", header_names(F.col("header")).alias("_names"))
    own = lines.join(heads, "filename").where((F.col("value") != F.col("header")) & (F.trim("value") != ""))
    cut = own.select("filename", "_names", cells_of(F.col("value")).alias("_cells"))
    entries = F.transform("_names", lambda n, k: F.struct(n.alias("key"), F.get("_cells", k).alias("value"), (k + 1).alias("at")))
    firsts = F.filter(entries, lambda e: F.array_position("_names", e["key"]) == e["at"])
    named = cut.select(
        "filename", (F.size("_cells") != F.size("_names")).alias("_malformed"),
        F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["key"], e["value"]))).alias("cells"),
    )
    return named.select("*", *[F.coalesce(*[F.col("cells")[n] for n in dict.fromkeys((name, name.replace("_", "")))]).alias(name) for name in names])


def read_csv(spark: SparkSession, path: str, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """Raw string columns ``names``, every file's cells bound by its own header line, as ``by_header`` gives them.

    Files may differ in order, case and number of columns. Cells may be quoted; a line break
    inside a cell is not supported.
    """
    return by_header(raw_lines(spark.read.text(path)), names)


def _cell(df: DataFrame, name: str) -> Column:
    for candidate in (name, name.replace("_", "")):
        for column in df.columns:
            if column.lower() == candidate:
                return F.nullif(F.trim(F.col(f"`{column}`")), F.lit(""))
    return F.lit(None).cast("string")


def normalise(df: DataFrame, as_of: date | str) -> DataFrame:
    """Typed transactions from raw text columns, with defaults for missing cells."""
    day = _cell(df, "date")
    written = F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(day, "M/d/yyyy"), as_date(as_of))
    keep = [F.col(c) for c in ("row_index", "filename", "_malformed") if c in df.columns]
    return df.select(
        *keep, written.alias("date"),
        *[F.coalesce(_cell(df, c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()],
        amount_text(F.coalesce(_cell(df, "amount"), F.lit("0"))).alias("amount"),
        amount_text(_cell(df, "tax_amount")).alias("tax_amount"),
    )


def pick_headers(columns: list[str]) -> dict[str, str | None]:
    """First column whose name contains a word of the field."""
    return {
        field: next((c for c in columns if any(w in c.strip().lower() for w in words)), None)
        for field, words in HEADER_WORDS.items()
    }


def fuzzy(df: DataFrame, as_of: date | str) -> DataFrame:
    """Transactions from any table with an amount-like column; rows of amount 0 are dropped."""
    found = pick_headers(df.columns)
    if found["amount"] is None:
        raise ValueError("no amount-like column")
    cell = lambda f: F.nullif(F.trim(F.col(f"`{found[f]}`").cast("string")), F.lit("")) if found[f] else F.lit(None).cast("string")
    keep = [F.col(c) for c in ("row_index",) if c in df.columns]
    out = df.select(
        *keep, F.abs(fuzzy_amount(cell("amount"))).alias("amount"),
        F.coalesce(cell("description"), F.lit("Transaction")).alias("description"),
        F.coalesce(cell("category"), F.lit("Other")).alias("category"),
        F.coalesce(F.try_to_date(F.substring(cell("date"), 1, 10), "yyyy-MM-dd"), as_date(as_of)).alias("date"),
    )
    return out.where(F.col("amount") != 0)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rows whose amount is unreadable, with the reason (a blank amount is 0, as ``normalise`` makes it)."""
    why = reject_reason(df)
    return df.where(why.isNull()), df.where(why.isNotNull()).withColumn("reason", why)


def reject_reason(df: DataFrame) -> Column:
    """Why a normalised row is not accepted, or NULL."""
    malformed = F.coalesce(F.col("_malformed"), F.lit(False)) if "_malformed" in df.columns else F.lit(False)
    return F.when(malformed, "Malformed line").when(F.col("amount").isNull(), "Invalid amount")


def _line_amount(line: Column) -> Column:
    return F.replace(F.regexp_extract(line, LINE_AMOUNT, 1), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def _line_rest(line: Column, every: bool = False) -> Column:
    """The line without its amount (or without every repeat of it)."""
    if every:
        rest = F.trim(F.replace(line, F.regexp_extract(line, LINE_AMOUNT, 1), F.lit("")))
    else:
        rest = F.trim(F.regexp_replace(line, LINE_AMOUNT + "(.*)$", "$2"))
    return F.coalesce(F.nullif(rest, F.lit("")), F.lit("Transaction"))


def _numbered_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line")).withColumn(
        "line", F.regexp_replace("line", r"^\s+|\s+$", "")
    )


def text_transactions(docs: DataFrame) -> DataFrame:
    """One transaction per line of at least 5 characters with an amount."""
    lines = _numbered_lines(docs).where((F.length("line") >= 5) & F.col("line").rlike(LINE_AMOUNT))
    return lines.select("doc_id", "line_index", _line_amount(F.col("line")).alias("amount"), _line_rest(F.col("line"), every=True).alias("description"))


def pdf_transactions(docs: DataFrame) -> DataFrame:
    """Stricter lines: amount, letter, no header word, longer than 10 characters. A
    document without any gets one row with the extracted vendor and total.

    The decision is taken per document on its own line array, so nothing is joined.
    """
    good = lambda s: (
        s.rlike(LINE_AMOUNT) & s.rlike("[a-zA-Z]") & ~s.rlike("(?i)^(date|description|amount|total|subtotal)") & (F.length(s) > 10)
    )
    rows = F.filter(text_lines(F.col("text")), good)
    staged = docs.select("doc_id", "text", rows.alias("_rows"))
    return staged.select("doc_id", "text", F.posexplode_outer("_rows").alias("idx", "line")).select(
        "doc_id", F.coalesce("idx", F.lit(0)).alias("idx"),
        F.when(F.col("line").isNotNull(), _line_amount(F.col("line"))).otherwise(total_from_text(F.col("text")).cast("decimal(18,2)")).alias("amount"),
        F.when(F.col("line").isNotNull(), _line_rest(F.col("line"))).otherwise(F.lit("Document")).alias("description"),
        F.when(F.col("line").isNotNull(), "PDF Document").otherwise(vendor_from_text(F.col("text"))).alias("vendor"),
        F.when(F.col("line").isNotNull(), "General").otherwise("Document").alias("category"),
    )


def table_rows(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows of cells: the first amount cell is the amount, the last longer cell without an
    amount the description; rows without an amount are dropped."""
    trimmed = F.transform(cells, lambda c: F.trim(c))
    used = F.filter(trimmed, lambda c: (c != "") & (c != "nan"))
    amounts = F.filter(used, lambda c: c.rlike(LINE_AMOUNT))
    texts = F.filter(used, lambda c: ~c.rlike(LINE_AMOUNT) & (F.length(c) > 3))
    out = df.withColumn("_a", amounts).withColumn("_t", texts).where(F.size("_a") > 0)
    return out.withColumn("amount", _line_amount(F.element_at("_a", 1))).withColumn(
        "description", F.coalesce(F.try_element_at("_t", F.lit(-1)), F.lit("Transaction"))
    ).drop("_a", "_t", cells)
