"""Row cleaning: invalid amounts, missing categories, unsigned amounts, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.constants import EXPENSE_WORDS, INCOME_CATEGORY_WORDS, INCOME_WORDS
from tallyframe.functions.rules import has_word
from tallyframe.operators.running import median, position


def valid_amounts(df: DataFrame) -> DataFrame:
    """Rows with an amount other than 0."""
    return df.where(F.col("amount").isNotNull() & (F.col("amount") != 0))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and discarded rows; the reason column comes from one pass."""
    bad = F.col("amount").isNull() | (F.col("amount") == 0)
    marked = df.withColumn("reason", F.when(bad, "Invalid amount"))
    return marked.where(F.col("reason").isNull()), marked.where(F.col("reason").isNotNull())


def fill_category(df: DataFrame, default: str = "Other") -> DataFrame:
    return df.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(default)))


def sign_by_keyword(description: Column, amount: Column, word_boundary: bool = False) -> Column:
    """Positive iff an income word and no expense word is in the text."""
    text = F.coalesce(description, F.lit(""))
    income = has_word(text, INCOME_WORDS, word_boundary) & ~has_word(text, EXPENSE_WORDS, word_boundary)
    return F.when(income, F.abs(amount)).otherwise(-F.abs(amount))


def sign_by_category(category: Column, amount: Column) -> Column:
    income = has_word(F.coalesce(category, F.lit("")), INCOME_CATEGORY_WORDS)
    return F.when(income, F.abs(amount)).otherwise(-F.abs(amount))


def flag_outliers(df: DataFrame, keys: Sequence[str] = ("tenant",), factor: float = 10.0) -> DataFrame:
    """Flag amounts above ``factor`` times the exact median of absolute amounts per key.

    Every row stays: one without an amount is not flagged, and a NULL key is not compared.
    """
    sized = df.withColumn("_size", F.abs("amount"))
    mid = median(sized.dropna(subset=[*keys, "_size"]), list(keys), "_size")
    joined = sized.join(mid, list(keys), "left")
    above = (F.col("median") > 0) & (F.col("_size").cast("double") > F.col("median") * factor)
    return joined.withColumn("flag_reason", F.when(above, "unrealistic_amount")).drop("_size", "median")


def progressive_dates(df: DataFrame, keys: Sequence[str], levels: Sequence[str], base: Column) -> DataFrame:
    """Missing dates become base + row position days; positions are counted range by range."""
    placed = position(df, keys, levels, "_pos")
    return placed.withColumn("date", F.coalesce("date", F.date_add(base, (F.col("_pos") - 1).cast("int")))).drop("_pos")


def min_text(df: DataFrame, column: str, least: int = 10) -> DataFrame:
    """Error text for rows with too little text, NULL for good rows."""
    return df.withColumn("error", F.when(F.length(F.trim(F.coalesce(column, F.lit("")))) < least, "No text extracted"))
