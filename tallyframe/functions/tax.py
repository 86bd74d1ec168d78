"""Tax class and rate as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.constants import TAX_CATEGORY_RATES, TAX_DEFAULT_RATES, TAX_RULES
from tallyframe.functions.rules import first_match

PERCENT = r"(\d+(?:\.\d+)?)%"


def percent_in_text(text: Column) -> Column:
    """First ``n%`` in the text as a number, NULL if there is none."""
    return F.regexp_extract(text, PERCENT, 1).try_cast("double")


def tax_word(description: Column) -> Column:
    """Label of the first matching keyword group, NULL if none."""
    return first_match(description, TAX_RULES, None)


def tax_class(word: Column, category: Column) -> Column:
    """The keyword group, else the category 'VAT' or 'Tax', else NULL."""
    return F.coalesce(word, F.when(category.isin(*TAX_CATEGORY_RATES), category))


def default_rate(cls: Column) -> Column:
    chain = F
    for name, rate in {**TAX_DEFAULT_RATES, **TAX_CATEGORY_RATES}.items():
        chain = chain.when(cls == name, F.lit(rate))
    return chain


def tax_rate(word: Column, cls: Column, description: Column) -> Column:
    """Rate written in a keyword-matched text, else the class default; a written 0 counts as absent."""
    written = F.when(word.isNotNull(), F.nullif(percent_in_text(description) / 100, F.lit(0.0)))
    return F.coalesce(written, default_rate(cls))
