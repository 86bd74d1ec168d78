"""Calendar expressions; every clock value is an explicit ``as_of`` date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: date | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week_number(day: Column) -> Column:
    """Week of the year counted from the weekday of 1 January (Sunday first), not ISO."""
    first = F.trunc(day, "year")
    return F.ceil((F.dayofyear(day) - 1 + F.dayofweek(first) - 1 + 1) / F.lit(7.0)).cast("int")


def week_key(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week_number(day).cast("string"), 2, "0"))


def report_period(kind: str, as_of: date | str | Column) -> dict[str, Column]:
    """Start, end and label of the report period that holds ``as_of``.

    The weekly period is days 1 to 7 of the month.
    """
    day = as_date(as_of)
    month = F.trunc(day, "month")
    year = F.trunc(day, "year")
    if kind == "daily":
        return {"start": day, "end": day, "label": F.date_format(day, "d/M/yyyy")}
    if kind == "weekly":
        return {
            "start": month,
            "end": F.date_add(month, 6),
            "label": F.concat(F.lit("Week of "), F.date_format(month, "d/M/yyyy")),
        }
    if kind == "monthly":
        return {"start": month, "end": F.last_day(day), "label": F.date_format(month, "MMMM yyyy")}
    if kind == "yearly":
        return {
            "start": year,
            "end": F.date_sub(F.add_months(year, 12), 1),
            "label": F.date_format(day, "yyyy"),
        }
    raise ValueError(f"invalid report type: {kind}")


def tax_due_date(tax_class: Column, as_of: date | str | Column) -> Column:
    """Due date by tax class, counted from ``as_of``."""
    day = as_date(as_of)
    year = F.trunc(day, "year")
    april5 = F.date_add(F.add_months(year, 3), 4)
    income = F.when(day > april5, F.add_months(april5, 12)).otherwise(april5)
    corporate = F.last_day(F.add_months(year, 12 + 8))
    next_quarter = F.add_months(F.trunc(day, "quarter"), 3)
    next_month = F.add_months(F.trunc(day, "month"), 1)
    return (
        F.when(tax_class == "VAT by text", F.last_day(day))
        .when(tax_class == "Income Tax", income)
        .when(tax_class == "Corporate Tax", corporate)
        .when(tax_class == "Property Tax", next_quarter)
        .when(tax_class == "Social Security", next_month)
        .when(tax_class.isNotNull(), F.date_add(day, 30))
    )
