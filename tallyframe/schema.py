"""Static schemas of the canonical tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, D, TS, I, L, F64, B = (
    T.StringType(),
    T.DateType(),
    T.TimestampType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
)
META = T.MapType(S, S)

TRANSACTION = _struct(
    ("txn_id", S), ("tenant", S), ("file_id", S), ("date", D), ("description", S), ("vendor", S),
    ("amount", MONEY), ("currency", S), ("category", S), ("tax_amount", MONEY), ("meta", META),
)
BUDGET = _struct(
    ("budget_id", S), ("tenant", S), ("category", S), ("monthly", MONEY), ("yearly", MONEY),
    ("currency", S), ("month", S), ("priority", S),
)
FX_RATE = _struct(("currency", S), ("valid_from", D), ("rate", F64))
REPORTED_TOTALS = _struct(
    ("file_id", S), ("total_income", MONEY), ("total_expenses", MONEY), ("net_cashflow", MONEY),
    ("profit_margin", F64), ("financial_health", S),
    ("alerts", T.ArrayType(_struct(("type", S), ("message", S), ("severity", S)))),
)
INVOICE = _struct(
    ("invoice_id", S), ("tenant", S), ("vendor", S), ("number", S), ("invoice_date", D), ("due_date", D),
    ("subtotal", MONEY), ("tax_amount", MONEY), ("tax_rate", F64), ("discount", MONEY), ("shipping", MONEY),
    ("grand_total", MONEY), ("currency", S), ("field_confidence", T.MapType(S, F64)), ("method", S),
    ("reviewed", B),
)
INVOICE_LINE = _struct(
    ("invoice_id", S), ("line_no", I), ("description", S), ("quantity", F64), ("unit_price", MONEY),
    ("total", MONEY), ("tax_amount", MONEY), ("tax_rate", F64), ("category", S), ("category_confidence", F64),
)
PATCH = _struct(
    ("invoice_id", S), ("seq", I), ("op", S), ("path", S), ("value", S), ("rationale", S),
    ("cites", T.ArrayType(S)),
)
TOKEN = _struct(
    ("doc_id", S), ("page", I), ("line_no", I), ("text", S), ("confidence", F64), ("bbox", T.ArrayType(F64)),
)
AUDIT = _struct(
    ("ts", TS), ("job_id", S), ("stage", S), ("type", S), ("status", S), ("metadata", META), ("duration_ms", F64),
)
CORRECTION = _struct(("ts", TS), ("category", S), ("pattern_hash", S), ("correction", S))
TRANSLATION = _struct(("key", S), ("translation", S), ("ts", TS), ("ttl_ms", L))
CSV_RAW = _struct(
    ("date", S), ("description", S), ("amount", S), ("currency", S), ("category", S), ("vendor", S),
    ("tax_amount", S), ("_corrupt", S),
)
