"""Registry of runnable reports and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Client-neutral column types: decimal -> double, date/timestamp -> text."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        out.append(col.alias(field.name))
    return df.select(*out)


def in_utc(spark: SparkSession) -> SparkSession:
    """Reports state times in UTC, as the stored tables do."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def report(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its inventory name, with its SQL check if it has one."""

    def wrap(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate report {name}")
        PLANS[name] = lambda spark, sf_dir: plain(fn(in_utc(spark), sf_dir))
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return wrap
