"""Change of the last bucket against the one before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import dbl, round_floor


def change_percent(current: Column, previous: Column) -> Column:
    """Unrounded percent change; 0 when there is no previous value or it is 0."""
    pct = (dbl(current) - dbl(previous)) / F.abs(dbl(previous)) * 100
    return F.when(previous.isNull() | (dbl(previous) == 0), F.lit(0.0)).otherwise(pct)


def direction(percent: Column) -> Column:
    return F.when(percent > 5, "increasing").when(percent < -5, "decreasing").otherwise("stable")


def last_two(df: DataFrame, keys: Sequence[str], bucket: str, values: Sequence[str]) -> DataFrame:
    """Per key: number of buckets, and for each value its mean and the trend of the
    last two buckets. ``df`` must already hold one row per key and bucket."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    staged = df
    for v in values:
        staged = staged.withColumn(f"_p_{v}", F.lag(v).over(w))
    aggs: list[Column] = [F.count("*").alias("buckets")]
    for v in values:
        aggs.append(F.max_by(F.struct(F.col(v).alias("c"), F.col(f"_p_{v}").alias("p")), bucket).alias(f"_t_{v}"))
        aggs.append((dbl(F.sum(v)) / F.count("*")).alias(f"avg_{v}"))
    out = staged.groupBy(*keys).agg(*aggs)
    for v in values:
        raw = change_percent(F.col(f"_t_{v}.c"), F.col(f"_t_{v}.p"))
        out = out.withColumn(f"{v}_trend", round_floor(raw)).withColumn(f"{v}_direction", direction(raw))
    return out.drop(*[f"_t_{v}" for v in values])


SQL_DIRECTION = "CASE WHEN {p} > 5 THEN 'increasing' WHEN {p} < -5 THEN 'decreasing' ELSE 'stable' END"


def sql_last_two(source: str, keys: str, bucket: str, values: Sequence[str]) -> str:
    """The same computation as a SQL subquery."""
    lags = ", ".join(f"lag(CAST({v} AS DOUBLE)) OVER (PARTITION BY {keys} ORDER BY {bucket}) AS p_{v}" for v in values)
    parts, outer = [], []
    for v in values:
        c, p = f"arg_max(CAST({v} AS DOUBLE), {bucket})", f"arg_max(coalesce(p_{v}, 0), {bucket})"
        parts.append(f"CASE WHEN {p} = 0 THEN 0 ELSE ({c} - {p}) / abs({p}) * 100 END AS r_{v}")
        parts.append(f"CAST(sum({v}) AS DOUBLE) / count(*) AS avg_{v}")
        outer.append(f"floor(r_{v} * 100 + 0.5) / 100 AS {v}_trend, {SQL_DIRECTION.format(p=f'r_{v}')} AS {v}_direction, avg_{v}")
    return (
        f"(SELECT {keys}, buckets, {', '.join(outer)} FROM (SELECT {keys}, count(*) AS buckets, {', '.join(parts)} "
        f"FROM (SELECT *, {lags} FROM {source}) GROUP BY {keys}))"
    )
