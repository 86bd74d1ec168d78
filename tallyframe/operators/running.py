"""Exact running totals and positions without one task per key.

A window over a key holds the whole key in one task. Here all rows are dealt out once by ranges
of (key, order) that Spark balances by a sample of all rows, so a range holds its share of rows
whatever the keys and ids look like. Rows are summed within their range and key; what lies before
is the sum of the earlier ranges of the key. Only the first key of a range can have begun in an
earlier one, so there are no more such offsets than ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import staged


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, kind: str = "decimal(28,2)", ranges: int | None = None
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` within ``keys`` in the given order.

    Rows that tie in all of ``order`` must be interchangeable; they stay in one range. Rows with
    NULL keys or order stay: NULL is a key of its own, and sorts first; NULL values add
    nothing. The rows are written once, range by range; ``ranges`` fixes their number, else it is
    the session's number of shuffle partitions, merged where they are small.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_v", value.cast(kind))
    dealt = rows.repartitionByRange(ranges, *keys, *order) if ranges else rows.repartitionByRange(*keys, *order)
    rows = staged(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range", *keys).agg(F.coalesce(F.sum("_v"), F.lit(0)).cast(kind).alias("_s"))
    carried = sums.withColumn("_o", F.sum("_s").over(earlier).cast(kind)).where(F.col("_o").isNotNull()).select(
        F.col("_range").alias("_at"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_o"
    )
    match = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # at most one row a range
    joined = rows.withColumn("_run", F.sum("_v").over(inner)).join(F.broadcast(carried), match, "left")
    whole = F.when(F.col("_o").isNull(), F.col("_run")).otherwise(F.coalesce("_run", F.lit(0)) + F.col("_o"))
    return joined.withColumn(out, whole.cast(kind)).drop("_v", "_run", "_range", "_at", "_o", *[f"_k{i}" for i in range(len(keys))])


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the 1-based row position within ``keys`` in the given order."""
    return running_total(df, keys, order, F.lit(1), out, kind="bigint")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as a hash aggregate with map-side combine (no window)."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", width: int = 1000) -> DataFrame:
    """Exact interpolated median per key by histogram refinement.

    Pass 1 counts coarse bins (``floor(value / width)``), pass 2 counts only the
    values of the bins that hold the two middle ranks. Nothing larger than the
    bins of a key, or the distinct cents of one bin, meets in a task.
    """
    keys = list(keys)
    binned = df.where(F.col(value).isNotNull()).withColumn(
        "_bin", F.floor(F.col(value).cast("double") / width).cast("bigint")
    )
    by_bin = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    hist = (
        binned.groupBy(*keys, "_bin")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_bin), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(whole))
    )
    low = F.expr("(_total + 1) div 2")
    high = F.expr("(_total + 2) div 2")
    picked = hist.where(
        ((low > F.col("_before")) & (low <= F.col("_before") + F.col("_n")))
        | ((high > F.col("_before")) & (high <= F.col("_before") + F.col("_n")))
    ).drop("_n")
    fine = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        binned.join(picked, keys + ["_bin"])
        .groupBy(*keys, "_bin", "_before", "_total", value)
        .agg(F.count("*").alias("_n"))
        .withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(fine), F.lit(0)))
    )
    inside = lambda rank: (rank > F.col("_from")) & (rank <= F.col("_from") + F.col("_n"))
    as_double = F.col(value).cast("double")
    return cells.groupBy(*keys).agg(
        (
            (F.max(F.when(inside(low), as_double)) + F.max(F.when(inside(high), as_double))) / F.lit(2.0)
        ).alias(out)
    )
