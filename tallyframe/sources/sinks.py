"""Writers: append tables, CSV and JSON exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.hashing import content_hash16
from tallyframe.session import exists, shuffles_removed, staged


def append_transactions(df: DataFrame, path: str, currency: str = "EUR") -> None:
    """Append with a default currency, laid out by tenant and month.

    The rebalance hint clusters rows by the partition columns, splits large partitions
    and merges small ones by their measured size: a tenant with a third of all rows is
    written by many tasks, and the number of files follows the size of the data.
    """
    out = df.withColumn("currency", F.coalesce("currency", F.lit(currency))).withColumn("month", F.date_format("date", "yyyy-MM"))
    out.hint("rebalance", "tenant", "month").write.mode("append").partitionBy("tenant", "month").parquet(path)


#: Header fields that each row of a batch export repeats, and the columns of its files.
BATCH_KEYS = ("invoice_number", "vendor_name", "invoice_date", "grand_total")
BATCH_SCHEMA = (
    "job_id string, invoice_number string, vendor_name string, invoice_date date, grand_total decimal(18,2), field_name string, field_value string, "
    "confidence double, evidence_page int, evidence_bbox string, method string, reviewed boolean"
)


def batch_rows(long_rows: DataFrame) -> DataFrame:
    """Export rows that carry ``BATCH_KEYS``, in the order of the file's columns."""
    return long_rows.withColumnRenamed("invoice_id", "job_id").select(*[c.split()[0] for c in BATCH_SCHEMA.split(", ")])


def merge_rows(changes: DataFrame, path: str, keys: list[str], partition: list[str]) -> None:
    """Replace the rows of a partitioned table whose keys the changes name, and add the changes.

    Only partitions that the changes touch are written, in one job that swaps them in when all
    its tasks have ended; the files of other partitions stay as they are. The keys must hold the
    partition columns, so an old row lies where its change goes. NULL keys are equal. A replay,
    after a failure too, leaves the same rows. A table that is not there yet is made of the changes.
    """
    if not set(partition) <= set(keys):
        raise ValueError("the keys must hold the partition columns")
    spark = changes.sparkSession
    changes = staged(changes, "changes")  # read three times
    rows = changes
    if exists(spark, path):
        old, new = spark.read.schema(changes.schema).parquet(path).alias("old"), changes.alias("new")
        same = lambda names: reduce(Column.__and__, [F.col(f"old.`{c}`").eqNullSafe(F.col(f"new.`{c}`")) for c in names])
        touched = old.join(new.select(*[f"new.`{c}`" for c in partition]).distinct().alias("new"), same(partition), "left_semi")
        kept = touched.alias("old").join(new, same(keys), "left_anti")
        rows = staged(kept.unionByName(changes), "merged")  # a table that is read cannot be written over
    rows.hint("rebalance", *partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_csv_parts(df: DataFrame, path: str, key: str, parts: int = 8) -> None:
    """Write a long export as gzip CSV files, one job for each part of the hashes of ``key``.

    Every row is in one part, rows of equal key in the same. The condition on the key reaches the
    sources through joins and unions, so the shuffle files of a part hold that part only; they
    are removed when its job has ended.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    with shuffles_removed(df.sparkSession):
        for i in range(parts):
            rows = df.where(part == i)
            rows.write.mode("append" if i else "overwrite").option("header", True).option("compression", "gzip").csv(path)


def report_sections(summary: DataFrame) -> DataFrame:
    """Report rows as (Section, Field, Value)."""
    rows = [
        ("Executive Summary", "Overall Health", F.col("overall_health")), ("Executive Summary", "Period", F.col("period")),
        ("Cashflow", "Total Inflow", F.col("inflow").cast("string")), ("Cashflow", "Total Outflow", F.col("outflow").cast("string")),
        ("Cashflow", "Net Cashflow", F.col("net").cast("string")),
    ]
    cells = [F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), v.alias("value")) for s, f, v in rows]
    return summary.select("tenant", F.inline(F.array(*cells)))


def write_reports_json(df: DataFrame, path: str) -> None:
    """One folder per report type and period."""
    df.write.mode("overwrite").partitionBy("type", "period").json(path)


def audit_entry(job_id: Column, kind: str, ts: Column, stage: Column | None = None, status: Column | None = None,
                duration_ms: Column | None = None, **metadata: Column) -> list[Column]:
    """Columns of one typed audit entry."""
    none = F.lit(None)
    pairs = [x for k in sorted(metadata) for x in (F.lit(k), metadata[k].cast("string"))]
    return [
        ts.alias("ts"), job_id.alias("job_id"), (none.cast("string") if stage is None else stage).alias("stage"),
        F.lit(kind).alias("type"), (none.cast("string") if status is None else status).alias("status"),
        (F.create_map(*pairs) if pairs else none.cast("map<string,string>")).alias("metadata"),
        (none.cast("double") if duration_ms is None else duration_ms).alias("duration_ms"),
    ]


def call_entry(job_id: Column, ts: Column, sent: Column, received: Column) -> list[Column]:
    """An external-call entry holds hashes and sizes, never the texts."""
    return audit_entry(
        job_id, "llm_call", ts, input_hash=content_hash16(body=sent), input_size=F.length(sent),
        output_hash=content_hash16(body=received), output_size=F.length(received),
    )


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_trail(audit: DataFrame, job_id: str, path: str) -> None:
    audit.where(F.col("job_id") == job_id).write.mode("overwrite").json(path)
