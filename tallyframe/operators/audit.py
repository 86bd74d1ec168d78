"""Audit trail and processing statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.money import rounded


def trail(audit: DataFrame, job_id: str) -> DataFrame:
    """Entries of one job in time order."""
    return audit.where(F.col("job_id") == job_id).orderBy("ts", "stage")


def between(audit: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    return audit.where(F.col("ts").between(F.lit(str(start)).cast("timestamp"), F.lit(str(end)).cast("timestamp")))


def stats(audit: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """One row of counts and durations for the range.

    Typed entries count by type; the others by stage. The conditional counts merge
    on the map side, so the range ends in one small row per task.
    """
    kind, stage = F.col("type"), F.col("stage")
    plain = ~F.coalesce(kind.isin("llm_call", "human_review", "rule_failure"), F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    took = F.when(F.col("duration_ms") != 0, F.col("duration_ms"))
    out = between(audit, start, end).agg(
        n(kind == "llm_call").alias("llm_calls"), n(kind == "human_review").alias("human_reviews"), n(kind == "rule_failure").alias("rule_failures"),
        n(plain & (stage == "completed")).alias("completed_jobs"), n(plain & (stage == "completed") & (F.col("final_status") == "auto_posted")).alias("auto_posted"),
        n(plain & (stage == "error")).alias("failed_jobs"), F.sum(took.cast("decimal(18,4)")).alias("_s"), F.count(took).alias("_n"),
        F.min(took).alias("min_ms"), F.max(took).alias("max_ms"),
    )
    return out.withColumn("total_jobs", F.col("completed_jobs") + F.col("failed_jobs")).withColumn(
        "avg_ms", rounded(F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double")), 6)
    ).drop("_s", "_n")


def counts(audit: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Entries per stage and failures per rule name, as long rows."""
    inside = between(audit, start, end)
    stage = F.when(F.col("stage").isNotNull(), F.struct(F.lit("stage").alias("kind"), F.col("stage").alias("name")))
    rule = F.when(F.col("type") == "rule_failure", F.struct(F.lit("rule").alias("kind"), F.coalesce("rule_name", F.lit("unknown")).alias("name")))
    return inside.select(F.inline(F.array_compact(F.array(stage, rule)))).groupBy("kind", "name").agg(F.count("*").alias("n"))
