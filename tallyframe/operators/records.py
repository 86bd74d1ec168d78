"""Files, entries, contacts: relations, latest rows and keyed edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.running import last_per_key


def files_of(files: DataFrame, user: str) -> DataFrame:
    """Files of a user, newest first."""
    return files.where(F.col("user_id") == user).orderBy(F.col("created_at").desc(), "file_id")


def transactions_of(txns: DataFrame, file_id: str) -> DataFrame:
    return txns.where(F.col("file_id") == file_id).orderBy(F.col("date").desc(), "txn_id")


def with_owners(txns: DataFrame, files: DataFrame) -> DataFrame:
    """Transactions with the user of their file."""
    return txns.join(files.select("file_id", "user_id"), "file_id")


def without_files(txns: DataFrame, deleted: DataFrame) -> DataFrame:
    """What remains when files are deleted with their transactions."""
    return txns.join(deleted.select("file_id"), "file_id", "left_anti")


def split_by_job(rows: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known jobs, and rows to reject."""
    known = jobs.select("job_id").distinct()
    return rows.join(known, "job_id", "left_semi"), rows.join(known, "job_id", "left_anti")


def latest_entries(entries: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return last_per_key(entries, [key], list(order))


def update_latest(entries: DataFrame, key: str, order: Sequence[str], changes: DataFrame) -> DataFrame:
    """Newest entry per key with the given fields replaced where a change names them."""
    latest = latest_entries(entries, key, order)
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields])
    return latest.join(renamed, key, "left").select(
        *[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in latest.columns]
    )


def edit(entries: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Apply a change table (op add, update or remove); other rows stay."""
    kept = entries.join(changes.select(key), key, "left_anti")
    fresh = changes.where(F.col("op").isin("add", "update")).select(*entries.columns)
    return kept.unionByName(fresh)


def set_status(contacts: DataFrame, changes: DataFrame) -> DataFrame:
    """New status by id where one is given."""
    return contacts.join(changes.select("id", F.col("status").alias("_s")), "id", "left").withColumn(
        "status", F.coalesce("_s", "status")
    ).drop("_s")


def newest(contacts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` newest contacts; a top-k plan, no full sort."""
    return contacts.orderBy(F.col("created_at").desc(), "id").limit(k)
