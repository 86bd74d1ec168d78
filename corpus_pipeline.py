"""From raw documents to token ids: quality, copies, benchmark passages, personal data, encoding."""

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import stages
from tallyframe.llm.common import table, written

STAGES = [
    ("quality", stages.keep_quality),
    ("near_dedup", stages.drop_copies),
    ("decontaminate", stages.drop_contaminated),
    ("private_data", stages.redact_private),
    ("encode", stages.encode),
]

#: A trained classifier and components over links are not SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
