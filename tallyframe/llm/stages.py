"""The operators as filtering and rewriting stages: documents in, documents out.

Every stage takes ``(spark, docs, sf_dir)``. NULL texts count as empty, repeated rows and NULL
ids are kept unless the stage's own decision drops them, extra columns pass through (the last
stage replaces the text and its length), and empty tables give empty tables.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe_codec, decontaminate, private_data, quality_model, simhash
from tallyframe.llm.common import doc_remainder, spare_name, table

VOCABULARY = "word_bpe_49k.json"
#: Rows of crc32(id) modulo this that are 0 are held out of training, and the score from which a document stays.
FOLDS, THRESHOLD = 5, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; trained on the labelled ones among ``docs``."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), doc_remainder(F.col("id"), FOLDS) != 0)
    score = spare_name(docs, "score")
    scored = docs.withColumn(score, model.column(docs, F.col("text")))
    return scored.filter(F.col(score) >= THRESHOLD).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    name = spare_name(docs, "bench")
    found = decontaminate.occurrences(docs, table(spark, sf_dir, "benchmark"), out_col=name)
    return found.filter(F.size(F.col(name)["hits"]) == 0).select(docs.columns)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind; ``n_chars`` follows."""
    return private_data.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text, with digests of the ids and of the text decoded from them.

    Other columns pass through, but for those named as one of the four that are added, or as the decoded text.
    """
    made = ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "coded", "decoded")
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars") and c.lower() not in made)
    clear = docs.select("doc_id", "text", *keep)
    coded = bpe_codec.encode_decode(clear, public_tokenizers.path(VOCABULARY), keep=keep)
    return coded.select(
        "doc_id", *keep, "ids", F.size("ids").cast("long").alias("n_tokens"),
        bpe_codec.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
