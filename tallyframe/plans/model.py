"""Category model reports; tree ensembles have no SQL form, so these are checked by rows."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import learn
from tallyframe.plans.registry import report
from tallyframe.sources.adapters import table


def labelled(spark, d):
    """Documents with their quality label as category."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("category"))


@functools.lru_cache(maxsize=2)
def _fitted(application: str, d: str):
    """One full-size fit per session and table folder, shared by training and prediction."""
    return learn.train_category(labelled(SparkSession.getActiveSession(), d))


def fitted(spark, d):
    return _fitted(spark.sparkContext.applicationId, d)


@report("dj_train_category")
def dj_train_category(spark, d):
    rows = labelled(spark, d)
    model, accuracy = fitted(spark, d)
    return rows.agg(F.count("*").alias("rows")).withColumn("accuracy", F.lit(float(accuracy))).withColumn(
        "terms", F.lit(len(model.stages[5].vocabulary))
    )


@report("dj_predict_category")
def dj_predict_category(spark, d):
    model, _ = fitted(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return learn.predict_category(model, docs).select("id", "predicted", "confidence")
