"""Page text, translation units and the translation memory."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.hashing import still_valid, translation_key

# Named entities of visible text.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
HIDDEN = r"(?is)<!--.*?-->|<!doctype[^>]*>|" + "|".join(
    rf"<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>" for tag in ("script", "style", "head", "template", "noscript")
)
TAG = r"<[a-zA-Z/][^>]*>"
MARK = "\x01"


def decode(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def text_nodes(html: Column) -> Column:
    """Visible text nodes in document order; comments, scripts, styles and the head are dropped."""
    visible = F.regexp_replace(html, HIDDEN, "")
    pieces = F.split(F.regexp_replace(visible, TAG, MARK), MARK)
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(decode(s), r"^\s+|\s+$", "")), lambda s: s != "")


def plain_text(html: Column) -> Column:
    return F.array_join(text_nodes(html), " ")


def page_units(pages: DataFrame) -> DataFrame:
    """One row per text node."""
    return pages.select("page_id", F.posexplode(text_nodes(F.col("html"))).alias("pos", "text"))


def lookup(requests: DataFrame, memory: DataFrame, now: datetime | str) -> DataFrame:
    """Requests with a fresh translation, if one is stored.

    Expired entries are filtered before the join; the newest entry per key is an
    aggregate, so the memory has one row per key when it meets the requests.
    """
    moment = F.lit(str(now)).cast("timestamp")
    fresh = memory.where(still_valid(F.col("ts"), F.col("ttl_ms"), moment)).groupBy("key").agg(
        F.max_by("translation", "ts").alias("translation")
    )
    keyed = requests.withColumn("key", translation_key(F.col("text"), F.col("target"), F.coalesce("source", F.lit("auto"))))
    return keyed.join(fresh, "key", "left").withColumn("from_cache", F.col("translation").isNotNull())


def misses(looked_up: DataFrame) -> DataFrame:
    """Distinct texts to translate once, with the number of requests each serves."""
    return looked_up.where(~F.col("from_cache")).groupBy("key").agg(
        F.min("text").alias("text"), F.min("target").alias("target"), F.count("*").alias("uses")
    )


def prepare(pages: DataFrame, memory: DataFrame, target: str, now: datetime | str) -> DataFrame:
    """Distinct untranslated page texts with keys and reuse counts."""
    units = page_units(pages).withColumn("target", F.lit(target)).withColumn("source", F.lit("auto"))
    return misses(lookup(units, memory, now))
