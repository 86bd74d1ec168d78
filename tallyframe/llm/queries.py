"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    bpe_codec,
    chat_format,
    decontaminate,
    language_id,
    passages,
    periodic_runs,
    private_data,
    quality_model,
    quality_rules,
    simhash,
    token_counts,
    url_filter,
    whitening,
)
from tallyframe.llm.common import table

VOCABULARY = "word_bpe_49k.json"

# Fixed values of the contract.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


OP7_SQL = """
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), j AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM j WHERE k = 1
"""


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    counts = [
        F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{name}")  # noqa: B023
        for kind, name in enumerate(private_data.BASE_KINDS)
    ]
    return found.select("doc_id", *counts, F.sha2(private_data.described(base), 256).alias("base_sha256"), F.col("described").alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP10_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), gram AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win))
), hit AS (
  SELECT doc_id, item_id, i, gram.m FROM gram JOIN win ON gram.s = win.s AND gram.m = win.m
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def grid(vec: Column) -> Column:
    """The contract's whole numbers: floor(1024 c) + 100000."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * 1024) + F.lit(100_000).cast("long"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, vector=grid)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    sums = F.array(*[F.lit(int(s)) for s in model.sums])
    off = F.zip_with("vec", sums, lambda x, s: x * F.lit(model.n).cast("long") - s)
    shares = F.array(*[F.lit(float(e)) for e in model.values[:8] / model.total]) if len(model.values) else F.array().cast("array<double>")
    return rows.select(
        "vec_id", F.lit(model.n).cast("long").alias("n"), F.aggregate(off, F.lit(0).cast("long"), lambda a, d: a + d * d).alias("deviation"),
        F.posexplode(F.arrays_zip(F.col("whitened").alias("whitened"), shares.alias("explained"))).alias("at", "of"),
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained",
        F.lit(whitening.identity_error(rows, "whitened")).alias("identity_error"),
    )


# Fixed value of the contract: the conversation that every run formats too.
MARKED = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat_format.parse(chat_format.format_conversations(rows), "formatted", "turns")
    back = back.withColumn("loss_text", chat_format.loss_text(F.col("formatted"), F.col("loss")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP12_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*(?:/?(?:SYS|INST|ROLE|TEXT)\]|/?s>))', '\1\\\2', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 7
           ELSE 26 + length(regexp_replace(role, '([\[<])(\\*(?:/?(?:SYS|INST|ROLE|TEXT)\]|/?s>))', '\1\\\2', 'g')) END AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The contract's planted periods: documents of every tenth crc32 repeat a stretch of theirs up to the end."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    planted = cut.filter(F.col("h") % 10 == 0).withColumn("words", words).withColumn("n", F.size("words").cast("long"))
    planted = planted.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    planted = planted.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    # whole repetitions of the stretch, cut to the length of what they replace
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    again = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.filter((F.col("h") % 10 != 0) | F.col("h").isNull()).select("doc_id", "text").unionByName(planted.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length / period by cross-multiplication; runs come by start, then period, so of equals the first stays
    top = F.aggregate("runs", F.expr("cast(null as struct<start: bigint, period: bigint, length: bigint>)"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_private_data": op2_private_data,
    "op3_simhash": op3_simhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op7_url_filters": OP7_SQL,
    "op10_decontamination": OP10_SQL,
    "op12_chat_format": OP12_SQL,
}
