"""Reports on files, learning, audit, translation and report assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.hashing import translation_key
from tallyframe.functions.money import rounded
from tallyframe.functions.periods import report_period
from tallyframe.operators import audit as op_audit
from tallyframe.operators import budget, facts, learn, records, reports, signals, translate, trend
from tallyframe.plans import budget as p_budget
from tallyframe.plans import signals as p_signals
from tallyframe.plans import statements as p_statements
from tallyframe.plans import tax as p_tax
from tallyframe.plans.registry import report
from tallyframe.session import fresh_dir, staged
from tallyframe.sources import sinks
from tallyframe.sources.adapters import AUDIT, TXN, audit, lookup, table, transactions


# --- audit -----------------------------------------------------------------------

KIND = "CASE WHEN k % 9 = 0 THEN 'llm_call' WHEN k % 9 = 1 THEN 'human_review' WHEN k % 9 = 2 THEN 'rule_failure' END"
AUD = f"""{AUDIT}, ad AS (SELECT *, {KIND} AS type, CASE WHEN k % 4 > 0 THEN 'rule_' || k % 4 END AS rule_name, CASE WHEN k % 2 = 0 THEN 'auto_posted' END AS final_status FROM aud)"""
START, END = "2024-01-05 00:00:00", "2024-01-25 12:00:00"
IN_RANGE = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


def typed_audit(spark, d):
    k = F.col("k")
    return audit(spark, d).withColumns({
        "type": F.when(k % 9 == 0, "llm_call").when(k % 9 == 1, "human_review").when(k % 9 == 2, "rule_failure"),
        "rule_name": F.when(k % 4 > 0, F.concat(F.lit("rule_"), (k % 4).cast("string"))), "final_status": F.when(k % 2 == 0, "auto_posted"),
    })


@report(
    "ag_audit_stats",
    f"""WITH {AUD}, r AS (SELECT *, type IS NULL AS plain FROM ad WHERE {IN_RANGE})
    SELECT count(*) FILTER (type = 'llm_call') AS llm_calls, count(*) FILTER (type = 'human_review') AS human_reviews, count(*) FILTER (type = 'rule_failure') AS rule_failures,
      count(*) FILTER (plain AND stage = 'completed') AS completed_jobs, count(*) FILTER (plain AND stage = 'completed' AND final_status = 'auto_posted') AS auto_posted, count(*) FILTER (plain AND stage = 'error') AS failed_jobs,
      min(duration_ms) FILTER (duration_ms <> 0) AS min_ms, max(duration_ms) FILTER (duration_ms <> 0) AS max_ms, count(*) FILTER (plain AND stage IN ('completed', 'error')) AS total_jobs,
      round(CAST(sum(CAST(duration_ms AS DECIMAL(18,4))) FILTER (duration_ms <> 0) AS DOUBLE) / count(*) FILTER (duration_ms <> 0), 6) AS avg_ms FROM r""",
)
def ag_audit_stats(spark, d):
    return op_audit.stats(typed_audit(spark, d), START, END)


@report(
    "ag_audit_counts",
    f"""WITH {AUD} SELECT 'stage' AS kind, stage AS name, count(*) AS n FROM ad WHERE {IN_RANGE} GROUP BY ALL
    UNION ALL SELECT 'rule', coalesce(rule_name, 'unknown'), count(*) FROM ad WHERE type = 'rule_failure' AND {IN_RANGE} GROUP BY ALL""",
)
def ag_audit_counts(spark, d):
    return op_audit.counts(typed_audit(spark, d), START, END)


@report("dj_audit_trail", f"WITH {AUD} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, stage, status, duration_ms FROM ad WHERE job_id = '7'")
def dj_audit_trail(spark, d):
    return op_audit.trail(audit(spark, d), "7").select("event_id", "ts", "stage", "status", "duration_ms")


@report("src_audit_jsonl", f"WITH {AUDIT} SELECT job_id, stage, status, count(*) AS n, CAST(sum(CAST(duration_ms AS DECIMAL(18,2))) AS DOUBLE) AS ms FROM aud GROUP BY ALL")
def src_audit_jsonl(spark, d):
    """Events written as JSON lines and scanned with the fixed audit schema."""
    from tallyframe.schema import AUDIT as SCHEMA

    path = fresh_dir(spark, "audit")
    entries = audit(spark, d).select(*sinks.audit_entry(F.col("job_id"), "stage", F.col("ts"), F.col("stage"), F.col("status"), F.col("duration_ms"), k=F.col("k")))
    sinks.append_audit(entries, path)
    back = spark.read.schema(SCHEMA).json(path)
    return back.groupBy("job_id", "stage", "status").agg(F.count("*").alias("n"), F.sum(F.col("duration_ms").cast("decimal(18,2)")).alias("ms"))


@report("snk_audit_append", f"WITH {AUDIT} SELECT job_id, CASE WHEN stage = 'ocr' THEN 'llm_call' ELSE 'stage' END AS type, count(*) AS n, CAST(sum(CASE WHEN stage = 'ocr' THEN 2 ELSE 1 END) AS BIGINT) AS fields FROM aud GROUP BY ALL")
def snk_audit_append(spark, d):
    from tallyframe.schema import AUDIT as SCHEMA

    path = fresh_dir(spark, "audit")
    a = audit(spark, d)
    sinks.append_audit(a.where("stage <> 'ocr'").select(*sinks.audit_entry(F.col("job_id"), "stage", F.col("ts"), F.col("stage"), F.col("status"), F.col("duration_ms"), k=F.col("k"))), path)
    sinks.append_audit(a.where("stage = 'ocr'").select(*sinks.call_entry(F.col("job_id"), F.col("ts"), F.col("status"), F.col("stage"))), path)
    back = spark.read.schema(SCHEMA).json(path)
    return back.groupBy("job_id", "type").agg(F.count("*").alias("n"), F.sum(F.floor(F.size("metadata") / 2) + F.when(F.col("type") == "stage", 1).otherwise(0)).alias("fields"))


@report("snk_audit_export", f"WITH {AUDIT} SELECT job_id, stage, count(*) AS n FROM aud WHERE job_id = '11' GROUP BY ALL")
def snk_audit_export(spark, d):
    path = fresh_dir(spark, "trail")
    sinks.export_trail(audit(spark, d), "11", path)
    return spark.read.schema("job_id string, stage string").json(path).groupBy("job_id", "stage").agg(F.count("*").alias("n"))


# --- files, contacts, entries ------------------------------------------------------

def file_table(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("created_at"))


def file_txns(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("txn_id"), F.col("l_shipdate").cast("date").alias("date"),
    )


@report(
    "src_jobs_files",
    """SELECT 'file' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE o_custkey = 7
    UNION ALL SELECT 'txn', l_orderkey || '-' || l_linenumber || '-' || l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) FROM lineitem WHERE l_orderkey = 7""",
)
def src_jobs_files(spark, d):
    f = records.files_of(file_table(spark, d), "7").select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("created_at").cast("date").alias("date"))
    t = records.transactions_of(file_txns(spark, d), "7").select(F.lit("txn").alias("kind"), F.col("txn_id").alias("id"), "date")
    return f.unionByName(t)


@report(
    "jn_file_user_txn",
    """SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def jn_file_user_txn(spark, d):
    txns, files = file_txns(spark, d), file_table(spark, d)
    gone = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("file_id"))
    kept = records.with_owners(records.without_files(txns, gone), files).groupBy("user_id").agg(F.count("*").alias("kept"))
    everyone = records.with_owners(txns, files).groupBy("user_id").agg(F.count("*").alias("n"))
    return everyone.join(kept, "user_id", "left").select("user_id", "n", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("deleted"))


@report(
    "jn_job_validate",
    """SELECT CASE WHEN o_orderkey IS NULL THEN 'rejected' ELSE 'accepted' END AS verdict, l_linenumber, count(*) AS n FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def jn_job_validate(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    jobs = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("job_id"))
    good, bad = records.split_by_job(rows, jobs)
    both = good.withColumn("verdict", F.lit("accepted")).unionByName(bad.withColumn("verdict", F.lit("rejected")))
    return both.groupBy("verdict", "l_linenumber").agg(F.count("*").alias("n"))


@report(
    "wn_latest_entry",
    """SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'edited' ELSE o_orderstatus END AS status FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def wn_latest_entry(spark, d):
    e = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"))
    ch = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("edited").alias("status"))
    return records.update_latest(e, "o_custkey", ["o_orderdate", "o_orderkey"], ch).select("o_custkey", "o_orderkey", "status")


def contacts(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("new").alias("status"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") * 7919 % 3000).cast("int")).alias("created_at"),
    )


@report("tk_contacts", "SELECT c_custkey AS id, CAST(DATE '2020-01-01' + CAST(c_custkey * 7919 % 3000 AS INTEGER) AS VARCHAR) AS created_at FROM customer ORDER BY created_at DESC, id LIMIT 5")
def tk_contacts(spark, d):
    return records.newest(contacts(spark, d), 5).select("id", "created_at")


@report("so_contact_status", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'new' ELSE CASE s_suppkey % 3 WHEN 0 THEN 'contacted' WHEN 1 THEN 'converted' ELSE 'closed' END END AS status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def so_contact_status(spark, d):
    k = F.col("s_suppkey")
    ch = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, "contacted").when(k % 3 == 1, "converted").otherwise("closed").alias("status"))
    return records.set_status(contacts(spark, d), ch).select("id", "status")


@report("ag_admin_counts", "SELECT 'users' AS what, count(*) AS n FROM customer UNION ALL SELECT 'contacts', count(*) FROM supplier UNION ALL SELECT 'entries', count(*) FROM orders")
def ag_admin_counts(spark, d):
    parts = [table(spark, d, t).agg(F.lit(w).alias("what"), F.count("*").alias("n")) for w, t in (("users", "customer"), ("contacts", "supplier"), ("entries", "orders"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@report(
    "so_entry_edit",
    """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 10 = 1 THEN 1.00 ELSE o_totalprice END AS DOUBLE) AS value FROM orders WHERE o_orderkey % 10 <> 2
    UNION ALL SELECT 100000000000 + c_custkey, 5.0 FROM customer""",
)
def so_entry_edit(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    k = F.col("id")
    edits = e.where(k % 10 == 1).select("id", F.lit(1.0).alias("value"), F.lit("update").alias("op"))
    drops = e.where(k % 10 == 2).select("id", F.lit(None).cast("double").alias("value"), F.lit("remove").alias("op"))
    adds = table(spark, d, "customer").select((F.col("c_custkey") + 100000000000).alias("id"), F.lit(5.0).alias("value"), F.lit("add").alias("op"))
    return records.edit(e, edits.unionByName(drops).unionByName(adds))


@report("jn_vendor_prior", f"""WITH {TXN}, p AS (SELECT s_name AS vendor, 'Office' AS category, (s_suppkey % 10) / 10.0 AS prior FROM supplier)
  SELECT txn.category, CAST(coalesce(prior, 0) AS DOUBLE) AS prior, count(*) AS n FROM txn LEFT JOIN p ON p.vendor = txn.vendor AND p.category = txn.category GROUP BY ALL""")
def jn_vendor_prior(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_name").alias("vendor"), F.lit("Office").alias("category"), ((F.col("s_suppkey") % 10) / F.lit(10.0)).alias("prior"))
    return learn.vendor_prior(transactions(spark, d, "vendor", "category"), p).groupBy("category", "prior").agg(F.count("*").alias("n"))


# --- learning ----------------------------------------------------------------------

AS_OF = "2024-01-31 00:00:00"
PAT = f"""co AS (SELECT ts, 'c' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS category, CAST(user_id AS VARCHAR) AS pattern_hash, 'fix ' || event_id AS correction FROM events WHERE event_type = 'click'),
 pt AS (SELECT category, pattern_hash, count(*) AS frequency, arg_max(correction, (ts, correction)) AS correction, max(ts) AS last_seen FROM co GROUP BY ALL),
 pat AS (SELECT *, CAST(CASE WHEN frequency = 1 THEN 0.5 ELSE round(least(1.0, CAST(0.5 AS DOUBLE) + least(frequency * CAST(0.1 AS DOUBLE), 0.3) + CASE WHEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen)) / 86400000000.0 < 7 THEN 0.2 ELSE 0 END), 6) END AS DOUBLE) AS confidence FROM pt)"""


def corrections(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("c"), k.cast("string")).alias("category"), F.col("user_id").cast("string").alias("pattern_hash"),
        F.concat(F.lit("fix "), F.col("event_id").cast("string")).alias("correction"),
    )


def patterns(spark, d):
    return learn.correction_patterns(corrections(spark, d), AS_OF)


@report("ag_correction_patterns", f"WITH {PAT} SELECT category, pattern_hash, frequency, correction, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, confidence FROM pat")
def ag_correction_patterns(spark, d):
    return patterns(spark, d)


@report(
    "ag_learning_metrics",
    f"""WITH {PAT}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY last_seen, pattern_hash) AS rn, count(*) OVER (PARTITION BY category) AS n FROM pat)
    SELECT category, count(*) AS patterns, round(CAST(sum(CAST(confidence AS DECIMAL(12,6))) AS DOUBLE) / count(*), 6) AS mean_confidence,
      CASE WHEN count(*) < 2 THEN 0 ELSE round(CAST(sum(CAST(confidence AS DECIMAL(12,6))) FILTER (rn > n // 2) AS DOUBLE) / count(*) FILTER (rn > n // 2) - CAST(sum(CAST(confidence AS DECIMAL(12,6))) FILTER (rn <= n // 2) AS DOUBLE) / count(*) FILTER (rn <= n // 2), 6) END AS improvement
    FROM r GROUP BY category""",
)
def ag_learning_metrics(spark, d):
    return learn.learning_metrics(patterns(spark, d))


@report(
    "tk_patterns",
    f"""WITH {PAT} SELECT * FROM (SELECT 'top' AS kind, category, pattern_hash, confidence, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, frequency DESC, pattern_hash) AS rank FROM pat) WHERE rank <= 5
    UNION ALL (SELECT 'recent', category, pattern_hash, confidence, NULL FROM pat WHERE last_seen > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY last_seen DESC, category, pattern_hash LIMIT 10)""",
)
def tk_patterns(spark, d):
    p = patterns(spark, d)
    top = learn.top_patterns(p).select(F.lit("top").alias("kind"), "category", "pattern_hash", "confidence", "rank")
    recent = learn.recent_patterns(p, AS_OF).select(F.lit("recent").alias("kind"), "category", "pattern_hash", "confidence", F.lit(None).cast("int").alias("rank"))
    return top.unionByName(recent)


@report(
    "dj_suggestions",
    f"""WITH {PAT}, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, frequency DESC, pattern_hash) AS rn FROM pat),
    s AS (SELECT category, count(*) AS shown, count(*) FILTER (confidence > 0.8) AS strong FROM t WHERE rn <= 5 GROUP BY category), m AS (SELECT category, avg(confidence) AS mean FROM pat GROUP BY category)
    SELECT category, 'high_confidence_pattern' AS suggestion, strong AS n FROM s WHERE strong > 0 UNION ALL SELECT category, 'provide_more_corrections', 1 FROM m WHERE mean < 0.7
    UNION ALL SELECT category, 'more_learning_data', 1 FROM s WHERE shown < 3""",
)
def dj_suggestions(spark, d):
    return learn.suggestions(patterns(spark, d))


@report(
    "jn_learned_correction",
    f"""WITH {PAT}, e AS (SELECT event_id, 'c' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS category, CAST(user_id AS VARCHAR) AS pattern_hash FROM events)
    SELECT event_id, category, pattern_hash, correction AS learned, confidence AS learned_confidence, correction IS NOT NULL AS applied FROM e LEFT JOIN (SELECT * FROM pat WHERE confidence >= 0.7) p USING (category, pattern_hash)""",
)
def jn_learned_correction(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("c"), k.cast("string")).alias("category"), F.col("user_id").cast("string").alias("pattern_hash"))
    return learn.apply_learning(rows, patterns(spark, d))


SIMILAR_LIFE_MS = 2 * 86_400_000
#: Optional fields of a record: name, its column in text form, and the bit of the part key that says whether it is there.
OPTIONAL = (("size", "p_size", 1), ("status", "l_linestatus", 2), ("line", "l_linenumber", 4))


def similar_input(spark, d):
    """Order lines as records; the field names vary with the part, tasks with the flag."""
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    fields = [F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))] + [
        F.when(F.col("l_partkey").bitwiseAND(F.lit(bit)) > 0, F.create_map(F.lit(name), F.col(column).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
        for name, column, bit in OPTIONAL
    ]
    rid = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string"))
    return line.select(rid.alias("record_id"), F.col("l_returnflag").alias("task"), F.col("l_shipdate").alias("ts"), F.map_concat(*fields).alias("fields"))


def _value_bonus(column):
    """SQL: what one shared field adds; 0 where either record lacks it."""
    a, b = f"a.{column}", f"b.{column}"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 WHEN {a} = {b} THEN 0.1 ELSE 0.05 * CAST(greatest(length({a}), length({b})) - levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b}), 1) END"


OPTIONAL_SQL = ", ".join(f"CASE WHEN l_partkey & {bit} > 0 THEN CAST({column} AS VARCHAR) END AS {name}" for name, column, bit in OPTIONAL)


@report(
    "jn_fuzzy_match",
    f"""WITH r AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice AS rid, l_returnflag AS task,
      CAST(l_shipdate AS DATE) AS d, p_name AS name, p_type AS type, p_brand AS brand, {OPTIONAL_SQL}, l_partkey & 7 AS bits FROM lineitem JOIN part ON l_partkey = p_partkey),
    f AS (SELECT task, bits, d, min(rid) AS rid FROM r GROUP BY ALL),
    e AS (SELECT f.task, f.bits, f.d, coalesce(p.rid, f.rid) AS first FROM f LEFT JOIN f p ON p.task = f.task AND p.bits = f.bits AND p.d = f.d - 1),
    h AS (SELECT r.*, first FROM r JOIN e USING (task, bits, d)),
    s AS (SELECT a.rid AS a_id, b.rid AS b_id, b.d AS b_d, round(least(1.0, CAST(3 + bit_count(a.bits & b.bits) AS DOUBLE) / (3 + bit_count(a.bits | b.bits))
        + {' + '.join(_value_bonus(c) for c in ('name', 'type', 'brand', *(o[0] for o in OPTIONAL)))}), 6) AS similarity
      FROM h a JOIN r b ON a.first = a.rid AND b.task = a.task AND b.bits <> a.bits AND b.d BETWEEN a.d - 1 AND a.d AND (b.d < a.d OR b.rid < a.rid))
    SELECT rid AS record_id, first AS match_id, 1.0::DOUBLE AS similarity FROM h WHERE first <> rid
    UNION ALL SELECT a_id, b_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_d, b_id) AS rn FROM s WHERE similarity > 0.85) WHERE rn = 1""",
)
def jn_fuzzy_match(spark, d):
    return learn.similar_records(similar_input(spark, d), life_ms=SIMILAR_LIFE_MS)


# --- translation -------------------------------------------------------------------

RE_TAG = translate.TAG
NODES = f"""nd AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '{translate.HIDDEN}', '', 'g'), '{RE_TAG}', chr(1), 'g'), chr(1)),
   lambda s: regexp_replace(replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ns FROM pages),
 un AS (SELECT page_id, CAST(generate_subscripts(ns, 1) - 1 AS INTEGER) AS pos, unnest(ns) AS text FROM nd)"""


@report("dj_html_text", f"WITH {NODES} SELECT page_id, pos, text FROM un")
def dj_html_text(spark, d):
    return translate.page_units(table(spark, d, "pages"))


NOW = "2024-02-01 00:00:00"
MEM = """mem AS (SELECT sha256('auto:ar:' || text) AS key, 'T' || conv_id || '-' || turn AS translation, CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '2023-01-01 00:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END + INTERVAL (turn) SECOND AS ts
   FROM conversations WHERE turn % 2 = 0),
 fr AS (SELECT key, arg_max(translation, ts) AS translation FROM mem WHERE ts > TIMESTAMP '2024-01-25 00:00:00' GROUP BY key)"""


def memory(spark, d):
    """Even turns are stored; every third conversation long ago."""
    c = table(spark, d, "conversations").where("turn % 2 = 0")
    ts = F.when(F.col("conv_id") % 3 == 0, F.lit("2023-01-01 00:00:00")).otherwise(F.lit("2024-01-31 00:00:00")).cast("timestamp")
    return c.select(
        translation_key(F.col("text"), F.lit("ar"), F.lit("auto")).alias("key"), F.concat_ws("-", F.concat(F.lit("T"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("translation"),
        F.timestamp_seconds(F.unix_timestamp(ts) + F.col("turn")).alias("ts"), F.lit(7 * 86_400_000).cast("bigint").alias("ttl_ms"),
    )


@report(
    "jn_tm_lookup",
    f"""WITH {MEM} SELECT conv_id, turn, (f.key IS NOT NULL) AS from_cache FROM conversations c LEFT JOIN fr f ON f.key = sha256('auto:ar:' || c.text)""",
)
def jn_tm_lookup(spark, d):
    req = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lit("ar").alias("target"), F.lit("auto").alias("source"))
    return translate.lookup(req, memory(spark, d), NOW).select("conv_id", "turn", "from_cache")


PMEM = """pm AS (SELECT DISTINCT sha256('auto:ar:' || text) AS key FROM un WHERE length(text) % 2 = 0)"""


@report("dj_translate_prepare", f"WITH {NODES}, {PMEM} SELECT sha256('auto:ar:' || text) AS key, text, 'ar' AS target, count(*) AS uses FROM un WHERE sha256('auto:ar:' || text) NOT IN (SELECT key FROM pm) GROUP BY ALL")
def dj_translate_prepare(spark, d):
    """Texts of even length are already stored."""
    pages = table(spark, d, "pages")
    known = translate.page_units(pages).where(F.length("text") % 2 == 0).select("text").distinct().select(
        translation_key(F.col("text"), F.lit("ar"), F.lit("auto")).alias("key"), F.lit("T").alias("translation"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("ts"),
        F.lit(7 * 86_400_000).cast("bigint").alias("ttl_ms"),
    )
    return translate.prepare(pages, known, "ar", NOW)


# --- report assembly -----------------------------------------------------------------

# What the report reads; its confidence is the mean of 0.8, 0.7, 0.6, 0.7, 0.8 and 0.5.
REPORT_SOURCES = ", ".join(reports.SOURCES.values())
REPORT_TXN = TXN.replace("txn AS (", "plain AS (", 1) + f""",
 txn AS (SELECT * REPLACE ({p_tax.TAG} || CASE WHEN category = 'Travel' THEN 'Loan ' ELSE '' END || description AS description) FROM plain)"""
SIG = f"""{REPORT_TXN}{p_budget.OVERALL[len(TXN):]}, perf AS ({p_budget.PERF} FROM joined){p_statements.CLASS[len(TXN):]},
 af AS (SELECT tenant, CAST(ta AS DOUBLE) AS total_assets, CAST(tl AS DOUBLE) AS total_liabilities, asset_count, liability_count, asset_kinds, liability_kinds, CAST(ta - tl AS DOUBLE) AS net_worth,
   CASE WHEN ta > 0 THEN round(CAST(tl AS DOUBLE) / CAST(ta AS DOUBLE), 6) ELSE 0 END AS debt_to_asset FROM alt),
 db AS (SELECT tenant, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS debt_payments, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS loan_proceeds
   FROM txn WHERE regexp_matches(lower(description), 'loan|debt') GROUP BY tenant),
 taxed AS (SELECT tenant, txn_id, date, amount, description, category FROM txn WHERE amount <> 0), {p_tax.ENTRIES},
 tt AS (SELECT tenant, sum(CASE WHEN type = 'tax' THEN tax_part ELSE 0 END) AS tx, sum(CASE WHEN type = 'vat' THEN tax_part ELSE 0 END) AS vt, sum(net_amount) AS nt,
   count(*) FILTER (due_date BETWEEN DATE '{p_tax.AS_OF}' AND DATE '{p_tax.AS_OF}' + 30) AS upcoming,
   CAST(coalesce(sum(tax_part) FILTER (due_date BETWEEN DATE '{p_tax.AS_OF}' AND DATE '{p_tax.AS_OF}' + 30), 0) AS DOUBLE) AS upcoming_amount,
   count(*) FILTER (due_date < DATE '{p_tax.AS_OF}') AS overdue, CASE WHEN count(*) FILTER (type = 'vat') > 0 THEN 0.0 END AS vat_paid_share FROM ent GROUP BY tenant),
 tf AS (SELECT *, CAST(tx AS DOUBLE) AS total_taxes, CAST(vt AS DOUBLE) AS total_vat, CAST(nt AS DOUBLE) AS taxed_net, CASE WHEN nt > 0 THEN round(CAST(tx AS DOUBLE) / CAST(nt AS DOUBLE), 6) ELSE 0 END AS effective_tax_rate,
   CASE WHEN nt > 0 THEN round(CAST(vt AS DOUBLE) / CAST(nt AS DOUBLE), 6) ELSE 0 END AS effective_vat_rate FROM tt),
 mo AS (SELECT tenant, strftime(date, '%Y-%m') AS month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS income, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS expense, sum(amount) AS net FROM txn GROUP BY ALL),
 rm AS (SELECT * FROM mo QUALIFY month > strftime(CAST(max(month) OVER (PARTITION BY tenant) || '-01' AS DATE) - INTERVAL 12 MONTH, '%Y-%m')),
 ff AS (SELECT *, round(avg_income * (1 + income_trend / 100), 4) AS next_income, round(avg_expense * (1 + expense_trend / 100), 4) AS next_expense,
   round(avg_income * (1 + income_trend / 100) - avg_expense * (1 + expense_trend / 100), 4) AS total_net FROM {trend.sql_last_two('rm', 'tenant', 'month', ['income', 'expense', 'net'])}),
 sig AS ({signals.emit_sql('budget', 'ov')} UNION ALL {signals.emit_sql('budget_category', 'perf', label='category')} UNION ALL {signals.emit_sql('assets', 'af')}
  UNION ALL {signals.emit_sql('tax', 'tf')} UNION ALL {signals.emit_sql('forecast', 'ff')}),
 he AS (SELECT tenant, count(*) FILTER (kind = 'alert' AND severity = 'high') AS h, count(*) FILTER (kind = 'highlight' AND contains(type, 'positive')) AS p FROM sig GROUP BY tenant),
 cs AS (SELECT tenant, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS inflow, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS DOUBLE) AS outflow, CAST(sum(amount) AS DOUBLE) AS net FROM txn GROUP BY tenant),
 rep AS (SELECT cs.tenant, inflow, outflow, net, ov.budget AS total_budget, ov.actual AS total_actual, ov.variance AS budget_variance, total_assets, total_liabilities, net_worth, debt_to_asset,
   coalesce(debt_payments, 0) AS debt_payments, coalesce(loan_proceeds, 0) AS loan_proceeds, coalesce(total_taxes, 0) AS total_taxes, coalesce(total_vat, 0) AS total_vat, coalesce(taxed_net, 0) AS taxed_net,
   coalesce(effective_tax_rate, 0) AS effective_tax_rate, coalesce(effective_vat_rate, 0) AS effective_vat_rate, next_income, next_expense, ff.total_net AS next_net, income_direction, expense_direction,
   h AS high_alerts, p AS positive_highlights,
   CASE WHEN h IS NULL THEN 'fair' WHEN h = 0 AND p > 0 THEN 'excellent' WHEN h <= 1 AND p > 0 THEN 'good' WHEN h <= 2 THEN 'fair' ELSE 'poor' END AS overall_health
   FROM cs LEFT JOIN ov USING (tenant) LEFT JOIN af USING (tenant) LEFT JOIN db USING (tenant) LEFT JOIN tf USING (tenant) LEFT JOIN ff USING (tenant) LEFT JOIN he USING (tenant))"""


def report_facts(spark, d):
    """Tax words and, on Travel rows, a loan word stand before the text: the tables name neither taxes nor debts."""
    t = transactions(spark, d, "tenant", "date", "amount", "category", "description")
    loan = F.when(F.col("category") == "Travel", "Loan ").otherwise("")
    return facts.statement_facts(t.withColumn("description", F.concat(lookup(F.col("category"), p_tax.TAGS, ""), loan, "description")))


def full_report(spark, d):
    """All sections derive from one small aggregate, which alone is written; transactions are scanned once."""
    f = staged(report_facts(spark, d), "report-facts")
    spend = facts.spending(f)
    overall = budget.overall(spend, budget.tenant_budgets(spend))
    perf = budget.performance(budget.budget_actual(spend))
    assets, taxes, outlook = facts.assets(f), facts.taxes(f, p_tax.AS_OF), facts.outlook(f)
    sig = signals.union_all([
        signals.emit(overall, "budget"), signals.emit(perf, "budget_category", label="category"), signals.emit(assets, "assets"),
        signals.emit(taxes, "tax"), signals.emit(outlook, "forecast"),
    ])
    period = report_period("monthly", "1998-08-15")["label"]
    return reports.assemble(facts.cash(f).drop("txn_count"), overall, assets, facts.debts(f), taxes, outlook, sig, period), sig


@report("dj_report", f"WITH {SIG} SELECT *, 'August 1998' AS period, '{REPORT_SOURCES}' AS sources, 68 AS confidence FROM rep")
def dj_report(spark, d):
    return full_report(spark, d)[0]


@report(
    "tk_recommend",
    f"""WITH {SIG}, rc AS (SELECT tenant, type, severity AS priority, category FROM sig WHERE kind = 'recommendation' UNION ALL SELECT tenant, 'cashflow_improvement', 'high', 'Cashflow' FROM rep WHERE net < 0
      UNION ALL SELECT tenant, 'debt_reduction', 'high', 'Debt Management' FROM rep WHERE debt_to_asset > 0.8)
    SELECT *, CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM rc""",
)
def tk_recommend(spark, d):
    r, s = full_report(spark, d)
    return reports.recommendations(s, r)


@report(
    "snk_report_csv",
    f"""WITH {SIG} SELECT tenant, 'Executive Summary' AS section, 'Overall Health' AS field, overall_health AS text, CAST(NULL AS DOUBLE) AS amount FROM rep UNION ALL SELECT tenant, 'Executive Summary', 'Period', 'August 1998', NULL FROM rep
    UNION ALL SELECT tenant, 'Cashflow', 'Total Inflow', NULL, inflow FROM rep UNION ALL SELECT tenant, 'Cashflow', 'Total Outflow', NULL, outflow FROM rep UNION ALL SELECT tenant, 'Cashflow', 'Net Cashflow', NULL, net FROM rep""",
)
def snk_report_csv(spark, d):
    path = fresh_dir(spark, "report-csv")
    sinks.write_csv(sinks.report_sections(full_report(spark, d)[0]), path)
    back = spark.read.schema("tenant string, section string, field string, value string").option("header", True).csv(path)
    number = F.col("section") == "Cashflow"
    return back.select("tenant", "section", "field", F.when(~number, F.col("value")).alias("text"), F.when(number, F.col("value").try_cast("double")).alias("amount"))


@report("snk_report_json", f"WITH {SIG} SELECT tenant, 'monthly' AS type, 'August 1998' AS period, overall_health, net FROM rep")
def snk_report_json(spark, d):
    path = fresh_dir(spark, "report-json")
    out = full_report(spark, d)[0].select("tenant", F.lit("monthly").alias("type"), "period", "overall_health", F.col("net").cast("double").alias("net"))
    sinks.write_reports_json(out, path)
    return spark.read.schema("tenant string, type string, period string, overall_health string, net double").json(path)


@report(
    "snk_txn_append",
    f"""WITH {TXN} SELECT tenant, strftime(date, '%Y-%m') AS month, currency, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM
     (SELECT tenant, date, amount, CASE WHEN category = 'Travel' THEN 'EUR' ELSE currency END AS currency FROM txn) GROUP BY ALL""",
)
def snk_txn_append(spark, d):
    """All transactions, laid out by tenant and month and read back; Travel rows lack a currency."""
    path = fresh_dir(spark, "transactions")
    t = transactions(spark, d, "txn_id", "tenant", "date", "amount", "currency", "category")
    sinks.append_transactions(t.withColumn("currency", F.when(F.col("category") != "Travel", F.col("currency"))), path)
    back = spark.read.schema("txn_id string, date date, amount decimal(18,2), currency string, category string, tenant string, month string").parquet(path)
    return back.groupBy("tenant", "month", "currency").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
