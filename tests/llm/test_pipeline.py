"""The pipeline against a plain version of its stages, and the registered queries."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tallyframe.llm import decontaminate, private_data, quality_model, simhash
from tallyframe.llm.common import doc_remainder

SMALL = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages(spark):
    from pyspark.sql import functions as F

    docs, labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    model = quality_model.fit(docs, labels, doc_remainder(F.col("id"), 5) != 0)
    get = quality_model.hasher()

    def score(text):
        at, value = quality_model.features(text, get)
        return quality_model.probability(float(model.weights[at].sum(dtype="float64")) * value + model.bias)

    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [(i, t) for i, t in rows if score(t) >= 0.3]
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    machines = decontaminate.machines([(str(r["item_id"]), decontaminate.words_of(r["text"])) for r in bench.collect()], 10)
    rows = [(i, t) for i, t in rows if not decontaminate.search_text(t, [], [], machines)[1]]
    counts = {}
    for _, t in rows:
        for s in private_data.spans_of(t):
            counts[s["code"]] = counts.get(s["code"], 0) + 1
    keep = set(private_data.accepted(list(counts.items())))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        ids = tokenizer.encode(private_data.masked(t, [s for s in private_data.spans_of(t) if s["base"] or s["code"] in keep]), add_special_tokens=False).ids
        want[i] = (len(ids), ids, hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {i: (r["n_tokens"], r["ids"], r["decoded_sha256"]) for i, r in got.items()} == want


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and {"op7_url_filters", "op10_decontamination"} <= set(__spark_entry__.oracle_sql())


def test_sql_checks(spark):
    import check

    con = check.duck(SMALL)
    for name in ("op7_url_filters", "op10_decontamination", "op12_chat_format"):
        problem, n = check.compare(__spark_entry__.queries()[name](spark, SMALL), con, __spark_entry__.oracle_sql()[name])
        assert problem is None and n
