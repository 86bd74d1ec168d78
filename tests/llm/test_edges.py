"""Every operator and stage on NULLs, empty and long texts, repeats, clashing columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import bpe_codec, decontaminate, language_id, passages, private_data, quality_model, quality_rules, simhash, stages, token_counts, url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 30_000 + "x" * 50_000
CLASHING = ["n_tokens", "score", "fp", "bench", "root", "spans", "ids", "id", "tid", "held_out", "features", "verdict", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "Some text here.", None), (3, "Same row.", "fr"), (3, "Same row.", "fr"), (4, LONG, "en"), (5, "12345 678", "de")]
    out = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return out.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1), (4, 0), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (None, "same row"), (2, ""), (3, "Same row"), (3, "Same row")], "item_id long, text string")


def operators(labels, bench):
    return {
        "token_counts": lambda d: token_counts.token_counts(d, VOCABULARY),
        "private_data": lambda d: private_data.find_private(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "quality_model": lambda d: quality_model.classify(d, labels),
        "quality_rules": lambda d: quality_rules.judge(d, labels),
        "bpe_codec": lambda d: bpe_codec.encode_decode(d, VOCABULARY),
        "language_id": lambda d: language_id.identify(d),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
    }


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_one_row_per_document(docs, labels, bench):
    got = {name: by_id(run(docs)) for name, run in operators(labels, bench).items()}
    for name, rows in got.items():
        assert {k: len(v) for k, v in rows.items()} == {None: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1}, name
        assert rows[3][0] == rows[3][1], name
    assert (got["token_counts"][1][0]["n_bytes"], got["token_counts"][1][0]["n_tokens"], got["token_counts"][4][0]["over_limit"]) == (0, 0, True)
    assert got["private_data"][1][0]["described"] == ""
    assert got["simhash"][1][0]["fingerprint"] == "0" * 16 and got["simhash"][2][0]["component_id"] == 1
    assert got["simhash"][None][0]["component_id"] is None
    assert got["quality_model"][1][0]["score"] == got["quality_model"][2][0]["score"] and got["quality_model"][None][0]["held_out"]
    assert got["quality_rules"][1][0]["base_failed"] and not got["quality_rules"][1][0]["kept"]
    assert got["bpe_codec"][2][0]["ids"] == [] and got["bpe_codec"][1][0]["decoded"] == ""
    assert got["language_id"][1][0]["lang_pred"] == "und" and got["language_id"][5][0]["lang_pred"] == "und"
    marks = got["decontaminate"]
    assert marks[1][0]["n_words"] == 0 and not marks[1][0]["contaminated"]
    assert marks[3][0]["items"] == ["3"] and marks[3][0]["n_hit"] == 2 and not marks[4][0]["contaminated"]


def test_empty_tables(docs, labels, bench):
    empty = docs.limit(0)
    for name, run in operators(labels.limit(0), bench.limit(0)).items():
        assert run(empty).count() == 0, name
        if name not in ("quality_rules", "language_id"):
            assert run(docs).count() == 7, name
    assert passages.shared_passages(empty).count() == 0


def test_passages_edges(docs):
    copies = by_id(passages.shared_passages(docs.unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(9).cast("long")))))
    assert set(copies) == {4, 9}
    for rows in copies.values():  # a copy of all words, and the periodic text's passages with its own first place
        whole = [r for r in rows if r["kind"] == "copy"]
        assert [(r["rep_id"], r["start"], r["end"]) for r in whole] == [(4, 0, 30_001)]
        assert all(r["rep_id"] == 4 and 0 <= r["start"] < r["end"] <= 30_000 and r["equal"] >= 40 for r in rows if r["kind"] != "copy")
    spans = [{(r["start"], r["end"], r["kind"]) for r in rows} for rows in copies.values()]
    assert spans[0] == spans[1]


def test_url_edges(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no scheme/org/"), (4, "http://ORG/x"), (5, "http://org"), (6, "ftp://a.b.example.org/es/?q#f"), (7, "x://y://z"), (None, "http://notorg/"), (8, "http://sub.example.org/en/1x"),
         (8, "http://sub.example.org/en/1x"), (9, "http://" + "a." * 3000 + "org/" + "p" * 50_000)],
        "page_id long, url string",
    ).withColumns({c: F.lit(1) for c in ["host", "path", "rule", "digest", "salt"]})
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("org", "/", "allow"), (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string",
    )
    got = {}
    for r in url_filter.filter_urls(pages, rules).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"][:8], r["rule"], r["verdict"]))
    assert got[1] == got[2] == got[3] == [("", "", None, "allow")]
    assert got[4] == [("org", "/x", "org/", "allow")] and got[5] == [("org", "", None, "allow")]
    assert got[6] == [("a.b.example.org", "/es/", "example.org/es/", "block")] and got[7] == [("y:", "//z", None, "allow")]
    assert got[None] == [("notorg", "/", None, "allow")] and got[8] == [("sub.example.org", "/en/1x", "example.org/en/1", "block")] * 2
    assert got[9][0][2] == "org/"
    assert url_filter.filter_urls(pages, rules.limit(0), default="block").where("verdict = 'block'").count() == 11
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_rows_of_one_id_and_fingerprint_keep_the_same_text(spark):
    rows = [(1, "one two three four."), (1, "One two three four."), (2, "else where goes this one")]
    kept = [
        {(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()}
        for order in (rows, rows[::-1])
    ]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_stages_keep_columns(spark, docs, tmp_path, labels, bench):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            assert out.count() <= frame.count()
        coded = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
        assert coded.count() == frame.count() and {"lang", "source", "fp", "score", "ids", "n_tokens"} <= set(coded.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.select("doc_id", "text"), str(tmp_path)).columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = stages.drop_copies(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: -1 if x is None else x) == [None, 1, 3, 4, 5]
    clean = stages.drop_contaminated(spark, docs, str(tmp_path))
    assert 3 not in {r["doc_id"] for r in clean.collect()} and clean.count() == 5
