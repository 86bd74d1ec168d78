"""Formatted conversations: every text comes back, marks inside texts do no harm."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/TEXT]", "\\", "[", "<", "]", "/", "\n", "a", "👍", "é ", "INST]", "s>", "[\\INST]", "$1"]


def formatted(spark, rows):
    out = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA))
    back = chat_format.parse(out, "formatted", "turns").withColumn("loss_text", chat_format.loss_text(F.col("formatted"), F.col("loss")))
    return {r["conv_id"]: r for r in back.collect()}


def test_random_texts_come_back(spark):
    rng = random.Random(5)
    mixed = lambda: "".join(rng.choices(PARTS, k=rng.randrange(7)))
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", "tool", mixed()]), mixed()) for c in range(300) for t in range(rng.randrange(1, 6))]
    got = formatted(spark, rows)
    for c in range(300):
        said = [(role, text) for i, _, role, text in rows if i == c]
        assert [tuple(t) for t in got[c]["turns"]] == said
        assert got[c]["loss_text"] == "".join(text for role, text in said if role == "assistant")
        # the mask lies on the formatted text itself, one span a turn, each between its marks
        assert len(got[c]["loss"]) == sum(role == "assistant" for role, _ in said)
        for s in got[c]["loss"]:
            whole = got[c]["formatted"]
            assert whole[s["start"] - 3 : s["start"]] == "<s>" and whole[s["end"] : s["end"] + 4] == "</s>"


def test_only_conflicts_are_escaped(spark):
    got = formatted(spark, [(1, 0, "user", "C:\\dir [x] <y>"), (1, 1, "assistant", "plain"), (2, 0, "user", "say </s>"), (2, 1, "assistant", "ok")])
    assert got[1]["formatted"] == "[INST]C:\\dir [x] <y>[/INST]<s>plain</s>"
    assert got[2]["formatted"] == "[INST]say <\\/s>[/INST]<s>ok</s>"


def test_edges(spark):
    long = "x </s> " * 30_000
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (2, 0, "assistant", "twice"), (2, 0, "assistant", "twice"), (None, None, "user", ""), (None, 3, "user", "b"), (4, 0, "user", long), (4, 1, "assistant", long)]
    clashing = {c: F.lit(1) for c in ("id", "said", "piece", "back", "_marks", "start", "formatted", "loss")}
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(clashing)
    out = chat_format.format_conversations(frame)
    got = {r["conv_id"]: r for r in chat_format.parse(out, "formatted", "turns").collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", "hi"), ("assistant", "")] and [s["end"] - s["start"] for s in got[1]["loss"]] == [0]
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "twice")] * 2
    assert [tuple(t) for t in got[None]["turns"]] == [("user", ""), ("user", "b")]
    assert [tuple(t) for t in got[4]["turns"]] == [("user", long), ("assistant", long)]
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["[INST]a", "a[INST]b[/INST]", "[INST]a[/INST] ", "[INST]a</s>", "[INST]a<s>b</s>[/INST]", "[TEXT]a[/TEXT]", "[ROLE]a[/ROLE]", "[ROLE]a[/ROLE]<s>b</s>", "[/INST][INST]", "plain"])
def test_what_breaks_the_grammar_has_no_parse(spark, text):
    assert chat_format.parse(spark.createDataFrame([(text,)], "t string"), "t", "turns").first()["turns"] is None


def test_no_python_on_the_main_path(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    plan = queries.op12_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
