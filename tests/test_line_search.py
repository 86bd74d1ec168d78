"""Line items in text: a search a form, its matches cut at their marks, the same values as by groups of the pattern."""

import random

from pyspark.sql import functions as F

from tallyframe.constants import ARABIC_DIGITS, PERSIAN_DIGITS
from tallyframe.functions.text import normalize_flat, normalize_lines
from tallyframe.operators import lines

PIECES = ["hot bolt", "x", "box 5x", "é", "12", "3", "4.50", "13,50", "0.5", "-", " - ", ":", ": ", "=", " = ", " x ", " ", "\n", "\t", ".", "٣", "۴٫۵", "٬", "Total"]


def texts():
    rng = random.Random(11)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    word, number, gap = (lambda: rng.choice(["bolt", "x1", "box 5x", "é y", "7 a"])), (lambda: rng.choice(["3", "12", "4.50", "13,5", "٣", "0.25"])), (lambda: rng.choice(["", " ", "  "]))
    for _ in range(600):
        marks = rng.choice([("  ", " ", " "), ("-", "-", "-"), (":", "x", "=")])
        item = word() + "".join(gap() + m + gap() + number() for m in marks)
        made.append(gap().join([item, rng.choice(PIECES), item[: rng.randrange(len(item))], rng.choice(PIECES), item]))
    return made + ["hot bolt 2 5.00 10.00", " a  b 2\n5,00 10 c - 2 - 3 - 6", "a 1 - 2 - 3 - 6 b x: 2 x 3 = 6 y: 4x2=8", "a-1-2-2-b-3-1-3", "", "12345 only", "a 2 3 6" + " b 1 1 1" * 30]


def by_groups(pattern):
    groups = [F.regexp_extract_all("_t", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*groups), lambda s: F.array(*[F.trim(s[f"g{g}"]) for g in (1, 2, 3, 4)]))


def test_cuts_as_groups(spark):
    flat = spark.createDataFrame([(t,) for t in texts()], "text string").select(normalize_flat(F.col("text")).alias("_t")).localCheckpoint()
    for pattern, hint, cut in zip(lines.LINE_FORMS, lines.LINE_HINTS, lines.CUTS):
        found = F.when(F.col("_t").rlike(hint), F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        parts = F.transform(F.transform(found, cut), lambda m: F.transform(m, lambda p: F.trim(p)))
        rows = flat.select("_t", by_groups(pattern).alias("want"), parts.alias("got")).collect()
        assert [r for r in rows if r.want != r.got] == [] and sum(len(r.want) > 0 for r in rows) >= 3


def test_texts_without_other_marks_are_left_as_they_are(spark):
    rows = spark.createDataFrame([(t,) for t in texts()] + [(None,)], "text string")
    whole = F.translate(F.coalesce("text", F.lit("")), ARABIC_DIGITS + PERSIAN_DIGITS + "٫", "0123456789" * 2 + ".")
    want = F.trim(F.regexp_replace(F.replace(F.regexp_replace(whole, r"(\d+)\s*,\s*(\d+)", "$1.$2"), F.lit(","), F.lit("")), r"\s+", " "))
    assert rows.where(~want.eqNullSafe(normalize_flat(F.col("text")))).count() == 0
    line = F.translate(F.coalesce("text", F.lit("")), ARABIC_DIGITS + PERSIAN_DIGITS + "٬،٫", "0123456789" * 2 + ",,.")
    for pattern, put in ((r"[^\S\n]+", " "), (r" ([.,:;!?])", "$1"), (r"([.,:;!?]) ?([.,:;!?])", "$1$2")):
        line = F.regexp_replace(line, pattern, put)
    assert rows.where(~line.eqNullSafe(normalize_lines(F.col("text")))).count() == 0


def test_each_form_is_searched_once(spark):
    plan = lines.lines_in_text(spark.createDataFrame([("d", "a 1 2 2")], "doc_id string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4  # three forms, and the large amounts of a text without lines
