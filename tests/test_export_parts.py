"""The batch export: written in parts, compressed, and lines that meet their header before they are exploded."""

import pathlib
from decimal import Decimal as D

from tallyframe.operators import invoice_rules
from tallyframe.sources import sinks

HEAD = "invoice_id string, method string, reviewed boolean, invoice_number string, invoice_date date, vendor_name string, grand_total decimal(18,2)"
LINES = f"invoice_id string, line_no int, quantity int, category string, category_confidence double, evidence {invoice_rules.EVIDENCE}"


def export(spark, n):
    heads = [(str(i), "ocr", i % 2 == 0, f"N{i}", None, f'V "{i}", x', D(i)) for i in range(n)] + [(None, "ocr", None, "none", None, None, None), ("1", "twice", True, "N1b", None, None, None)]
    lines = [(str(i % (n + 2)), i % 3, i, "Office" if i % 4 else None, 0.4, {"quantity": (1, [5, 6, 7, i])} if i % 5 else None) for i in range(3 * n)] + [(None, 1, 1, "Office", 0.4, None)]
    return invoice_rules.export_long(spark.createDataFrame(heads, HEAD), spark.createDataFrame(lines, LINES), carry=sinks.BATCH_KEYS)


def test_parts_hold_all_rows_and_are_compressed(spark, tmp_path):
    rows = sinks.batch_rows(export(spark, 40))
    path, key = str(tmp_path / "csv"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    for _ in range(2):  # a second write replaces the first
        sinks.write_csv_parts(rows, path, "job_id", parts=3)
    assert spark.conf.get(key, None) == before
    back = spark.read.schema(sinks.BATCH_SCHEMA).option("header", True).csv(path)
    as_rows = lambda df: sorted(map(repr, df.select(*[c.split()[0] for c in sinks.BATCH_SCHEMA.split(", ")]).collect()))
    assert as_rows(back) == as_rows(rows) and any(r.job_id is None for r in back.collect())
    files = [p for p in pathlib.Path(path).iterdir() if p.name.startswith("part-")]
    assert files and all(p.name.endswith(".csv.gz") for p in files)


def test_a_line_is_shuffled_once_and_not_once_a_field(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = export(spark, 4)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = plan.splitlines()
    join = next(i for i, line in enumerate(found) if "Join Inner" in line)
    assert any("Generate inline" in line and depth(line) < depth(found[join]) for line in found[:join])
    assert not any("Generate" in line for line in found[join:])
    assert not any("evidence" in line for line in found[join:] if "Join Inner" in line)


def test_rows_of_lines(spark):
    got = {(r.invoice_id, r.field_name, r.field_value, r.evidence_page, r.evidence_bbox, r.method, r.invoice_number) for r in export(spark, 5).where("field_name LIKE 'line%'").collect()}
    # line 13 is one of invoice 6, which has no header; line 8 of invoice 1, which has two
    assert ("1", "line_item_2_quantity", "8", 1, "[5, 6, 7, 8]", "ocr", "N1") in got and ("1", "line_item_2_quantity", "8", 1, "[5, 6, 7, 8]", "twice", "N1b") in got
    assert not any(i == "6" or i is None for i, *_ in got) and ("1", "line_item_2_category", None, None, None, "ml_classification", "N1") not in got
    assert ("2", "line_item_0_category", "Office", None, None, "ml_classification", "N2") in got
