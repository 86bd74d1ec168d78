"""Evidence of a value through patching and export, and the batch file's columns."""

from decimal import Decimal as D

from tallyframe.operators import invoice_rules
from tallyframe.sources import sinks

HEAD = f"invoice_id string, method string, reviewed boolean, field_confidence map<string, double>, evidence {invoice_rules.EVIDENCE}, invoice_number string, invoice_date date, vendor_name string, grand_total decimal(18,2), currency string, subtotal decimal(18,2)"
LINES = f"invoice_id string, line_no int, quantity int, unit_price decimal(18,2), category string, category_confidence double, evidence {invoice_rules.EVIDENCE}"


def test_patched_fields_take_the_page_of_the_citation(spark):
    box = (0, [1, 2, 3, 4])
    heads = spark.createDataFrame([
        ("1", "ocr", False, {"grand_total": 0.9}, {"grand_total": box, "currency": box}, "N1", None, 'V "q", x', D("10.00"), "XXX", None),
        ("2", "ocr", True, None, None, "N2", None, None, D("20.00"), "EUR", D("1.00")),
    ], HEAD)
    patch = lambda i, seq, path, value, cites: (i, seq, "replace", path, value, "a reason of some length", cites)
    patches = spark.createDataFrame([
        patch("1", 1, "/amounts/grand_total", "11.50", ["p3#l2"]), patch("1", 2, "/amounts/grand_total", "12.50", ["p4#l9", "p1#l1"]),
        patch("2", 1, "/amounts/currency", "USD", ["p0#l0"]), patch("2", 2, "/amounts/subtotal", "unreadable", ["p7#l0"]),
    ], "invoice_id string, seq int, op string, path string, value string, rationale string, cites array<string>")
    patched = invoice_rules.apply_patches(heads, patches)
    got = {r["invoice_id"]: r for r in patched.collect()}
    as_pairs = lambda e: {k: (v["page"], v["bbox"]) for k, v in e.items()}
    assert got["1"]["grand_total"] == D("12.50") and as_pairs(got["1"]["evidence"]) == {"currency": box, "grand_total": (4, None)}
    assert got["2"]["currency"] == "USD" and got["2"]["subtotal"] == D("1.00") and as_pairs(got["2"]["evidence"]) == {"currency": (0, None)}
    lines = spark.createDataFrame([("1", 1, 2, D("5.00"), "Office", 0.4, {"quantity": (1, [5, 6, 7, 8])})], LINES)
    rows = invoice_rules.export_long(patched, lines, carry=sinks.BATCH_KEYS)
    by_field = {(r["invoice_id"], r["field_name"]): r for r in rows.collect()}
    total = by_field["1", "grand_total"]
    assert (total["field_value"], total["confidence"], total["evidence_page"], total["evidence_bbox"]) == ("12.50", 0.9, 4, None)
    assert by_field["1", "currency"]["evidence_bbox"] == "[1, 2, 3, 4]" and by_field["1", "vendor_name"]["evidence_page"] is None
    assert by_field["1", "line_item_1_quantity"]["evidence_bbox"] == "[5, 6, 7, 8]" and by_field["1", "line_item_1_category"]["method"] == "ml_classification"
    assert ("1", "subtotal") not in by_field and by_field["2", "subtotal"]["field_value"] == "1.00"
    assert all(r["grand_total"] == D("12.50") and r["vendor_name"] == 'V "q", x' for (i, _), r in by_field.items() if i == "1")
    assert sinks.batch_rows(rows).columns == [c.split()[0] for c in sinks.BATCH_SCHEMA.split(", ")]


def test_export_without_evidence(spark):
    heads = spark.createDataFrame([("1", "ocr", False, "N1", D("1.00"))], "invoice_id string, method string, reviewed boolean, invoice_number string, grand_total decimal(18,2)")
    lines = spark.createDataFrame([], "invoice_id string, line_no int, quantity int, category string, category_confidence double")
    rows = invoice_rules.export_long(heads, lines).collect()
    assert {(r["field_name"], r["confidence"], r["evidence_page"], r["evidence_bbox"]) for r in rows} == {("invoice_number", 0.0, None, None), ("grand_total", 0.0, None, None)}
