"""Text, invoice, validation, learning and translation operators on small inline tables."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import amounts, hashing, text
from tallyframe.operators import confidence, fields, invoice_rules, learn, lines, tokens, translate, validate
from tallyframe.sources import csv_txn


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("100.50", "100.50"), ("1,000.50", "1000.50"), ("-50.25", "-50.25"), ("$100.50", "100.50"), ("€1,000.50", "1000.50"), ("12,34", "12.34"),
    ("invalid", None), ("", None), ("abc123", None),
])
def test_amount_text(spark, raw, want):
    assert one(spark, raw, amounts.amount_text) == (None if want is None else D(want))


@pytest.mark.parametrize("raw, want", [("Total: 1,234.5", "1234.5"), ("12,5", "12.5"), ("1,234", "1234"), ("x", None), ("1-2", None)])
def test_amount_mixed(spark, raw, want):
    assert one(spark, raw, amounts.amount_mixed) == (None if want is None else D(want))


def test_digits_and_spacing(spark):
    assert one(spark, "٠١٢٣  ۴٫۵", text.normalize_digits) == "0123 4.5"
    assert one(spark, "a , b . .", text.normalize_spacing) == "a, b.."
    assert one(spark, "1,234,567.50 and 3,5", text.normalize_numbers) == "1234567.50 and 3.5"


def test_garbled(spark):
    assert one(spark, "000060009!04" * 3 + "é" * 5, text.is_garbled_strict) is True
    assert one(spark, "Invoice total 12.50", text.is_garbled) is False
    assert one(spark, "فاتورة رقم ١٢", text.is_arabic) is True


def test_category_ties_take_the_first(spark):
    got = one(spark, "Office chair rent", text.gl_scores)
    assert (got.category, got.score) == ("office_supplies", 0.5)
    both = one(spark, "paper ورق", text.gl_scores)
    assert both.score == 1.0


@pytest.mark.parametrize("raw", ["Paper 2 3.50 7.00", "Paper - 2 - 3.50 - 7.00", "Paper: 2 x 3.50 = 7.00"])
def test_line_forms(spark, raw):
    row = lines.lines_in_text(spark.createDataFrame([("d", raw)], "doc_id string, text string")).first()
    assert (row.description, row.quantity, row.unit_price, row.total) == ("Paper", 2.0, 3.5, 7.0)


def test_a_long_text_without_marks_is_searched_whole(spark):
    body = "word " * 20000 + "Paper 2 3.50 7.00"
    row = lines.lines_in_text(spark.createDataFrame([("d", body)], "doc_id string, text string")).first()
    assert row.total == 7.0 and row.description.endswith("word Paper")


def test_fallback_lines(spark):
    docs = spark.createDataFrame([("d", "1,50 €162\nHosting plan $12.34")], "doc_id string, text string")
    got = {(r.form, r.description, r.quantity, r.unit_price) for r in lines.fallback_lines(docs).collect()}
    assert got == {("price_qty", "Transaction", 162.0, 1.5), ("named", "Hosting plan", 1.0, 12.34)}


def test_csv_files_with_either_header_case(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.csv").write_text("Date,Description,Amount,Currency,Category\n2023-01-01,Test 1,100.50,USD,Sales\n2023-01-02,,-50.25,,\n")
    rows = csv_txn.normalise(csv_txn.read_csv(spark, str(tmp_path / "a")), "2024-01-01").orderBy("date").collect()
    assert [(r.vendor, r.amount, r.currency, r.category, r.description) for r in rows] == [
        ("Unknown", D("100.50"), "USD", "Sales", "Test 1"), ("Unknown", D("-50.25"), "EUR", "General", "Transaction"),
    ]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f.csv").write_text("date,description,amount,taxamount\n2023-01-01,x,invalid,10.00\n")
    good, bad = csv_txn.quarantine(csv_txn.normalise(csv_txn.read_csv(spark, str(tmp_path / "b")), "2024-01-01"))
    assert good.count() == 0 and bad.first().tax_amount == D("10.00")


def test_document_without_lines_gets_one_row(spark):
    docs = spark.createDataFrame([("d", "Acme Trading House\nTotal: 99,50"), ("e", "Blue paper 12.00 each")], "doc_id string, text string")
    rows = {r.doc_id: r for r in csv_txn.pdf_transactions(docs).collect()}
    assert (rows["d"].vendor, rows["d"].amount, rows["d"].category) == ("Acme Trading House", D("99.50"), "Document")
    assert (rows["e"].amount, rows["e"].description) == (D("12.00"), "Blue paper  each")


def test_pages_and_boxes(spark):
    docs = spark.createDataFrame([("d", "a\n\nb --- PAGE BREAK ---\n c")], "doc_id string, text string")
    rows = tokens.tokenise(docs).orderBy("page", "line_no").collect()
    assert [(r.page, r.line_no, r.text, r.bbox) for r in rows] == [
        (0, 0, "a", [0.0, 0.0, 1000.0, 20.0]), (0, 2, "b", [0.0, 40.0, 1000.0, 60.0]), (1, 0, "c", [0.0, 0.0, 1000.0, 20.0]),
    ]


TOKEN = "doc_id string, page int, line_no int, text string, confidence double, bbox array<double>"


def random_tokens(spark, n=300, seed=3):
    rnd = random.Random(seed)
    words = ["Total: 12.50", "Total", "tax", "5.00", "plain", "date 2024-01-05", "Acme", "from", "INV-1", "invoice no"]
    rows = []
    for i in range(n):
        x, y = rnd.randrange(0, 900, 30), rnd.randrange(0, 1500, 30)
        rows.append(("d" if i % 3 else "e", i % 2, i, rnd.choice(words), rnd.choice([0.5, 0.9]), [float(x), float(y), x + 60.0, y + 20.0]))
    return rows, spark.createDataFrame(rows, TOKEN)


def test_nearest_value_matches_brute_force(spark):
    rows, df = random_tokens(spark)
    likes = {f: {r.line_no for r in df.where(fields.looks_like(F.col("text"), f)).collect()} for f in fields.FIELD_LABELS}
    got = {(r.field, r.line_no): (r.value_line, round(r.distance, 6)) for r in fields.labelled_pairs(df).collect()}
    want = {}
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    for f, words in fields.FIELD_LABELS.items():
        for doc, page, i, t, _, box in rows:
            if not any(w in t.lower() for w in words):
                continue
            near = []
            for doc2, page2, j, _, _, box2 in rows:
                (x1, y1), (x2, y2) = centre(box), centre(box2)
                gap = ((x1 - x2) ** 2 + (y1 - y2) ** 2) ** 0.5
                if (doc2, page2) == (doc, page) and gap < 200 and j in likes[f]:
                    near.append((gap, j))
            if near:
                gap, j = min(near)
                want[(f, i)] = (j, round(gap, 6))
    assert got == want


def test_context_matches_brute_force(spark):
    rows, df = random_tokens(spark, 200, seed=5)
    got = {r.line_no: r.context for r in tokens.context(df).collect()}
    for doc, page, i, _, _, box in rows:
        near = sorted((abs(b[1] - box[1]), j, t) for d2, p2, j, t, _, b in rows if (d2, p2) == (doc, page) and abs(b[1] - box[1]) < 40)
        assert got[i] == " ".join(t for _, _, t in near[:5])


def invoice(spark, **over):
    base = dict(
        invoice_id="1", grand_total=D("119.00"), subtotal=D("100.00"), tax_amount=D("19.00"), tax_rate=19.0, discount=None, shipping=None,
        invoice_date=date(2024, 1, 1), due_date=date(2024, 1, 31), invoice_date_text="2024-01-01", due_date_text="2024-01-31", currency="EUR", duplicate_hash="h",
    )
    base.update(over)
    schema = (
        "invoice_id string, grand_total decimal(18,2), subtotal decimal(18,2), tax_amount decimal(18,2), tax_rate double, discount decimal(18,2), "
        "shipping decimal(18,3), invoice_date date, due_date date, invoice_date_text string, due_date_text string, currency string, duplicate_hash string"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(base[n] for n in names)], schema)


def line_table(spark):
    return spark.createDataFrame([("1", 2.0, D("50.00"), D("19.00"))], "invoice_id string, quantity double, unit_price decimal(18,2), tax_amount decimal(18,2)")


@pytest.mark.parametrize("over, rules", [
    ({}, []),
    ({"grand_total": D("122.60")}, ["arithmetic_balance"]),
    ({"due_date": date(2023, 12, 1)}, ["date_logic"]),
    ({"currency": "XXX"}, ["currency_format"]),
    ({"currency": ""}, ["required_currency"]),
    ({"discount": D("-1.00")}, ["non_negative_amount"]),
    ({"tax_amount": D("25.00"), "grand_total": D("125.00")}, ["line_sum_tax", "tax_coherence"]),
    ({"shipping": D("0.125")}, ["rounding_policy"]),
    ({"duplicate_hash": None}, ["duplicate_hash"]),
    ({"invoice_date": None, "invoice_date_text": ""}, ["required_date"]),
    ({"invoice_date": None, "invoice_date_text": "soon"}, ["date_format"]),
    ({"subtotal": None}, ["arithmetic_balance"]),
])
def test_rules(spark, over, rules):
    checked = invoice_rules.failures(invoice(spark, **over), line_table(spark))
    assert sorted(f.rule for f in checked.first().failures) == sorted(rules)


def test_duplicate_window_is_180_days(spark):
    day = date(2024, 1, 1)
    rows = [("a", "x", day), ("b", "x", day + timedelta(days=179)), ("c", "x", day + timedelta(days=179 + 181)), ("d", "y", day), ("e", "y", day)]
    df = spark.createDataFrame(rows, "invoice_id string, duplicate_hash string, invoice_date date")
    got = {r.invoice_id for r in invoice_rules.duplicates(df).where("is_duplicate").collect()}
    assert got == {"b", "e"}


@pytest.mark.parametrize("totals, errors, fields_", [
    (("1000", "200", "800"), 0, []),
    (("1000", "500", "500"), 2, ["error:totalExpenses", "error:netCashflow"]),
    (("0", "200", "-200"), 2, ["error:totalIncome", "error:netCashflow"]),
])
def test_summary_validation(spark, totals, errors, fields_):
    t = spark.createDataFrame([("f", D("1000")), ("f", D("-200"))], "file_id string, amount decimal(18,2)")
    rep = spark.createDataFrame([("f", *[D(v) for v in totals])], "file_id string, total_income decimal(18,2), total_expenses decimal(18,2), net_cashflow decimal(18,2)")
    row = validate.validate_summary(rep, t, ["file_id"]).first()
    assert row.errors == errors and row.issues == fields_ and row.income == D("1000.00") and row.expenses == D("200.00")


def test_expense_only_warns(spark):
    t = spark.createDataFrame([("f", D("-200"))], "file_id string, amount decimal(18,2)")
    rep = spark.createDataFrame([("f", D("0"), D("200"), D("-200"))], "file_id string, total_income decimal(18,2), total_expenses decimal(18,2), net_cashflow decimal(18,2)")
    assert validate.validate_summary(rep, t, ["file_id"]).first().issues == ["warning:sustainability"]


def test_similarity_is_one_for_equal_results(spark):
    df = spark.createDataFrame([(1.0, 2.0, -1.0, 5, ["x"], 1.0, 2.0, -1.0, 5, ["x"])], "a_income double, a_expenses double, a_net double, a_n int, a_alerts array<string>, b_income double, b_expenses double, b_net double, b_n int, b_alerts array<string>")
    assert confidence.result_similarity(df).first().similarity == 1.0


def test_pattern_confidence_and_halves(spark):
    now = datetime(2024, 1, 31)
    rows = [(now - timedelta(days=d), "c", p, f"fix{d}") for d, p in ((40, "a"), (30, "b"), (29, "b"), (2, "z"), (1, "z"), (0, "z"))]
    pats = learn.correction_patterns(spark.createDataFrame(rows, "ts timestamp, category string, pattern_hash string, correction string"), "2024-01-31 00:00:00")
    got = {r.pattern_hash: (r.frequency, r.confidence, r.correction) for r in pats.collect()}
    assert got == {"a": (1, 0.5, "fix40"), "b": (2, 0.7, "fix29"), "z": (3, 1.0, "fix0")}
    m = learn.learning_metrics(pats).first()
    assert m.patterns == 3 and abs(m.improvement - (0.85 - 0.5)) < 1e-6


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_similar_records_match_brute_force(spark):
    rnd = random.Random(11)
    names = ["name", "type", "brand", "size", "flag", "memo"]
    rows = []
    for i in range(160):
        keys = names[: rnd.choice([2, 4, 5, 6])]
        rows.append((f"r{i:03d}", rnd.choice(["t1", "t2"]), datetime(2024, 1, 1) + timedelta(minutes=i), {k: rnd.choice(["red", "blue", "bluer", "x"]) for k in keys}))
    df = spark.createDataFrame(rows, "record_id string, task string, ts timestamp, fields map<string,string>")
    got = {r.record_id: (r.match_id, round(r.similarity, 5)) for r in learn.similar_records(df).collect()}
    want = {}
    for i, (rid, task, _, fa) in enumerate(rows):
        best = None
        for rid2, task2, _, fb in rows[:i]:
            if task2 != task:
                continue
            common, every = set(fa) & set(fb), set(fa) | set(fb)
            s = len(common) / len(every)
            for k in common:
                longer = max(len(fa[k]), len(fb[k]))
                s += 0.1 if fa[k] == fb[k] else 0.05 * ((longer - lev(fa[k], fb[k])) / longer)
            s = min(1.0, s)
            key = (-round(s, 6), set(fa) != set(fb), rid2)
            if s > 0.85 and (best is None or key < best):
                best = key
        if best:
            want[rid] = (best[2], round(-best[0], 5))
    assert got == want


def test_text_nodes(spark):
    html = "<div><p>Hello <b>big</b> world</p><script>var x='<p>no</p>'</script><style>p{}</style><p>  </p>A &amp; B<!-- c --></div>"
    assert one(spark, html, translate.text_nodes) == ["Hello", "big", "world", "A & B"]
    assert one(spark, "plain < text", text.is_html) is False


def test_translation_keys_and_expiry(spark):
    key = lambda t, lang: spark.range(1).select(hashing.translation_key(F.lit(t), F.lit(lang), F.lit("auto"))).first()[0]
    assert key("a", "ar") == key("a", "ar") != key("a", "en")
    now = datetime(2024, 1, 2)
    mem = spark.createDataFrame([(key("a", "ar"), "A", now - timedelta(hours=1), 7_200_000), (key("b", "ar"), "B", now - timedelta(hours=3), 7_200_000)], "key string, translation string, ts timestamp, ttl_ms long")
    req = spark.createDataFrame([("a",), ("b",), ("b",)], "text string").withColumns({"target": F.lit("ar"), "source": F.lit("auto")})
    looked = translate.lookup(req, mem, "2024-01-02 00:00:00")
    assert looked.where("from_cache").count() == 1
    assert [(r.text, r.uses) for r in translate.misses(looked).collect()] == [("b", 2)]


def test_csv_files_of_several_layouts(spark, tmp_path):
    """Cells follow each file's own header; lines with another number of cells are marked and quarantined."""
    (tmp_path / "a.csv").write_text("Date,Description,Amount\n2024-01-01,x,1.00\n")
    (tmp_path / "b.csv").write_text("\nAMOUNT,DATE,Category,Description\n2.00,2024-01-02,Food,\"y, z\"\n3.00,2024-01-03,Food,w,surplus\n")
    rows = csv_txn.normalise(csv_txn.read_csv(spark, str(tmp_path)), "2000-01-01")
    good, bad = csv_txn.quarantine(rows)
    assert sorted((r.description, r.amount, str(r.date), r.category) for r in good.collect()) == [
        ("x", D("1.00"), "2024-01-01", "General"), ("y, z", D("2.00"), "2024-01-02", "Food"),
    ]
    assert [r.reason for r in bad.collect()] == ["Malformed line"]
