"""Delimited files of many layouts, cell by cell and in one pass."""

import random

from pyspark.sql import functions as F

from tallyframe.sources import csv_txn


def test_cells_of_a_line(spark):
    lines = {
        "a,b,c": ["a", "b", "c"], "a,b,": ["a", "b", ""], ",": ["", ""], "x": ["x"], ' a , "b, c" ,d\r': ["a", "b, c", "d"],
        '"say ""hi""",2': ['say "hi"', "2"], r'"say \"hi\"","C:\\d"': ['say "hi"', "C:\\d"], "\ufeffdate,amount": ["date", "amount"], 'a"b,c': ["b", "c"],
        "é,ü€,": ["é", "ü€", ""], "x" * 200_000 + ",y": ["x" * 200_000, "y"], '"' + "q," * 50_000 + '",z': ["q," * 50_000, "z"],
    }
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string").select("i", csv_txn.cells_of(F.col("value")).alias("c"))
    got = {r["i"]: r["c"] for r in df.collect()}
    want = list(lines.values())
    for i in range(len(want)):
        if i != 8:  # a quote inside a bare cell: only the number of cells is promised
            assert got[i] == want[i], i
    assert len(got[8]) == 2


def test_names_of_a_header(spark):
    heads = [("Date, Amount ,AMOUNT,,x_3,x,x",), ('"Tax Amount",a',)]
    got = [r[0] for r in spark.createDataFrame(heads, "h string").select(csv_txn.header_names(F.col("h"))).collect()]
    assert got == [["date", "amount", "amount_3", "column_4", "x_3", "x", "x_7"], ["tax amount", "a"]]


def test_five_thousand_layouts(spark):
    """Each file has an order, a case and extra columns of its own; no layout is a scan, and every cell is where its header says."""
    rng = random.Random(5)
    lines, want = [], {}
    for i in range(5000):
        names = ["Date", "AMOUNT", "description", "Currency", *[f"extra{k}" for k in range(i % 4)]]
        rng.shuffle(names)
        row = {"date": "2024-01-02", "amount": str(i), "description": f"file {i}, first", "currency": "USD" if i % 2 else ""}
        cell = lambda n: f'"{row[n.lower()]}"' if n.lower() in row and "," in row[n.lower()] else row.get(n.lower(), "e")
        lines += [(f"f{i}", 0, ",".join(names)), (f"f{i}", 1, ",".join(map(cell, names))), (f"f{i}", 2, "  "), (f"f{i}", 3, ",".join(map(cell, names)) + ",more")]
        want[f"f{i}"] = row
    df = spark.createDataFrame(lines, "filename string, block long, value string").repartition(8)
    out = csv_txn.by_header(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    rows = out.collect()
    assert len(rows) == 10_000 and sum(r["_malformed"] for r in rows) == 5000
    for r in rows:
        assert all(r[c] == v for c, v in want[r["filename"]].items()) and r["tax_amount"] is None and r["vendor"] is None
    typed = csv_txn.normalise(out, "2024-01-31")
    assert typed.where("currency = 'EUR'").count() == 5000 and typed.agg(F.sum("amount")).first()[0] == 2 * sum(range(5000))
    assert csv_txn.by_header(df.limit(0)).count() == 0
