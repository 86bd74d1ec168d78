"""The duplicate window that moves with each copy, in micro-batches; dated rates without a broadcast."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from tallyframe.operators import currency
from tallyframe.streaming import streams

SCHEMA = "duplicate_hash string, ts timestamp, invoice_id long"
DAY = timedelta(days=1)


def survivors(spark, tmp_path, batches):
    """Ids that stay, per micro-batch file."""
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
    stream = streams.source(spark, inbox, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    query = streams.dedup_invoices(stream).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == len(batches)
    return sorted(r.invoice_id for r in spark.read.schema(SCHEMA).parquet(out).collect())


def test_gaps_below_at_and_above_the_window(spark, tmp_path):
    t = datetime(2024, 1, 1)
    batches = [
        [("a", t, 1), ("b", t, 2), ("c", t, 3), ("d", t, 4), ("d", t, 5)],  # of one moment the smaller id
        [("a", t + 179 * DAY, 11), ("b", t + 180 * DAY, 12), ("c", t + 181 * DAY, 13)],
        [("a", t + 358 * DAY, 21)],  # 179 after a dropped copy: the window has moved
        [("a", t + 538 * DAY, 31), ("e", t + 530 * DAY, 32)],  # 180 after it
        [("e", t + 520 * DAY, 41), ("f", t + 538 * DAY, 42)],  # late, and its later copy has gone out
        [("f", t + 900 * DAY, 51)],
    ]
    assert survivors(spark, tmp_path, batches) == [1, 2, 3, 4, 12, 13, 31, 32, 42, 51]


def test_random_histories_match_a_plain_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((datetime(2020, 1, 1) + timedelta(hours=rng.randrange(24 * 1500)), i, rng.choice("abcdefgh")) for i in range(120))
    want, last = [], {}
    for ts, i, h in rows:
        if h not in last or ts - last[h] >= 180 * DAY:
            want.append(i)
        last[h] = ts
    batches = [[(h, ts, i) for ts, i, h in rows[k : k + 24]] for k in range(0, 120, 24)]
    assert survivors(spark, tmp_path, batches) == sorted(want) and 8 < len(want) < 120


def test_dated_rates_by_month(spark):
    rng = random.Random(5)
    start = date(2023, 1, 1)
    rates = [(c, start + timedelta(days=rng.randrange(500)), float(rng.randrange(50, 150)) / 100) for c in ("USD", "GBP", "EUR") for _ in range(12)]
    txns = [(i, rng.choice(["USD", "GBP", "EUR", "JPY", None]), start + timedelta(days=rng.randrange(-60, 900)), Decimal(rng.randrange(-900, 900))) for i in range(500)] + [(500, "USD", None, Decimal(5))]
    df = spark.createDataFrame(txns, "id int, currency string, date date, amount decimal(18,2)")
    dated = spark.createDataFrame(rates, "currency string, valid_from date, rate double")

    def rate_at(c, day):
        known = [(a, r) for k, a, r in rates if k == c and a <= day]
        top = max(known, default=None)
        return top and max(r for a, r in known if a == top[0])

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = currency.convert_as_of(df, dated, "GBP")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        got = {r.id: (r.was_converted, round(r.rate, 9)) for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "_month" in plan and "SortMergeJoin" in plan
    for i, c, day, amount in txns:
        if not amount:
            assert i not in got
            continue
        c = c or "EUR"
        fr, to = (rate_at(c, day), rate_at("GBP", day)) if day else (None, None)
        ok = c != "GBP" and fr is not None and to is not None
        assert got[i] == (ok, round(to / fr, 9) if ok else 1.0), (i, c, day)
    none = currency.convert_as_of(df, dated.limit(0), "GBP")
    assert none.where("was_converted").count() == 0 and none.count() == sum(1 for t in txns if t[3])
