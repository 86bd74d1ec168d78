"""Running totals over balanced ranges: ids that look alike, hot keys, ties and NULLs."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.operators import cash
from tallyframe.operators.running import position, running_total


def test_ids_of_one_prefix_spread_over_the_ranges(spark, monkeypatch):
    """40 equal characters in front: every one of eight ranges holds its share of the one key."""
    from tallyframe.operators import running

    seen = []
    monkeypatch.setattr(running, "staged", lambda df, name, keep=running.staged: seen.append(keep(df, name)) or seen[-1])
    ids = [f"{'same-prefix-' * 4}"[:40] + f"{i:06d}" for i in range(8000)]
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame([("t", i, 1) for i in ids], "k string, id string, v int").repartition(8)
    got = {r.id: r.run for r in running_total(rows, ["k"], ["id"], F.col("v"), "run", "bigint", ranges=8).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8


def test_keys_over_several_ranges_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 1, 2, 3]), i, rng.choice([None, Decimal("0.10"), Decimal("-3.07"), Decimal("9.99")])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, day int, id int, v decimal(18,2)").repartition(7)
    for ranges in (1, 2, 5, 40):
        got = {r.id: r.run for r in running_total(df, ["k"], ["day", "id"], F.col("v"), "run", ranges=ranges).collect()}
        want, sums = {}, {}
        for k, _, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            sums[k] = sums.get(k) if v is None else (sums.get(k) or 0) + v
            want[i] = sums[k]
        assert {i: (x or 0) for i, x in got.items()} == {i: (x or 0) for i, x in want.items()}, ranges


def test_ties_stay_in_one_range(spark):
    df = spark.createDataFrame([("t", "2024-01-01", "same", Decimal("2.00"))] * 300 + [("t", "2024-01-02", "x", Decimal("1.00"))], "tenant string, date string, txn_id string, amount decimal(18,2)")
    got = sorted(r.balance for r in cash.running_cash_rows(df, ranges=6).collect())
    assert got == [Decimal(2 * i) for i in range(1, 301)] + [Decimal(601)]


def test_only_offsets_are_broadcast(spark):
    """Two shuffles of rows (ranges, window) and no shuffled join of them."""
    df = spark.createDataFrame([("t", i, 1) for i in range(50)], "k string, id int, v int")
    plan = position(df, ["k"], ["id"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert position(df.limit(0), ["k"], ["id"], "pos").count() == 0
