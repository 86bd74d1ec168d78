"""Merging changes into a partitioned table: what is written, what stays, and that a replay changes nothing."""

import pathlib

import pytest

from tallyframe.sources import sinks

SCHEMA = "tenant string, month string, amount int"
KEYS = ["tenant", "month"]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(f"t{i % 5}", f"2024-{1 + i % 3:02}", i) for i in range(15)] + [(None, "2024-01", 90), ("t9", None, 91)]
    sinks.merge_rows(spark.createDataFrame(rows, SCHEMA), path, KEYS, ["month"])
    read = lambda: sorted((r["tenant"] or "", r["month"] or "", r["amount"]) for r in spark.read.schema(SCHEMA).parquet(path).collect())
    assert read() == sorted((t or "", m or "", a) for t, m, a in rows)
    before = files(path)
    changes = spark.createDataFrame([("t1", "2024-02", 1000), ("new", "2024-02", 1001), (None, "2024-01", 1002), ("t1", "2024-07", 1003)], SCHEMA)
    sinks.merge_rows(changes, path, KEYS, ["month"])
    changed = {("t1", "2024-02"), (None, "2024-01")}
    want = sorted((t or "", m or "", a) for t, m, a in [r for r in rows if r[:2] not in changed] + [tuple(r) for r in changes.collect()])
    assert read() == want
    after = files(path)
    stays = lambda names: {f: t for f, t in names.items() if "month=2024-03" in f or "__HIVE" in f}
    assert stays(before) and stays(before) == stays(after)
    assert not {f for f in before if "month=2024-02" in f} & set(after)
    sinks.merge_rows(changes, path, KEYS, ["month"])  # a replay
    assert read() == want
    sinks.merge_rows(changes.limit(0), path, KEYS, ["month"])
    assert read() == want
    with pytest.raises(ValueError):
        sinks.merge_rows(changes, path, ["tenant"], ["month"])
