"""Whitening against numpy's eigenvectors, and on rows without rank."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import queries, whitening


def table_of(spark, vectors, kind="array<double>"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], f"vec_id long, embedding {kind}")


def checked(spark, x, components, at=1e-9):
    out, model = whitening.whiten(table_of(spark, x), components)
    got = np.array([r["whitened"] for r in out.orderBy("vec_id").collect()])
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(values)[::-1]
    rank = min(components, int((values > values.max() * 1e-10).sum()))
    want = (c @ vectors[:, order] / np.sqrt(np.abs(values[order])))[:, :rank]
    assert got.shape[1] == min(components, len(model.values)) == rank
    assert np.abs(np.abs(got) - np.abs(want)).max() < at * np.abs(want).max()
    assert abs(model.total - values.sum()) < 1e-9 * values.sum()
    assert whitening.identity_error(out, "whitened") < 1e-8
    return model


def test_like_eigenvectors(spark):
    rng = np.random.default_rng(3)
    checked(spark, rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)) + 50, 5)


def test_far_from_the_origin_and_badly_scaled(spark):
    rng = np.random.default_rng(4)
    model = checked(spark, rng.normal(size=(800, 6)) * np.array([1e4, 1e2, 1, 1e-1, 1e-2, 1e-3]) + 1e5, 3)
    assert len(model.values) == 6


def test_without_full_rank(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 7))
    assert len(checked(spark, x, 7, 1e-6).values) == 3
    few = rng.normal(size=(4, 7))
    assert len(checked(spark, few, 7, 1e-6).values) == 3


def test_edges(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [4.0, 4.0], [4.0, 4.0]]
    rows = table_of(spark, [*good, None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [], [1.0]])
    clashing = rows.withColumns({c: F.lit(1) for c in ("id", "vec", "whitened", "n", "d", "cell", "value")})
    out, model = whitening.whiten(clashing, 8)
    assert sorted(r["vec_id"] for r in out.collect()) == [0, 1, 2, 3] and model.n == 4 and len(model.values) == 2
    twice = sorted(tuple(r["whitened"]) for r in out.where("vec_id >= 2").collect())
    assert twice[0] == twice[1]
    same, none = whitening.whiten(table_of(spark, [[3.0, 3.0]] * 5), 8)
    assert len(none.values) == 0 and [r["whitened"] for r in same.collect()] == [[]] * 5
    empty, model = whitening.whiten(rows.limit(0), 8)
    assert model is None and empty.count() == 0


@pytest.mark.parametrize("scale", [1.0, 100.0])
def test_query(spark, tmp_path, scale):
    rng = np.random.default_rng(6)
    vectors = [list(v) for v in (rng.normal(size=(200, 9)) * scale).astype(np.float32)]
    table_of(spark, [*vectors, None, [float("nan")] * 9], "array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_embedding_whitening(spark, str(tmp_path)).collect()
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    off = 200 * x - x.sum(axis=0)
    assert len(got) == 200 * 8 and {r["n"] for r in got} == {200}
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(enumerate(int((row.astype(object) ** 2).sum()) for row in off))
    values = np.linalg.eigvalsh((off / 200).T @ (off / 200) / 200)[::-1]
    assert all(abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9 for r in got)
    assert max(r["identity_error"] for r in got) < 1e-8
