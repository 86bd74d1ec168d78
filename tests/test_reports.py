"""Every report against its SQL check on the small tables."""

import pathlib

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
PLANS, CHECKS = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_report_equals_check(spark, con, name):
    problem, _ = compare(PLANS[name](spark, SF_DIR), con, CHECKS[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(CHECKS)))
def test_report_without_check_runs(spark, name):
    assert PLANS[name](spark, SF_DIR).count() > 0


def test_category_model_bands(spark):
    """The full-size fit on a fixed split: accuracy in its band, labels known, confidences above chance of the classes."""
    accuracy = PLANS["dj_train_category"](spark, SF_DIR).first()["accuracy"]
    assert 0.6 <= accuracy <= 1.0
    rows = PLANS["dj_predict_category"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert {r["predicted"] for r in rows} <= {"q0", "q1"} and all(0.5 <= r["confidence"] <= 1 for r in rows)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
