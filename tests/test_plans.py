"""Physical-plan properties that matter at scale, checked on the real plans."""

import pytest

import __spark_entry__ as entry
from regressa.operators import encode
from regressa.plans.queries import LINEITEM_KEY
from tests.conftest import SF0001


def _plan(spark, df) -> str:
    df.createOrReplaceTempView("__plan_check")
    return spark.sql("EXPLAIN FORMATTED SELECT * FROM __plan_check").first()[0]


def test_split_is_a_narrow_projection(spark):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    plan = _plan(spark, encode.exact_split(li, LINEITEM_KEY, 0.2, 42, folds=5))
    assert "Exchange" not in plan and "Sort " not in plan


def test_validation_prunes_columns_and_aggregates_partially(spark):
    plan = _plan(spark, entry.queries()["validate_lineitem"](spark, SF0001))
    read = [line for line in plan.splitlines() if line.strip().startswith("ReadSchema")]
    assert read and all("l_orderkey" not in r and "l_shipdate" not in r for r in read)
    assert "partial_count" in plan


@pytest.mark.parametrize("name", [
    "table_summary_lineitem", "describe_lineitem", "missing_report_documents",
    "impute_lineitem", "ffill_events_by_user", "dedup_first_lineitem", "label_orders",
    "target_encode_orders", "ks_drift_events", "chisq_events", "mean_shift_events",
    "heteroscedasticity_lineitem", "batch_monitor_lineitem", "degradation_lineitem",
])
def test_no_cartesian_products(spark, name):
    plan = _plan(spark, entry.queries()[name](spark, SF0001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
