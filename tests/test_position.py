"""Row at a global position: the narrowing search equals a brute-force sort."""

import pytest
from pyspark.sql import functions as F

from triageflow.operators import position as P
from triageflow.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def alerts(spark):
    return Q._alerts(spark, SF).cache()


@pytest.mark.parametrize("col", ["Id", "label", "AlertId", "Timestamp"])
def test_matches_brute_force(alerts, col):
    n = alerts.count()
    keyed = alerts.withColumn(P._ROW_KEY, P._tie_key(alerts, None))
    brute = [r.Id for r in keyed.orderBy(F.col(col).asc_nulls_first(), P._ROW_KEY).select("Id").collect()]
    for idx in [0, 49, 50, 333, 777, n - 1, n, -1]:
        got = [r.Id for r in P.row_at_position(alerts, idx, col, max_rank_rows=50, n_buckets=8)
               .select("Id").collect()]
        assert got == ([brute[idx]] if 0 <= idx < n else []), (col, idx)


def test_small_index_plan_is_bounded_top_k(alerts):
    plan = P.row_at_position(alerts, 7, "Id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_null_order_values_sort_first(alerts):
    df = alerts.withColumn("nk", F.when(F.col("Id") % 3 == 0, F.lit(None)).otherwise(F.col("AlertId")))
    n = df.count()
    keyed = df.withColumn(P._ROW_KEY, P._tie_key(df, None))
    brute = [r.Id for r in keyed.orderBy(F.col("nk").asc_nulls_first(), P._ROW_KEY).select("Id").collect()]
    for idx in [0, 60, 300, 600, n - 1]:
        got = [r.Id for r in P.row_at_position(df, idx, "nk", max_rank_rows=50, n_buckets=8).select("Id").collect()]
        assert got == [brute[idx]], idx
