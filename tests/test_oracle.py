"""Every registered query against its DuckDB twin (sf0.001), plus the entry smoke."""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import compare

SF = "/root/testdata/sf0.001"
ORACLE = sorted(E.oracle_sql())
SKIP_HEAVY = {"lr_predict", "lr_metrics", "stream_triage", "subset_baselines",
              "model_comparison_subset"}


def test_contract_shape():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 50


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].n_rows == 1470
    assert rows[0].accuracy == round(511 / 1470, 6)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name])[name]
    assert res.startswith("OK"), res


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLE) - SKIP_HEAVY))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0
