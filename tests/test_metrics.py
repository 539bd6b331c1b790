"""Metric semantics: the published confusion-matrix golden and identities."""

import pytest
from pyspark.sql import functions as F

from triageflow.constants import LABELS
from triageflow.operators import metrics as M

# Published confusion matrix of the fine-tuned model (rows true, cols predicted,
# label order Benign, False, True) and its report values.
GOLDEN_MATRIX = [[76, 24, 0], [38, 61, 1], [30, 62, 8]]


def _cells(spark, matrix, model="m", extra=()):
    rows = [(model, t, p, n) for i, t in enumerate(LABELS) for j, p in enumerate(LABELS)
            for n in [matrix[i][j]] if n] + list(extra)
    return spark.createDataFrame(rows, "model string, true_label string, pred_label string, n long")


def test_golden_report(spark):
    cells = _cells(spark, GOLDEN_MATRIX)
    s = M.model_summary(cells).collect()[0]
    assert s.accuracy == pytest.approx(145 / 300)
    assert round(s.accuracy, 4) == 0.4833
    assert round(s.macro_precision, 4) == 0.6105
    assert round(s.macro_f1, 4) == 0.4212
    pc = {r.label: r for r in M.per_class(cells).collect()}
    assert [round(pc[x].precision, 4) for x in LABELS] == [0.5278, 0.4150, 0.8889]
    assert [round(pc[x].f1, 4) for x in LABELS] == [0.6230, 0.4939, 0.1468]
    assert [pc[x].support for x in LABELS] == [100, 100, 100]
    # balanced classes: weighted == macro, accuracy == macro recall
    assert s.weighted_f1 == pytest.approx(s.macro_f1)
    assert s.accuracy == pytest.approx(s.macro_recall)


def test_report_rows_and_accuracy_row(spark):
    rep = {r.row_name: r for r in M.classification_report(_cells(spark, GOLDEN_MATRIX)).collect()}
    assert set(rep) == set(LABELS) | {"accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].precision is None and rep["accuracy"].f1 == pytest.approx(145 / 300)
    assert rep["accuracy"].support == 300


def test_out_of_list_predictions(spark):
    # 10 invalid predictions of true TruePositive: lower its recall, no precision change
    extra = [("m", "TruePositive", "INVALID_LABEL", 10)]
    cells = _cells(spark, GOLDEN_MATRIX, extra=extra)
    pc = {r.label: r for r in M.per_class(cells).collect()}
    assert pc["TruePositive"].support == 110
    assert pc["TruePositive"].precision == pytest.approx(8 / 9)
    rep = {r.row_name: r for r in M.classification_report(cells).collect()}
    assert "micro avg" in rep and "accuracy" not in rep
    assert rep["micro avg"].precision == pytest.approx(145 / 300)
    assert rep["micro avg"].recall == pytest.approx(145 / 310)
    s = M.model_summary(cells).collect()[0]
    assert s.accuracy == pytest.approx(145 / 310)


def test_zero_division_and_missing_label(spark):
    # no BenignPositive anywhere: its P/R/F1 are 0 and it still counts in the macro mean
    cells = spark.createDataFrame([("m", "TruePositive", "TruePositive", 5), ("m", "FalsePositive", "TruePositive", 5)],
                                  "model string, true_label string, pred_label string, n long")
    pc = {r.label: r for r in M.per_class(cells).collect()}
    assert pc["BenignPositive"].precision == 0.0 and pc["BenignPositive"].f1 == 0.0
    s = M.model_summary(cells).collect()[0]
    assert s.macro_recall == pytest.approx((0 + 0 + 1) / 3)


def test_confusion_long_and_wide(spark):
    cells = _cells(spark, GOLDEN_MATRIX, extra=[("m", "TruePositive", None, 3)])
    long_m = M.confusion_matrix_long(cells).collect()
    assert len(long_m) == 9 and sum(r.n for r in long_m) == 300
    wide = {r.true_label: r for r in M.confusion_matrix_wide(cells).collect()}
    assert [wide["FalsePositive"][x] for x in LABELS] == [38, 61, 1]


def test_multi_model_comparison(spark):
    a = _cells(spark, GOLDEN_MATRIX, "a")
    b = _cells(spark, [[100, 0, 0], [0, 100, 0], [0, 0, 100]], "b")
    comp = {r.model: r for r in M.model_comparison(a.unionByName(b), {"a": "role a"}).collect()}
    assert comp["a"].accuracy == 0.4833 and comp["a"].role == "role a"
    assert comp["b"].macro_f1 == 1.0 and comp["b"].role is None


def test_validity_summary(spark):
    df = spark.createDataFrame([("TruePositive", "TruePositive"), ("FalsePositive", "INVALID_LABEL"),
                                ("BenignPositive", "FalsePositive"), ("TruePositive", None)], "t string, p string")
    v = M.validity_summary(df, "t", "p").collect()[0]
    assert (v.total, v.valid, v.invalid) == (4, 2, 2)
    assert v.strict_accuracy == 0.25 and v.valid_accuracy == 0.5


def test_melt_reads_all_models(spark):
    df = spark.createDataFrame([("TruePositive", "TruePositive", "FalsePositive")], "t string, a string, b string")
    long_df = M.melt_predictions(df, "t", {"A": "a", "B": "b"})
    got = sorted((r.model, r.pred_label) for r in long_df.collect())
    assert got == [("A", "TruePositive"), ("B", "FalsePositive")]


def test_label_distribution_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "l string")
    got = [(r.l, r["count"], r["rank"]) for r in M.label_distribution(df, "l").orderBy("rank").collect()]
    assert got == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3)]
    with pytest.raises(ValueError):
        M.distinct_values(spark.range(20).withColumn("id", F.col("id").cast("string")), "id", max_values=5)


def test_per_operator_queries_consistent(spark, queries):
    """Strict accuracy, per-class metrics, the fixed-list matrix and the report of
    the four-model comparison agree with each other (sf0.001)."""
    sf = "/root/testdata/sf0.001"
    acc = {r.model: r for r in queries["accuracy_strict"](spark, sf).collect()}
    assert len(acc) == 4 and all(r.n_rows == 1470 for r in acc.values())
    cm = queries["confusion_matrix"](spark, sf).collect()
    assert len(cm) == 4 * 9
    for model, a in acc.items():
        diag = sum(r.n for r in cm if r.model == model and r.true_label == r.pred_label)
        assert diag == a.n_correct
    pc = queries["model_metrics"](spark, sf).collect()
    for model in acc:
        rows = [r for r in pc if r.model == model]
        assert [r.label for r in sorted(rows, key=lambda r: r.label_order)] == LABELS
        assert sum(r.tp for r in rows) == acc[model].n_correct
    rep = queries["class_report"](spark, sf).collect()
    rule = {r.row_name: r for r in rep if r.model == "Rule-Based Baseline"}
    assert rule["accuracy"].f1 == acc["Rule-Based Baseline"].accuracy


def test_preprocess_shape(spark, queries):
    r = queries["preprocess_alerts"](spark, "/root/testdata/sf0.001").collect()[0]
    assert r.labelled_rows == 1470 and r.raw_rows == r.labelled_rows + r.dropped_rows
