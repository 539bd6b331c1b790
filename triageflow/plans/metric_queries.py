"""SURVEY section-2 queries named after single operators: processed-table
shape (P5 A1), rule predictions on the test split (F3 F4), strict accuracy
(A4), mean latency (A7), fixed-list confusion matrix (A8), per-class metrics
(A10-A12) and the classification report (A13) over the four-model comparison.

All of them reuse the one-pass building blocks of ``queries``: the melted
``(model, true, pred)`` table is grouped once into confusion cells; every
metric below is a chain over those few cells.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from triageflow.operators import features as feat
from triageflow.operators import metrics as M
from triageflow.plans import jobs
from triageflow.plans import oracle as O
from triageflow.plans.queries import (COMPARISON_LONG_SQL, COMPARISON_PREDS_SQL, DIGITS, REPORT_SQL,
                                      _comparison_long, _hybrid, _llm_predictions,
                                      _rounded_report)
from triageflow.plans.registry import register
from triageflow.session import configure
from triageflow.sources import fixtures

COMPARISON_CTES = O.with_ctes(COMPARISON_PREDS_SQL, O.metric_ctes(COMPARISON_LONG_SQL))


def _after(cte: str, prefix: str) -> str:
    """The CTEs of ``cte`` that follow its shared ``prefix`` (to combine two chains)."""
    assert cte.startswith(prefix + ",\n")
    return cte[len(prefix) + 2:]


def _comparison_cells(spark, sf_dir):
    return M.confusion_cells(_comparison_long(spark, sf_dir))


# --- P5 / A1: shape before and after dropping unlabelled rows --------------
@register("preprocess_alerts", "P1 P3 P5 A1",
          sql=O.with_ctes(O.RAW_ALERTS_CTE) + """
SELECT count(*) AS raw_rows, count(IncidentGrade) AS labelled_rows,
  count(*) - count(IncidentGrade) AS dropped_rows FROM raw_alerts""")
def q_preprocess_alerts(spark, sf_dir):
    configure(spark)
    raw = fixtures.alert_grades(spark, sf_dir)
    # one global aggregate; only the columns behind the target are scanned
    return raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count("IncidentGrade").alias("labelled_rows")) \
              .select("raw_rows", "labelled_rows", (F.col("raw_rows") - F.col("labelled_rows")).alias("dropped_rows"))


# --- F3 / F4: rule-baseline predictions over the test split ----------------
@register("rule_predictions", "F3 F4 P4",
          sql=O.with_ctes(O.SPLIT_CTE) + f""",
test_scored AS (
  SELECT Id, label, {O.keyword_sum('lower(alert_text)', O.TRUE_POSITIVE_KEYWORDS)} AS tp_score,
    {O.keyword_sum('lower(alert_text)', O.FALSE_POSITIVE_KEYWORDS)} AS fp_score
  FROM split_alerts WHERE split = 'test')
SELECT Id, label, {O.RULE_PRED_SQL} AS predicted_label FROM test_scored""")
def q_rule_predictions(spark, sf_dir):
    test = jobs.stored_split(spark, sf_dir).where(F.col("split") == "test")
    return feat.score_rules(test, keep_scores=False).select("Id", "label", "predicted_label")


# --- A4: strict accuracy per model (invalid predictions count as wrong) ----
@register("accuracy_strict", "A4 O5",
          sql=COMPARISON_CTES + """
SELECT model, n_rows, n_correct, round(accuracy, 6) AS accuracy FROM summ""")
def q_accuracy_strict(spark, sf_dir):
    hit = F.coalesce(F.col(M.TRUE) == F.col(M.PRED), F.lit(False))
    acc = (_comparison_cells(spark, sf_dir).groupBy(M.MODEL)
           .agg(F.sum("n").alias("n_rows"), F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).alias("n_correct")))
    return acc.select(M.MODEL, F.col("n_rows").cast("long").alias("n_rows"),
                      F.col("n_correct").cast("long").alias("n_correct"),
                      F.round(F.col("n_correct") / F.col("n_rows"), DIGITS).alias("accuracy"))


# --- A7: mean latency over all rows, per answer source ---------------------
@register("latency_mean", "A7 L15 L18",
          sql=O.with_ctes(O.SCORED_CTE, _after(O.LLM_PRED_CTE, O.ALERTS_CTE), _after(O.HYBRID_CTE, O.SCORED_CTE)) + """
SELECT model, count(*) AS n_rows, round(avg(latency_seconds), 6) AS mean_latency_seconds FROM (
  SELECT 'Qwen Zero-Shot' AS model, coalesce(latency_seconds, 0.0) AS latency_seconds FROM llm_pred
  UNION ALL
  SELECT 'Hybrid ML + Qwen', coalesce(latency_seconds, 0.0) FROM hyb) GROUP BY model""")
def q_latency_mean(spark, sf_dir):
    zero = _llm_predictions(spark, sf_dir).select(F.lit("Qwen Zero-Shot").alias(M.MODEL), "latency_seconds")
    hyb = _hybrid(spark, sf_dir).select(F.lit("Hybrid ML + Qwen").alias(M.MODEL), "latency_seconds")
    both = zero.unionByName(hyb).withColumn("latency_seconds", F.coalesce("latency_seconds", F.lit(0.0)))
    # partial (map-side) avg per model: one tiny row per task and model
    return both.groupBy(M.MODEL).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.round(F.avg("latency_seconds"), DIGITS).alias("mean_latency_seconds"))


# --- A8: fixed-list confusion matrix of every compared model ---------------
@register("confusion_matrix", "A8 A9",
          sql=COMPARISON_CTES + """
SELECT m.model, t.label AS true_label, p.label AS pred_label,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n, t.label_order * 3 + p.label_order AS cell_order
FROM models m CROSS JOIN """ + O.labels_values().replace("lbl(", "t(") + " CROSS JOIN "
          + O.labels_values().replace("lbl(", "p(") + """
LEFT JOIN cells c ON c.model = m.model AND c.true_label = t.label AND c.pred_label = p.label""")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix_long(_comparison_cells(spark, sf_dir))


# --- A10 / A11 / A12: per-class metrics of every compared model ------------
@register("model_metrics", "A10 A11 A12",
          sql=COMPARISON_CTES + """
SELECT model, label, CAST(label_order AS INTEGER) AS label_order, tp, n_pred, support,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc""")
def q_model_metrics(spark, sf_dir):
    pc = M.per_class(_comparison_cells(spark, sf_dir))
    return pc.select(M.MODEL, "label", "label_order", "tp", "n_pred", "support",
                     *[F.round(c, DIGITS).alias(c) for c in ["precision", "recall", "f1"]])


# --- A13: classification report of every compared model --------------------
@register("class_report", "A10 A13", sql=COMPARISON_CTES + REPORT_SQL)
def q_class_report(spark, sf_dir):
    return _rounded_report(_comparison_cells(spark, sf_dir))
