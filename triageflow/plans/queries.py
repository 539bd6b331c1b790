"""Registered queries, one per SURVEY section-2 operator group.

Every query reads whole driver tables (or data Spark derives from them).
Floating metrics are rounded to 6 digits on both sides so the oracle hash is
stable against summation order; counts stay exact.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triageflow.constants import LABELS
from triageflow.operators import features as feat
from triageflow.operators import metrics as M
from triageflow.plans import oracle as O
from triageflow.plans.registry import register
from triageflow.session import configure
from triageflow.sources import fixtures

DIGITS = 6
SUMMARY_COLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1",
                "weighted_precision", "weighted_recall", "weighted_f1"]


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return feat.preprocess_alerts(fixtures.raw_alerts(spark, sf_dir))


def _first_alerts(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Processed alerts restricted to the ``n`` lowest labelled ids, cut before
    the joins: enough for any ordered top-``n`` by ``Id`` (previews, cards)."""
    configure(spark)
    return feat.preprocess_alerts(fixtures.raw_alerts(spark, sf_dir, first_n=n, labelled_only=True))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(Id, label)`` of the labelled alerts, without the joins behind their text."""
    configure(spark)
    g = fixtures.alert_grades(spark, sf_dir).withColumnRenamed("IncidentGrade", "label")
    return g.where(F.col("label").isNotNull())


def _rounded_summary(cells: DataFrame) -> DataFrame:
    s = M.model_summary(cells)
    return s.select("model", *[F.round(c, DIGITS).alias(c) for c in SUMMARY_COLS], "n_rows")


def _rule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = feat.score_rules(_alerts(spark, sf_dir), keep_scores=False)
    return M.confusion_cells(M.long_predictions(scored, "label", "predicted_label", "Rule-Based Baseline"))


RULE_PREDS_SQL = "SELECT 'Rule-Based Baseline' AS model, label AS true_label, predicted_label AS pred_label FROM scored"


# --- F1 / P1 / P3 / P5: processed alerts -----------------------------------
@register("alert_text", "S2 P1 P3 P4 P5 F1",
          sql=O.with_ctes(O.ALERTS_CTE) + "SELECT Id, IncidentId, AlertId, Timestamp, alert_text, label FROM alerts")
def q_alert_text(spark, sf_dir):
    return _alerts(spark, sf_dir)


# --- F2 / F3: keyword scores and rule decision ------------------------------
@register("rule_scores", "F2 F3",
          sql=O.with_ctes(O.SCORED_CTE)
          + "SELECT Id, label, tp_score, benign_score, fp_score, predicted_label FROM scored")
def q_rule_scores(spark, sf_dir):
    return feat.score_rules(_alerts(spark, sf_dir)).select(
        "Id", "label", "tp_score", "benign_score", "fp_score", "predicted_label")


# --- Minimum slice: rule baseline accuracy / macro / weighted
@register("rule_metrics", "F4 A4 A10 A11 A12 A14",
          sql=O.with_ctes(O.SCORED_CTE, O.metric_ctes(RULE_PREDS_SQL)) + O.summary_select(DIGITS))
def q_rule_metrics(spark, sf_dir):
    return _rounded_summary(_rule_cells(spark, sf_dir))


# --- A8: confusion matrix, fixed label list, zero cells present -------------
@register("rule_confusion", "A8",
          sql=O.with_ctes(O.SCORED_CTE, O.metric_ctes(RULE_PREDS_SQL)) + """
SELECT m.model, t.label AS true_label, p.label AS pred_label,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n, t.label_order * 3 + p.label_order AS cell_order
FROM models m CROSS JOIN """ + O.labels_values() .replace("lbl(", "t(") + " CROSS JOIN " +
          O.labels_values().replace("lbl(", "p(") + """
LEFT JOIN cells c ON c.model = m.model AND c.true_label = t.label AND c.pred_label = p.label""")
def q_rule_confusion(spark, sf_dir):
    return M.confusion_matrix_long(_rule_cells(spark, sf_dir))


# --- A10 / A13: classification report ---------------------------------------
REPORT_SQL = """
SELECT model, label_order AS row_order, label AS row_name, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc
UNION ALL
SELECT model, 3, CASE WHEN n_out_of_list = 0 THEN 'accuracy' ELSE 'micro avg' END,
  CASE WHEN n_out_of_list = 0 THEN NULL ELSE round(CASE WHEN s_pred > 0 THEN CAST(s_tp AS DOUBLE) / s_pred ELSE 0.0 END, 6) END,
  CASE WHEN n_out_of_list = 0 THEN NULL ELSE round(CASE WHEN s_sup > 0 THEN s_tp / s_sup ELSE 0.0 END, 6) END,
  round(CASE WHEN n_out_of_list = 0 THEN (CASE WHEN n_rows > 0 THEN CAST(n_correct AS DOUBLE) / n_rows ELSE 0.0 END)
    ELSE (CASE WHEN s_pred + s_sup > 0 THEN 2.0 * s_tp / (s_pred + s_sup) ELSE 0.0 END) END, 6),
  CASE WHEN n_out_of_list = 0 THEN n_rows ELSE CAST(s_sup AS BIGINT) END
FROM summ
UNION ALL
SELECT model, 4, 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), CAST(s_sup AS BIGINT) FROM summ
UNION ALL
SELECT model, 5, 'weighted avg', round(weighted_precision, 6), round(weighted_recall, 6), round(weighted_f1, 6),
  CAST(s_sup AS BIGINT) FROM summ"""


def _rounded_report(cells: DataFrame) -> DataFrame:
    r = M.classification_report(cells)
    return r.select("model", "row_order", "row_name", *[F.round(c, DIGITS).alias(c) for c in
                                                        ["precision", "recall", "f1"]],
                    F.col("support").cast("long").alias("support"))


@register("rule_report", "A10 A13", sql=O.with_ctes(O.SCORED_CTE, O.metric_ctes(RULE_PREDS_SQL)) + REPORT_SQL)
def q_rule_report(spark, sf_dir):
    return _rounded_report(_rule_cells(spark, sf_dir))


# --- A2: value counts --------------------------------------------------------
@register("label_distribution", "A2",
          sql=O.with_ctes(O.ALERTS_CTE) + """
SELECT label, count, CAST(row_number() OVER (ORDER BY count DESC, label) AS INTEGER) AS rank
FROM (SELECT label, count(*) AS count FROM alerts WHERE label IS NOT NULL GROUP BY label)""")
def q_label_distribution(spark, sf_dir):
    return M.label_distribution(_labels(spark, sf_dir), "label")


# --- A3 / O4: sorted distinct -------------------------------------------------
@register("label_domain", "A3 O4",
          sql=O.with_ctes(O.ALERTS_CTE) + """
SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS label_order
FROM (SELECT DISTINCT label FROM alerts WHERE label IS NOT NULL)""")
def q_label_domain(spark, sf_dir):
    from pyspark.sql import Window
    d = _labels(spark, sf_dir).select("label").distinct()
    return d.withColumn("label_order", F.row_number().over(Window.orderBy("label")))


# --- T1: stratified 80/20 split ---------------------------------------------
from triageflow.plans import jobs  # noqa: E402


@register("stratified_split", "T1",
          sql=O.with_ctes(O.SPLIT_CTE) + "SELECT Id, label, split FROM split_alerts")
def q_stratified_split(spark, sf_dir):
    # Processed alerts are written once, the sampler reads them twice
    # (histogram, then selection) and the split corpus is written for reuse.
    return jobs.stored_split(spark, sf_dir).select("Id", "label", "split")


# --- T3 / P7 / O5: balanced evaluation subset over the test split ----------
@register("balanced_subset", "T3 P7 O5",
          sql=O.with_ctes(O.EVAL_CTE)
          + "SELECT Id, IncidentId, AlertId, Timestamp, alert_text, label FROM eval_subset")
def q_balanced_subset(spark, sf_dir):
    return jobs.eval_subset(jobs.stored_split(spark, sf_dir)).select(
        "Id", "IncidentId", "AlertId", "Timestamp", "alert_text", "label")


# --- T4: seeded shuffle order (sort key carried explicitly) ----------------
@register("shuffled_order", "T4 T5",
          sql=O.with_ctes(O.EVAL_CTE) + "SELECT Id, shuffle_key FROM eval_subset")
def q_shuffled_order(spark, sf_dir):
    return jobs.eval_subset(jobs.stored_split(spark, sf_dir)).select("Id", "shuffle_key")


# --- J1: leakage-free training rows -----------------------------------------
@register("leakage_free_train", "J1",
          sql=O.with_ctes(O.SFT_CTE) + "SELECT Id, label FROM clean_train")
def q_leakage_free_train(spark, sf_dir):
    from triageflow.operators import sampling as S
    split = jobs.stored_split(spark, sf_dir)
    train = split.where(F.col("split") == "train")
    return S.exclude_ids(train, jobs.eval_subset(split)).select("Id", "label")


# --- T2 / L6: SFT corpus split sizes ----------------------------------------
@register("sft_corpus_counts", "T2 L6 A1",
          sql=O.with_ctes(O.SFT_CTE) + """
SELECT sft_split, label, count(*) AS n FROM sft_all GROUP BY sft_split, label""")
def q_sft_corpus_counts(spark, sf_dir):
    split = jobs.stored_split(spark, sf_dir)
    corpus = jobs.sft_corpus(split, jobs.eval_subset(split))
    return corpus.groupBy("sft_split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("sft_split", "T2",
          sql=O.with_ctes(O.SFT_CTE) + "SELECT Id, label, sft_split, shuffle_key FROM sft_all")
def q_sft_split(spark, sf_dir):
    split = jobs.stored_split(spark, sf_dir)
    return jobs.sft_corpus(split, jobs.eval_subset(split)).select("Id", "label", "sft_split", "shuffle_key")


# ===========================================================================
# Answers (L7-L17)
# ===========================================================================
from triageflow.functions.jsonparse import answer_text, extract_answer, field_dump  # noqa: E402
from triageflow.operators import answers as A  # noqa: E402
from triageflow.operators import prompts as P  # noqa: E402


def _triage_answers(spark, sf_dir, shift=0):
    configure(spark)
    return fixtures.triage_answers(spark, sf_dir, shift)


@register("parsed_answers", "L7 L9 L10 L11 L13 L14",
          sql=O.with_ctes(O.PARSED_CTE) + """
SELECT Id, status, llm_predicted_label_raw, llm_predicted_label, round(llm_confidence, 6) AS llm_confidence,
  llm_reasoning_summary, actions_json FROM parsed""")
def q_parsed_answers(spark, sf_dir):
    p = A.parse_triage_answers(_triage_answers(spark, sf_dir))
    return p.select("Id", "status", "llm_predicted_label_raw", "llm_predicted_label",
                    F.round("llm_confidence", DIGITS).alias("llm_confidence"), "llm_reasoning_summary",
                    F.to_json("llm_recommended_actions").alias("actions_json"))


@register("parsed_answers_nongreedy", "L8 L12",
          sql=O.with_ctes(O.PARSED_NG_CTE)
          + "SELECT Id, status, llm_predicted_label_raw, llm_predicted_label FROM parsed_ng")
def q_parsed_answers_nongreedy(spark, sf_dir):
    p = A.parse_sft_answers(_triage_answers(spark, sf_dir))
    return p.select("Id", "status", "llm_predicted_label_raw", "llm_predicted_label")


@register("normalized_labels", "L11 A2",
          sql=O.with_ctes(O.PARSED_CTE) + """
SELECT llm_predicted_label_raw, llm_predicted_label, count(*) AS n FROM parsed
GROUP BY llm_predicted_label_raw, llm_predicted_label""")
def q_normalized_labels(spark, sf_dir):
    p = A.parse_triage_answers(_triage_answers(spark, sf_dir), with_details=False)
    return p.groupBy("llm_predicted_label_raw", "llm_predicted_label").agg(F.count(F.lit(1)).alias("n"))


@register("normalized_labels_narrow", "L12",
          sql=O.with_ctes(O.PARSED_NG_CTE) + """
SELECT llm_predicted_label_raw, llm_predicted_label, count(*) AS n FROM parsed_ng
GROUP BY llm_predicted_label_raw, llm_predicted_label""")
def q_normalized_labels_narrow(spark, sf_dir):
    p = A.parse_sft_answers(_triage_answers(spark, sf_dir))
    return p.groupBy("llm_predicted_label_raw", "llm_predicted_label").agg(F.count(F.lit(1)).alias("n"))


@register("answer_status_counts", "L9",
          sql=O.with_ctes(O.PARSED_CTE) + "SELECT status, count(*) AS n FROM parsed GROUP BY status")
def q_answer_status_counts(spark, sf_dir):
    p = A.parse_triage_answers(_triage_answers(spark, sf_dir), with_details=False)
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _llm_predictions(spark, sf_dir):
    return A.llm_prediction_table(_alerts(spark, sf_dir), _triage_answers(spark, sf_dir))


@register("llm_predictions", "L15 J2",
          sql=O.with_ctes(O.LLM_PRED_CTE) + """
SELECT Id, true_label, llm_predicted_label_raw, llm_predicted_label, round(llm_confidence, 6) AS llm_confidence,
  round(coalesce(latency_seconds, 0.0), 6) AS latency_seconds, status FROM llm_pred""")
def q_llm_predictions(spark, sf_dir):
    p = _llm_predictions(spark, sf_dir)
    return p.select("Id", "true_label", "llm_predicted_label_raw", "llm_predicted_label",
                    F.round("llm_confidence", DIGITS).alias("llm_confidence"),
                    F.round("latency_seconds", DIGITS).alias("latency_seconds"), "status")


@register("llm_predictions_repeated_ids", "J2 L15",
          sql=O.with_ctes(O.REPEATED_CTE) + """
SELECT IncidentId AS Id, a.Timestamp AS Timestamp, label AS true_label, llm_predicted_label_raw, llm_predicted_label,
  round(llm_confidence, 6) AS llm_confidence, round(latency_seconds, 6) AS latency_seconds, status
FROM alerts AS a LEFT JOIN rep_best AS b ON a.IncidentId = b.Id""")
def q_llm_predictions_repeated_ids(spark, sf_dir):
    """Alerts known by their incident, which has several answers, some failed."""
    configure(spark)
    alerts = _alerts(spark, sf_dir).withColumn("Id", F.col("IncidentId"))
    p = A.llm_prediction_table(alerts, fixtures.repeated_answers(spark, sf_dir))
    return p.select("Id", "Timestamp", "true_label", "llm_predicted_label_raw", "llm_predicted_label",
                    F.round("llm_confidence", DIGITS).alias("llm_confidence"),
                    F.round("latency_seconds", DIGITS).alias("latency_seconds"), "status")


@register("llm_validity", "A1 A5 A6 P8 P9 A7",
          sql=O.with_ctes(O.LLM_PRED_CTE) + """
SELECT count(*) AS total,
  CAST(sum(CASE WHEN llm_predicted_label IN ('BenignPositive','FalsePositive','TruePositive') THEN 1 ELSE 0 END) AS BIGINT) AS valid,
  CAST(count(*) - sum(CASE WHEN llm_predicted_label IN ('BenignPositive','FalsePositive','TruePositive') THEN 1 ELSE 0 END) AS BIGINT) AS invalid,
  round(CAST(sum(CASE WHEN true_label = llm_predicted_label THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS strict_accuracy,
  round(CAST(sum(CASE WHEN true_label = llm_predicted_label AND llm_predicted_label IN ('BenignPositive','FalsePositive','TruePositive') THEN 1 ELSE 0 END) AS DOUBLE)
    / nullif(sum(CASE WHEN llm_predicted_label IN ('BenignPositive','FalsePositive','TruePositive') THEN 1 ELSE 0 END), 0), 6) AS valid_accuracy,
  round(avg(coalesce(latency_seconds, 0.0)), 6) AS mean_latency_seconds
FROM llm_pred""")
def q_llm_validity(spark, sf_dir):
    p = _llm_predictions(spark, sf_dir)
    # one pass: validity counts and mean latency in the same global aggregate
    v = M.validity_summary(p, "true_label", "llm_predicted_label",
                           extra=[F.avg("latency_seconds").alias("mean_latency_seconds")])
    return v.select(
        "total", "valid", "invalid", F.round("strict_accuracy", DIGITS).alias("strict_accuracy"),
        F.round("valid_accuracy", DIGITS).alias("valid_accuracy"),
        F.round("mean_latency_seconds", DIGITS).alias("mean_latency_seconds"))


LLM_VALID_PREDS_SQL = """SELECT 'Qwen Zero-Shot' AS model, true_label, llm_predicted_label AS pred_label FROM llm_pred
  WHERE llm_predicted_label IN ('BenignPositive','FalsePositive','TruePositive')"""


@register("llm_eval", "L16 A8 A13",
          sql=O.with_ctes(O.LLM_PRED_CTE, O.metric_ctes(LLM_VALID_PREDS_SQL)) + REPORT_SQL)
def q_llm_eval(spark, sf_dir):
    p = _llm_predictions(spark, sf_dir)
    cells = M.confusion_cells(M.long_predictions(p, "true_label", "llm_predicted_label", "Qwen Zero-Shot"))
    return _rounded_report(M.valid_prediction_cells(cells))


SFT_PREDS_SQL = O.ALERTS_CTE + ",\n" + O.TRIAGE_ANSWERS_CTE + """,
sft_join AS (SELECT a.*, a.label AS true_label, t.raw_response, t.request_error, t.latency_seconds
             FROM alerts a LEFT JOIN triage_answers t ON a.Id = t.Id),
""" + O.parsed_ctes("sft_join", "sft_pred", False, O.LABEL_ALIASES_NARROW)


@register("sft_eval", "L17 A4 A13",
          sql=O.with_ctes(SFT_PREDS_SQL, O.metric_ctes(
              "SELECT 'LoRA-SFT' AS model, true_label, llm_predicted_label AS pred_label FROM sft_pred"))
          + REPORT_SQL)
def q_sft_eval(spark, sf_dir):
    j = A.attach_answers(_alerts(spark, sf_dir).withColumnRenamed("label", "true_label"),
                         _triage_answers(spark, sf_dir), greedy=False)
    p = A.parse_sft_answers(j)
    return _rounded_report(M.confusion_cells(M.long_predictions(p, "true_label", "llm_predicted_label", "LoRA-SFT")))


# ===========================================================================
# Prompt tables
# ===========================================================================
from triageflow.constants import (HYBRID_TEMPLATE, SFT_INPUT_PREFIX, SFT_INPUT_SUFFIX,  # noqa: E402
                                  SFT_SYSTEM_PROMPT, ZERO_SHOT_TEMPLATE)


def _prompt_query(make_col):
    def build(spark, sf_dir):
        a = _alerts(spark, sf_dir)
        col = make_col()
        return a.select("Id", F.md5(col).alias("prompt_md5"), F.length(col).alias("prompt_chars"))
    return build


def _prompt_sql(expr_sql):
    return O.with_ctes(O.ALERTS_CTE) + f"""
SELECT Id, md5({expr_sql}) AS prompt_md5, CAST(length({expr_sql}) AS INTEGER) AS prompt_chars FROM alerts"""


register("prompts_zero_shot", "L1", sql=_prompt_sql(O.render_sql(ZERO_SHOT_TEMPLATE, alert_text="alert_text")))(
    _prompt_query(lambda: P.zero_shot_prompt("alert_text")))
register("prompts_few_shot", "L2", sql=_prompt_sql(O.render_sql(P.few_shot_template(), alert_text="alert_text")))(
    _prompt_query(lambda: P.few_shot_prompt("alert_text")))


@register("prompts_hybrid", "L3",
          sql=O.with_ctes(O.SCORED_CTE) + f"""
SELECT Id, md5({O.render_sql(HYBRID_TEMPLATE, ml_prediction='predicted_label', alert_text='alert_text')}) AS prompt_md5,
  CAST(length({O.render_sql(HYBRID_TEMPLATE, ml_prediction='predicted_label', alert_text='alert_text')}) AS INTEGER)
  AS prompt_chars FROM scored""")
def q_prompts_hybrid(spark, sf_dir):
    s = feat.score_rules(_alerts(spark, sf_dir), keep_scores=False)
    col = P.hybrid_prompt("alert_text", "predicted_label")
    return s.select("Id", F.md5(col).alias("prompt_md5"), F.length(col).alias("prompt_chars"))


@register("chat_messages", "L4",
          sql=O.with_ctes(O.ALERTS_CTE) + f"""
SELECT Id, 0 AS msg_index, 'system' AS role, md5({O.q(SFT_SYSTEM_PROMPT)}) AS content_md5 FROM alerts
UNION ALL
SELECT Id, 1, 'user', md5({O.q(SFT_INPUT_PREFIX)} || alert_text || {O.q(SFT_INPUT_SUFFIX)}) FROM alerts""")
def q_chat_messages(spark, sf_dir):
    a = _alerts(spark, sf_dir).select("Id", F.posexplode(P.chat_messages("alert_text")).alias("msg_index", "m"))
    return a.select("Id", "msg_index", F.col("m.role").alias("role"), F.md5("m.content").alias("content_md5"))


@register("sft_records", "L5 L6 S6",
          sql=O.with_ctes(O.SFT_CTE) + f"""
SELECT Id, sft_split, md5({O.q(SFT_SYSTEM_PROMPT)}) AS instruction_md5,
  {O.q(SFT_INPUT_PREFIX)} || alert_text || {O.q(SFT_INPUT_SUFFIX)} AS input,
  '{{"predicted_label": "' || label || '"}}' AS output, shuffle_key FROM sft_all""")
def q_sft_records(spark, sf_dir):
    split = jobs.stored_split(spark, sf_dir)
    corpus = jobs.sft_corpus(split, jobs.eval_subset(split))
    rec = P.instruction_records(corpus, keep=["Id", "sft_split", "shuffle_key"])
    return rec.select("Id", "sft_split", F.md5("instruction").alias("instruction_md5"), "input", "output",
                      "shuffle_key")


@register("sft_json_corpus", "S6 T4 L5 L6",
          sql=O.with_ctes(O.SFT_CTE) + f"""
SELECT Id, sft_split, row_number() OVER (PARTITION BY sft_split ORDER BY shuffle_key, Id) - 1 AS position,
  md5({O.q(SFT_SYSTEM_PROMPT)}) AS instruction_md5, {O.q(SFT_INPUT_PREFIX)} || alert_text || {O.q(SFT_INPUT_SUFFIX)} AS input,
  '{{"predicted_label": "' || label || '"}}' AS output FROM sft_all""")
def q_sft_json_corpus(spark, sf_dir):
    """The corpus as JSON files of each split in shuffled order, read back in the
    order of the files."""
    split = jobs.stored_split(spark, sf_dir)
    path = jobs.write_corpus(jobs.sft_corpus(split, jobs.eval_subset(split)))
    rows = IO.read_json_in_order(spark, path, jobs.CORPUS_SCHEMA, "sft_split")
    return rows.select("Id", "sft_split", "position", F.md5("instruction").alias("instruction_md5"), "input", "output")


# ===========================================================================
# Hybrid records, cards, comparison
# ===========================================================================
from triageflow.constants import HYBRID_TEMPLATE_SERVICE, MODEL_ROLES, SERVICE_PARSE_FALLBACK_SUMMARY  # noqa: E402
from triageflow.operators import hybrid as H  # noqa: E402
from triageflow.session import checkpoint_root  # noqa: E402
from triageflow.sources import io as IO  # noqa: E402


def _hybrid(spark, sf_dir):
    scored = feat.score_rules(_alerts(spark, sf_dir), keep_scores=False)
    return H.hybrid_records(scored, "predicted_label", fixtures.hybrid_answers(spark, sf_dir))


@register("hybrid_records", "L18 L14 J2 P9",
          sql=O.with_ctes(O.HYBRID_CTE) + """
SELECT Id, true_label, ml_predicted_label, coalesce(true_label = ml_predicted_label, false) AS is_correct, status,
  analyst_summary, risk_explanation, mitre_json, actions_json, containment_priority,
  round(coalesce(latency_seconds, 0.0), 6) AS latency_seconds FROM hyb""")
def q_hybrid_records(spark, sf_dir):
    h = _hybrid(spark, sf_dir)
    return h.select("Id", "true_label", "ml_predicted_label", "is_correct", "status", "analyst_summary",
                    "risk_explanation", F.to_json("mitre_interpretation").alias("mitre_json"),
                    F.to_json("recommended_actions").alias("actions_json"), "containment_priority",
                    F.round("latency_seconds", DIGITS).alias("latency_seconds"))


@register("coerced_lists", "L14",
          sql=O.with_ctes(O.HYBRID_CTE) + """
SELECT actions_json, mitre_json, status, count(*) AS n FROM hyb GROUP BY actions_json, mitre_json, status""")
def q_coerced_lists(spark, sf_dir):
    h = _hybrid(spark, sf_dir)
    return (h.select(F.to_json("recommended_actions").alias("actions_json"),
                     F.to_json("mitre_interpretation").alias("mitre_json"), "status")
             .groupBy("actions_json", "mitre_json", "status").agg(F.count(F.lit(1)).alias("n")))


_DUMPS = " ".join(f"WHEN {i} THEN {O.q(json.dumps(v))}" for i, v in enumerate(fixtures.ACTION_VALUES))


@register("dumped_lists", "L13",
          sql=f"""
SELECT o_orderkey AS Id, CASE WHEN o_orderkey % 13 = 12 THEN '[]' ELSE CASE o_orderkey % {len(fixtures.DUMP_ANSWER_SHAPES)} {_DUMPS}
  ELSE '[]' END END AS actions_dump FROM orders""")
def q_dumped_lists(spark, sf_dir):
    """What the batch jobs store: the field as it stands, of any kind, as JSON text."""
    configure(spark)
    a = fixtures.hybrid_answers(spark, sf_dir, fixtures.DUMP_ANSWER_SHAPES)
    a = a.select("Id", extract_answer(F.col("raw_response")).alias("p"), answer_text(F.col("raw_response")).alias("t"))
    return a.select("Id", field_dump(F.col("p"), F.col("t"), "recommended_actions").alias("actions_dump"))


@register("hybrid_csv", "L13 L18 S5 S1",
          sql=O.with_ctes(O.SCORED_CTE) + f""",
d AS (SELECT Id, label, predicted_label, CASE WHEN Id % 13 = 12 THEN '[]' ELSE CASE Id % {len(fixtures.DUMP_ANSWER_SHAPES)} {_DUMPS} ELSE '[]' END END AS dump FROM scored)
SELECT Id, label AS true_label, label = predicted_label AS is_correct, CASE WHEN Id % 13 = 12 THEN '' ELSE 's' END AS summary,
  nullif(dump, 'null') AS recommended_actions, '[]' AS mitre_interpretation FROM d""")
def q_hybrid_csv(spark, sf_dir):
    """The batch job's CSV with dumped lists, written and read back (the reader takes
    the text ``null`` as missing, as everywhere)."""
    import uuid
    configure(spark)
    scored = feat.score_rules(_alerts(spark, sf_dir), keep_scores=False)
    records = H.hybrid_records(scored, "predicted_label", fixtures.hybrid_answers(spark, sf_dir, fixtures.DUMP_ANSWER_SHAPES))
    path = f"{checkpoint_root(spark)}/hybrid-csv-{uuid.uuid4().hex}"
    IO.write_csv(A.with_field_dumps(records, {c: c for c in ("recommended_actions", "mitre_interpretation")}, "raw_llm_response"), path)
    back = IO.read_csv(spark, path, "Id long, true_label string, is_correct boolean, analyst_summary string, status string, "
                                    "recommended_actions string, mitre_interpretation string", multi_line=True)
    summary = F.when(F.col("status") == "OK", F.col("analyst_summary")).otherwise("")
    return back.select("Id", "true_label", "is_correct", summary.alias("summary"), "recommended_actions", "mitre_interpretation")


CARD_SQL = """'## Example ' || CAST(example AS VARCHAR) || chr(10) || chr(10) ||
  '**True Label:** ' || coalesce(true_label, '') || chr(10) || chr(10) ||
  '**ML Prediction:** ' || coalesce(ml_predicted_label, '') || chr(10) || chr(10) ||
  '**Correct:** ' || CASE WHEN is_correct THEN 'True' ELSE 'False' END || chr(10) || chr(10) ||
  '**Alert Text:**' || chr(10) || chr(10) || '`' || coalesce(alert_text, '') || '`' || chr(10) || chr(10) ||
  '**Analyst Summary:**' || chr(10) || chr(10) || coalesce(analyst_summary, '') || chr(10) || chr(10) ||
  '**Risk Explanation:**' || chr(10) || chr(10) || coalesce(risk_explanation, '') || chr(10) || chr(10) ||
  '**Recommended Actions:**' || chr(10) || chr(10) || actions_json || chr(10) || chr(10) ||
  '---' || chr(10) || chr(10)"""


@register("example_cards", "L19 O1",
          sql=O.with_ctes(O.HYBRID_CTE) + f"""
SELECT example, Id, {CARD_SQL} AS card FROM (
  SELECT *, coalesce(true_label = ml_predicted_label, false) AS is_correct,
    CAST(row_number() OVER (ORDER BY Id) AS INTEGER) AS example FROM (SELECT * FROM hyb ORDER BY Id LIMIT 5))""")
def q_example_cards(spark, sf_dir):
    # the first 5 labelled alerts only; their answers are found by a semi join
    # against the (<= 5, broadcast) ids instead of joining every answer
    from triageflow.session import materialize
    # stored once (5 rows): the cards and the broadcast id set read the same rows
    scored = materialize(spark, feat.score_rules(_first_alerts(spark, sf_dir, 5), keep_scores=False), "card-alerts")
    answers = fixtures.hybrid_answers(spark, sf_dir).join(F.broadcast(scored.select("Id")), "Id", "left_semi")
    return H.example_cards(H.hybrid_records(scored, "predicted_label", answers), 5, ["Id"])


def _comparison_long(spark, sf_dir):
    """Rule, zero-shot, few-shot and fine-tuned-profile predictions over every
    labelled alert as (model, true, pred): a union of long tables. The rule label needs
    no join; answers meet ids and labels alone, not the alerts' texts."""
    rule = M.long_predictions(feat.score_rules(_alerts(spark, sf_dir), keep_scores=False), "label", "predicted_label", "Rule-Based Baseline")
    keys = jobs.alert_keys(spark, sf_dir)
    # one scan of the stored answers yields both parse profiles
    zero_sft = A.answer_labels(_triage_answers(spark, sf_dir), {
        "zero_pred": (True, O.LABEL_ALIASES_WIDE), "sft_pred": (False, O.LABEL_ALIASES_NARROW)}) \
        .select("Id", "zero_pred", "sft_pred")
    few = A.answer_labels(_triage_answers(spark, sf_dir, shift=5), {"few_pred": (True, O.LABEL_ALIASES_WIDE)}) \
        .select("Id", "few_pred")
    both = M.melt_predictions(keys.join(zero_sft, "Id", "left"), "label", {"Qwen Zero-Shot": "zero_pred", "LoRA-SFT": "sft_pred"})
    return rule.unionByName(both).unionByName(M.melt_predictions(keys.join(few, "Id", "left"), "label", {"Qwen Few-Shot": "few_pred"}))


COMPARISON_PREDS_SQL = O.SCORED_CTE + ",\n" + O.TRIAGE_ANSWERS_CTE + ",\n" + O.FEWSHOT_ANSWERS_CTE + ",\n" \
    + O.parsed_ctes("triage_answers", "zp") + ",\n" + O.parsed_ctes("fewshot_answers", "fp") + ",\n" \
    + O.parsed_ctes("triage_answers", "sp", False, O.LABEL_ALIASES_NARROW)
COMPARISON_LONG_SQL = """
  SELECT 'Rule-Based Baseline' AS model, label AS true_label, predicted_label AS pred_label FROM scored
  UNION ALL SELECT 'Qwen Zero-Shot', s.label, z.llm_predicted_label FROM scored s LEFT JOIN zp z ON s.Id = z.Id
  UNION ALL SELECT 'Qwen Few-Shot', s.label, f.llm_predicted_label FROM scored s LEFT JOIN fp f ON s.Id = f.Id
  UNION ALL SELECT 'LoRA-SFT', s.label, p.llm_predicted_label FROM scored s LEFT JOIN sp p ON s.Id = p.Id"""
ROLE_SQL = "CASE model " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in MODEL_ROLES.items()) + " END"


@register("model_comparison", "A15 A16 O5 A14",
          sql=O.with_ctes(COMPARISON_PREDS_SQL, O.metric_ctes(COMPARISON_LONG_SQL)) + f"""
SELECT model, {ROLE_SQL} AS role, round(accuracy, 4) AS accuracy, round(macro_precision, 4) AS macro_precision,
  round(macro_recall, 4) AS macro_recall, round(macro_f1, 4) AS macro_f1, round(weighted_f1, 4) AS weighted_f1
FROM summ""")
def q_model_comparison(spark, sf_dir):
    cells = M.confusion_cells(_comparison_long(spark, sf_dir))
    return M.model_comparison(cells, MODEL_ROLES).select(
        "model", "role", "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@register("baseline_summary", "A14 M9",
          sql=O.with_ctes(COMPARISON_PREDS_SQL, O.metric_ctes(COMPARISON_LONG_SQL)) + O.summary_select(DIGITS))
def q_baseline_summary(spark, sf_dir):
    return _rounded_summary(M.confusion_cells(_comparison_long(spark, sf_dir)))


@register("confusion_matrix_dynamic", "A9 A3",
          sql=O.with_ctes(O.LLM_PRED_CTE) + """,
lbl AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_order
        FROM (SELECT DISTINCT true_label AS label FROM llm_pred WHERE true_label IS NOT NULL)),
cells AS (SELECT true_label, llm_predicted_label AS pred_label, count(*) AS n FROM llm_pred GROUP BY ALL)
SELECT 'Qwen Zero-Shot' AS model, t.label AS true_label, p.label AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  CAST(t.label_order * (SELECT count(*) FROM lbl) + p.label_order AS INTEGER) AS cell_order
FROM lbl t CROSS JOIN lbl p LEFT JOIN cells c ON c.true_label = t.label AND c.pred_label = p.label""")
def q_confusion_matrix_dynamic(spark, sf_dir):
    from triageflow.session import materialize
    p = _llm_predictions(spark, sf_dir)
    # one pass over the predictions: the (tiny) cell table is stored, and both
    # the label list (distinct true labels) and the matrix read it
    cells = materialize(spark, M.confusion_cells(M.long_predictions(p, "true_label", "llm_predicted_label",
                                                                     "Qwen Zero-Shot")), "llm-cells")
    labels = M.distinct_values(cells, M.TRUE)
    return M.confusion_matrix_long(cells, labels)


@register("confusion_matrix_wide", "A8",
          sql=O.with_ctes(O.LLM_PRED_CTE) + """
SELECT 'Qwen Zero-Shot' AS model, t.label AS true_label,
  CAST(count(*) FILTER (WHERE llm_predicted_label = 'BenignPositive') AS BIGINT) AS BenignPositive,
  CAST(count(*) FILTER (WHERE llm_predicted_label = 'FalsePositive') AS BIGINT) AS FalsePositive,
  CAST(count(*) FILTER (WHERE llm_predicted_label = 'TruePositive') AS BIGINT) AS TruePositive
FROM (VALUES ('BenignPositive'), ('FalsePositive'), ('TruePositive')) AS t(label)
LEFT JOIN llm_pred l ON l.true_label = t.label GROUP BY t.label""")
def q_confusion_matrix_wide(spark, sf_dir):
    p = _llm_predictions(spark, sf_dir)
    cells = M.confusion_cells(M.long_predictions(p, "true_label", "llm_predicted_label", "Qwen Zero-Shot"))
    return M.confusion_matrix_wide(cells)


# ===========================================================================
# Previews, positions, bounded scan, input check
# ===========================================================================
PREVIEW_COLS = ["Id", "IncidentId", "AlertId", "Timestamp", "alert_text", "label"]


def alert_preview(df: DataFrame, limit: int = 20, order_col: str = "Id") -> DataFrame:
    """Available preview columns, ``limit`` clamped to 1..100, lowest ``order_col`` first."""
    n = max(1, min(int(limit), 100))
    cols = [c for c in PREVIEW_COLS if c in df.columns]
    return df.select(*cols).orderBy(order_col).limit(n)


def alert_at_position(df: DataFrame, index: int, order_col: str = "Id") -> DataFrame:
    """Row at 0-based ``index`` in ``order_col`` order; empty when out of range.
    Exact at any index without holding ``index + 1`` rows in one task
    (``operators.position``)."""
    from triageflow.operators.position import row_at_position
    return row_at_position(df, index, order_col)


@register("alert_preview", "P2 O1 O3",
          sql=O.with_ctes(O.ALERTS_CTE) + "SELECT Id, IncidentId, AlertId, Timestamp, alert_text, label FROM alerts "
                                         "ORDER BY Id LIMIT 20")
def q_alert_preview(spark, sf_dir):
    return alert_preview(_first_alerts(spark, sf_dir, 20), 20)


@register("alert_at_position", "O2",
          sql=O.with_ctes(O.ALERTS_CTE) + "SELECT Id, IncidentId, AlertId, Timestamp, alert_text, label FROM alerts "
                                         "ORDER BY Id LIMIT 1 OFFSET 7")
def q_alert_at_position(spark, sf_dir):
    from triageflow.operators.position import RANK_ROWS
    index = 7
    # a small index only needs the first index + 1 alerts; a large one searches all
    src = _first_alerts(spark, sf_dir, index + 1) if index < RANK_ROWS else _alerts(spark, sf_dir)
    return alert_at_position(src, index)


EIGHTHS = [0, 1, 2, 3, 4, 5, 6, 7]


@register("alerts_at_positions", "O2",
          sql=O.with_ctes(O.ALERTS_CTE) + f"""
SELECT position, Id, label, md5(alert_text) AS text_md5 FROM (
  SELECT *, row_number() OVER (ORDER BY alert_text, Id) - 1 AS position, count(*) OVER () AS n FROM alerts)
WHERE position IN ({", ".join(f"n - 1 - (n // 8) * {k}" for k in EIGHTHS)})""")
def q_alerts_at_positions(spark, sf_dir):
    """Positions over the whole table, from the last back to the first eighth, through
    the ordinal index by text, long strings that share their first characters."""
    from triageflow.operators import position as PO
    alerts = _alerts(spark, sf_dir)
    order = F.concat(F.col("alert_text"), F.lit("\0"), F.lpad(F.col("Id").cast("string"), 20, "0"))
    rows = alerts.select("Id", "label", "alert_text", order.alias("_order"))
    index = PO.ordinal_index(rows, "_order", ["Id"])
    n = alerts.count()
    wanted = spark.createDataFrame([(n - 1 - (n // 8) * k,) for k in EIGHTHS], "position long").distinct()
    return PO.rows_at(rows, index, wanted, "_order", ["Id"]).select("position", "Id", "label", F.md5("alert_text").alias("text_md5"))


@register("first_n_alerts", "S2 P5",
          sql=O.with_ctes(O.RAW_ALERTS_CTE) + """
SELECT Id, IncidentGrade AS label FROM (SELECT * FROM raw_alerts ORDER BY Id LIMIT 1000) WHERE IncidentGrade IS NOT NULL""")
def q_first_n_alerts(spark, sf_dir):
    configure(spark)
    raw = fixtures.raw_alerts(spark, sf_dir, first_n=1000).orderBy("Id").limit(1000)
    return feat.preprocess_alerts(raw).select("Id", "label")


@register("reject_empty_alerts", "P10",
          sql=O.with_ctes(O.TRIAGE_ANSWERS_CTE) + f"""
SELECT CASE WHEN coalesce(length({O.strip_sql('raw_response')}) > 0, false) THEN 'accepted' ELSE 'rejected' END
  AS outcome, count(*) AS n FROM triage_answers GROUP BY 1""")
def q_reject_empty_alerts(spark, sf_dir):
    a = _triage_answers(spark, sf_dir)
    ok, bad = feat.split_non_empty(a, "raw_response")
    return (ok.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.lit("rejected").alias("outcome")))
              .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


# ===========================================================================
# Sources and sinks
# ===========================================================================
from triageflow.sources import profile as PR  # noqa: E402
from triageflow.sources.tables import TABLES, read_table  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

PROCESSED_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType()), T.StructField("IncidentId", T.LongType()),
    T.StructField("AlertId", T.LongType()), T.StructField("Timestamp", T.StringType()),
    T.StructField("alert_text", T.StringType()), T.StructField("label", T.StringType()),
])


@register("csv_roundtrip", "S1 S3 S5",
          sql=O.with_ctes(O.ALERTS_CTE) + "SELECT Id, IncidentId, AlertId, Timestamp, alert_text, label FROM alerts")
def q_csv_roundtrip(spark, sf_dir):
    import uuid
    path = f"{checkpoint_root(spark)}/processed-csv-{uuid.uuid4().hex}"
    IO.write_csv(_alerts(spark, sf_dir), path)
    return IO.read_csv(spark, path, PROCESSED_SCHEMA)


# Files as analysts send them: some ids end in a letter, some incidents are out of
# range, some rows lack their last field.
@register("csv_rejects", "S1",
          sql="""
WITH r AS (SELECT o_orderkey % 7 = 3 AS bad_id, o_orderkey % 11 = 5 AS bad_incident, o_orderkey % 13 = 8 AS short FROM orders),
s AS (SELECT concat_ws('; ', CASE WHEN short THEN 'malformed record' END,
    CASE WHEN bad_id THEN 'Id: {"value":"?"} is not bigint' END,
    CASE WHEN bad_incident THEN 'IncidentId: {"value":"?"} is not bigint' END) AS reason FROM r)
SELECT CASE WHEN reason = '' THEN 'read' ELSE reason END AS outcome, count(*) AS n FROM s GROUP BY reason""")
def q_csv_rejects(spark, sf_dir):
    """Rows read, and rows set aside by reason."""
    import uuid
    configure(spark)
    path = f"{checkpoint_root(spark)}/raw-csv-{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    line = F.concat(key.cast("string"), F.when(key % 7 == 3, "x").otherwise(""), F.lit(","),
                    F.col("o_custkey").cast("string"), F.when(key % 11 == 5, "99999999999999999999").otherwise(""),
                    F.when(key % 13 == 8, "").otherwise(F.concat(F.lit(","), F.col("o_orderstatus"))))
    lines = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).select(line.alias("Id,IncidentId,Note"))
    lines.write.option("header", True).option("sep", "\u0001").csv(path)  # whole lines as they are
    good, bad = IO.read_csv_checked(spark, path, "Id bigint, IncidentId bigint, Note string")
    outcome = F.regexp_replace("reason", r'"value":"[^"]*"', '"value":"?"')
    both = good.select(F.lit("read").alias("outcome")).unionByName(bad.select(outcome.alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("profile_tables", "S4", sql=O.PROFILE_SQL)
def q_profile_tables(spark, sf_dir):
    configure(spark)
    prof, _errors = PR.profile_tables(spark, sf_dir, TABLES)
    return prof.drop("data_type")


#: Columns counted exactly beside their sketch.
EXACT_COLUMNS = {"orders": ["o_custkey", "o_orderpriority"], "customer": ["c_mktsegment"], "part": ["p_brand"], "documents": ["lang", "text"]}


@register("profile_sketches", "S4", sql=O.sketch_profile_sql(EXACT_COLUMNS))
def q_profile_sketches(spark, sf_dir):
    """Types, nulls, first values and distinct counts of whole tables by sketches
    that are made per file and merged."""
    configure(spark)
    parts = [PR.sketch_profile(spark, read_table(spark, sf_dir, t), t, exact=exact) for t, exact in EXACT_COLUMNS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 0.05 * F.col("distinct_count") + 1
    return out.select("table_name", "column_name", "column_position", "data_type", "row_count", "null_count", "distinct_count",
                      near.alias("estimate_near"), F.to_json("first_values").alias("first_json"))


# ===========================================================================
# Text ML (M1-M8)
# ===========================================================================
from triageflow.operators import textml as TM  # noqa: E402


@register("tokens", "M1 P6",
          sql=O.with_ctes(O.ALERTS_CTE) + f"""
SELECT Id, CAST(len({O.TOKENS_SQL}) AS INTEGER) AS n_tokens, CAST(to_json({O.TOKENS_SQL}) AS VARCHAR) AS tokens_json
FROM alerts""")
def q_tokens(spark, sf_dir):
    t = TM.tokens("alert_text")
    return _alerts(spark, sf_dir).select("Id", F.size(t).alias("n_tokens"), F.to_json(t).alias("tokens_json"))


@register("term_counts", "M2", sql=O.with_ctes(O.TERMS_CTE) + "SELECT term, df, total FROM term_stats")
def q_term_counts(spark, sf_dir):
    return TM.term_stats(_alerts(spark, sf_dir))


@register("vocabulary", "M3", sql=O.with_ctes(O.TERMS_CTE) + "SELECT term, df, total, term_rank FROM vocab")
def q_vocabulary(spark, sf_dir):
    return TM.vocabulary(_alerts(spark, sf_dir))


@register("tfidf_terms", "M4", sql=O.with_ctes(O.TERMS_CTE) + "SELECT Id, term, round(weight, 6) AS weight FROM tfidf")
def q_tfidf_terms(spark, sf_dir):
    # three passes (document count, vocabulary, term frequencies) over one stored input
    t = TM.tfidf_terms(_alerts(spark, sf_dir))
    return t.select("Id", "term", F.round("weight", DIGITS).alias("weight"))


@register("class_weights", "M5",
          sql=O.with_ctes(O.SPLIT_CTE) + """
SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight
FROM (SELECT label, count(*) AS n FROM split_alerts WHERE split = 'train' GROUP BY label)""")
def q_class_weights(spark, sf_dir):
    train = jobs.stored_split(spark, sf_dir).where(F.col("split") == "train")
    return TM.class_weight_table(train).select("label", "n", F.round("weight", DIGITS).alias("weight"))


def _lr_job(spark, sf_dir):
    """M8: fit on the train split, save, load and score the test split."""
    split = jobs.stored_split(spark, sf_dir)
    model = jobs.saved_classifier(split)
    test = split.where(F.col("split") == "test")
    return TM.predict(model, test, keep=["Id", "label"])


@register("lr_predict", "M6 M7 S7 P6")
def q_lr_predict(spark, sf_dir):
    return _lr_job(spark, sf_dir)


@register("lr_metrics", "M8 A4 A11 A12")
def q_lr_metrics(spark, sf_dir):
    p = _lr_job(spark, sf_dir)
    return _rounded_summary(M.confusion_cells(
        M.long_predictions(p, "label", "predicted_label", "TF-IDF + Logistic Regression")))


# ===========================================================================
# Streaming (R1 R2) and the responder hook
# ===========================================================================
from triageflow.operators import responders  # noqa: E402
from triageflow.streaming import classify as ST  # noqa: E402


def _staged_raw_alerts(spark, sf_dir, n_files=4):
    configure(spark)
    src = ST.scratch(spark, "incoming-alerts")
    return ST.stage_files(fixtures.raw_alerts(spark, sf_dir), src, n_files)


@register("stream_rule_predictions", "R1 P10",
          sql=O.with_ctes(O.ONLINE_CTE)
          + "SELECT Id, label, tp_score, benign_score, fp_score, predicted_label FROM online")
def q_stream_rule_predictions(spark, sf_dir):
    src = _staged_raw_alerts(spark, sf_dir)
    sink, ckpt = ST.scratch(spark, "stream-sink"), ST.scratch(spark, "stream-ckpt")
    ST.run_rule_stream(spark, src, sink, ckpt, max_files_per_trigger=1)
    return spark.read.parquet(sink).select("Id", "label", "tp_score", "benign_score", "fp_score", "predicted_label")


@register("stream_triage", "R2 L20 L3 L14")
def q_stream_triage(spark, sf_dir):
    src = _staged_raw_alerts(spark, sf_dir)
    out, ckpt = ST.scratch(spark, "triage-out"), ST.scratch(spark, "triage-ckpt")
    ST.run_triage_stream(spark, src, out, ckpt, responders.guidance_stub, max_files_per_trigger=2)
    return spark.read.parquet(out)


def _responder_run(spark, sf_dir):
    """Hybrid prompts -> responder hook (deterministic stub, calls overlapped) ->
    stored answers, each with its alert -> hybrid records. No join back."""
    scored = feat.score_rules(_alerts(spark, sf_dir), keep_scores=False)
    prompts = (scored.withColumn("prompt", P.hybrid_prompt("alert_text", "predicted_label"))
               .withColumnsRenamed({"label": "true_label", "predicted_label": "ml_predicted_label"}))
    answers = H.respond(prompts, responders.guidance_stub, keep=H.RECORD_COLUMNS, in_flight=4)
    return H.answered_records(H.materialize(spark, answers, "responder-answers"))


@register("responder_stub", "L20 L18")
def q_responder_stub(spark, sf_dir):
    return _responder_run(spark, sf_dir)


# SQL twin of ``responders.guidance_stub`` (its answer is a function of the
# prompt text), so the hook's output, all but wall-clock latency, is checked.
def stub_answers_cte(src: str, template: str, prefix: str, parse_fallback: str = O.HYBRID_PARSE_FALLBACK_SUMMARY) -> str:
    """CTEs ``{prefix}_join`` (alerts of ``src`` with the stub's answers) and
    ``{prefix}_hyb`` (parsed guidance)."""
    prompt = O.render_sql(template, ml_prediction="predicted_label", alert_text="alert_text")
    x = prefix
    return f"""{x}_p AS (SELECT Id, {prompt} AS prompt FROM {src}),
{x}_d AS (SELECT Id, prompt, md5(prompt) AS d, coalesce(nullif(regexp_extract(prompt,
             '(?m)^\\s*(TruePositive|FalsePositive|BenignPositive)\\s*$', 1), ''), 'unknown') AS lab FROM {x}_p),
{x}_b AS (SELECT *, CASE lab WHEN 'TruePositive' THEN 'High' WHEN 'FalsePositive' THEN 'Low' ELSE 'Medium' END AS prio,
             CAST('0x' || substr(d, 1, 4) AS INTEGER) % 17 = 0 AS failed,
             CAST('0x' || substr(d, 5, 2) AS INTEGER) % 3 AS wrap FROM {x}_d),
{x}_j AS (SELECT *, '{{"analyst_summary": "Alert classified as ' || lab || '.", '
             || '"risk_explanation": "derived from the alert fields", "mitre_interpretation": '
             || CASE WHEN contains(prompt, 'T1110') THEN '["T1110"]' ELSE '[]' END || ', "recommended_actions": '
             || CASE WHEN prio <> 'Low' THEN '["review alert", "check entity"]' ELSE '"close alert"' END
             || ', "containment_priority": "' || prio || '"}}' AS body FROM {x}_b),
{x}_answers AS (SELECT Id,
    CASE WHEN NOT failed THEN (CASE WHEN wrap <> 0 THEN body
      ELSE 'Here is the JSON:' || chr(10) || body || chr(10) || 'Thanks.' END) END AS raw_response,
    CASE WHEN failed THEN 'stub responder: simulated timeout' END AS request_error FROM {x}_j),
{x}_join AS (SELECT s.Id, s.label AS true_label, s.predicted_label AS ml_predicted_label, a.raw_response,
                a.request_error FROM {src} s LEFT JOIN {x}_answers a ON s.Id = a.Id),
""" + O.guidance_ctes(f"{x}_join", f"{x}_hyb", parse_fallback)


STUB_ANSWERS_CTE = stub_answers_cte("scored", HYBRID_TEMPLATE, "stub")


@register("responder_records", "L20 L18 J2",
          sql=O.with_ctes(O.SCORED_CTE, STUB_ANSWERS_CTE) + """
SELECT Id, true_label, ml_predicted_label, coalesce(true_label = ml_predicted_label, false) AS is_correct, status,
  analyst_summary, risk_explanation, mitre_json, actions_json, containment_priority,
  md5(coalesce(raw_response, request_error)) AS raw_md5 FROM stub_hyb""")
def q_responder_records(spark, sf_dir):
    h = _responder_run(spark, sf_dir)
    return h.select("Id", "true_label", "ml_predicted_label", "is_correct", "status", "analyst_summary",
                    "risk_explanation", F.to_json("mitre_interpretation").alias("mitre_json"),
                    F.to_json("recommended_actions").alias("actions_json"), "containment_priority",
                    F.md5("raw_llm_response").alias("raw_md5"))


@register("stream_triage_records", "R2 L20 L3 L14",
          sql=O.with_ctes(O.ONLINE_CTE, stub_answers_cte("online", HYBRID_TEMPLATE_SERVICE, "svc",
                                                         SERVICE_PARSE_FALLBACK_SUMMARY)) + """
SELECT Id, ml_predicted_label, status, analyst_summary, risk_explanation, mitre_json, actions_json,
  containment_priority, md5(coalesce(raw_response, request_error)) AS raw_md5 FROM svc_hyb""")
def q_stream_triage_records(spark, sf_dir):
    """The R2 stream's rows, all but micro-batch id and wall-clock latency."""
    out = q_stream_triage(spark, sf_dir)
    return out.select("Id", "ml_predicted_label", "status", "analyst_summary", "risk_explanation",
                      F.to_json("mitre_interpretation").alias("mitre_json"),
                      F.to_json("recommended_actions").alias("actions_json"), "containment_priority",
                      F.md5("raw_llm_response").alias("raw_md5"))


_ACCEPTED_SQL = "SELECT Id, true AS agrees FROM alerts WHERE Id % 9 NOT IN (2, 5, 7)"


def _request_stream(spark, sf_dir):
    """R2 as the service runs it: requests, the stored classifier, the responder."""
    split = jobs.stored_split(spark, sf_dir)
    model = jobs.saved_classifier(split)
    src = ST.stage_files(fixtures.online_requests(split), ST.scratch(spark, "requests"), 3)
    out, rejected, ckpt = (ST.scratch(spark, f"requests-{x}") for x in ("out", "rejected", "ckpt"))
    ST.run_request_stream(spark, src, out, rejected, ckpt, responders.guidance_stub, model, max_files_per_trigger=1)
    return split, model, spark.read.parquet(out), spark.read.parquet(rejected)


@register("stream_triage_trained", "R2 M7 S7 L20", sql=O.with_ctes(O.ALERTS_CTE) + _ACCEPTED_SQL)
def q_stream_triage_trained(spark, sf_dir):
    """Every accepted request triaged once, its label that of the loaded classifier
    in batch over the same alerts, its summary the answer to that label."""
    split, model, out, _ = _request_stream(spark, sf_dir)
    batch = TM.predict(model, split, keep=["Id"]).withColumnRenamed("predicted_label", "want")
    told = F.col("analyst_summary").contains(F.col("want")) | (F.col("status") != "OK")
    return out.join(batch, "Id").select("Id", ((F.col("ml_predicted_label") == F.col("want")) & told).alias("agrees"))


@register("stream_rejected_requests", "P10 R2",
          sql=O.with_ctes(O.ALERTS_CTE) + f"""
SELECT Id, CASE Id % 9 WHEN 7 THEN NULL ELSE '' END AS alert_text, {O.q(ST.EMPTY_REASON)} AS reason FROM alerts WHERE Id % 9 IN (2, 5, 7)""")
def q_stream_rejected_requests(spark, sf_dir):
    return _request_stream(spark, sf_dir)[3].select("Id", "alert_text", "reason")


# ===========================================================================
# Jobs that need the trained classifier (rows-only: no SQL twin for L-BFGS)
# ===========================================================================
def _subset_with_models(spark, sf_dir):
    """E2 on the shared evaluation subset: rule and TF-IDF+LR predictions side by
    side (the two-prediction table), LR trained on the train split."""
    split = jobs.stored_split(spark, sf_dir)
    model = jobs.saved_classifier(split)
    subset = jobs.eval_subset(split)
    lr = TM.predict(model, subset).withColumnRenamed("predicted_label", "logreg_prediction")
    return feat.score_rules(lr, pred_col="rule_based_prediction", keep_scores=False)


@register("subset_baselines", "M9 A14 J2")
def q_subset_baselines(spark, sf_dir):
    both = _subset_with_models(spark, sf_dir)
    long_df = M.melt_predictions(both, "label", {"Rule-Based Baseline": "rule_based_prediction",
                                                 "TF-IDF + Logistic Regression": "logreg_prediction"})
    return M.model_summary(M.confusion_cells(long_df)).drop("n_rows")


@register("subset_baselines_checked", "M9 A14 M7",
          sql=O.with_ctes(O.EVAL_CTE + f""",
sub_scored AS (SELECT label, {O.keyword_sum('lower(alert_text)', O.TRUE_POSITIVE_KEYWORDS)} AS tp_score,
    {O.keyword_sum('lower(alert_text)', O.FALSE_POSITIVE_KEYWORDS)} AS fp_score FROM eval_subset),
sub_pred AS (SELECT label, {O.RULE_PRED_SQL} AS predicted_label FROM sub_scored)""",
                          O.metric_ctes("SELECT 'Rule-Based Baseline' AS model, label AS true_label, predicted_label AS pred_label FROM sub_pred")) + """
SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, n_rows, true AS agrees FROM summ
UNION ALL SELECT 'TF-IDF + Logistic Regression', NULL, NULL, NULL, count(*), true FROM eval_subset""")
def q_subset_baselines_checked(spark, sf_dir):
    """The two baselines on the shared subset: the rule's metrics in full; the
    classifier's agree with those of labels scored from the relational weights."""
    split = jobs.stored_split(spark, sf_dir)
    model, subset = jobs.saved_classifier(split), jobs.eval_subset(split)
    terms = TM.tfidf_terms(subset.select("Id", "alert_text"), fit_df=split.where(F.col("split") == "train"))
    lr = TM.predict(model, subset).withColumnRenamed("predicted_label", "lr")
    both = feat.score_rules(lr, pred_col="rule", keep_scores=False).join(TM.predict_relational(model, terms), "Id", "left")
    long_df = M.melt_predictions(both, "label", {"Rule-Based Baseline": "rule", "lr": "lr", "twin": "predicted_label"})
    cols = ["accuracy", "macro_f1", "weighted_f1"]
    found = {r["model"]: r for r in M.model_summary(M.confusion_cells(long_df)).collect()}  # one row per model
    agrees = all(abs(found["lr"][c] - found["twin"][c]) < 1e-9 for c in SUMMARY_COLS)  # sums of another order
    rule = found["Rule-Based Baseline"]
    rows = [("Rule-Based Baseline", *[rule[c] for c in cols], rule["n_rows"], True), ("TF-IDF + Logistic Regression", None, None, None, found["lr"]["n_rows"], agrees)]
    out = spark.createDataFrame(rows, "model string, accuracy double, macro_f1 double, weighted_f1 double, n_rows long, agrees boolean")
    return out.select("model", *[F.round(c, DIGITS).alias(c) for c in cols], "n_rows", "agrees")


@register("model_comparison_subset", "A15 A16 O5 L18")
def q_model_comparison_subset(spark, sf_dir):
    """The five-row comparison on the evaluation subset: rule, LR, zero-shot,
    few-shot, and the hybrid row (its label is the LR label by construction)."""
    both = _subset_with_models(spark, sf_dir)
    zero = A.parse_triage_answers(_triage_answers(spark, sf_dir), with_details=False) \
            .select("Id", F.col("llm_predicted_label").alias("zero_pred"))
    few = A.parse_triage_answers(_triage_answers(spark, sf_dir, shift=5), with_details=False) \
           .select("Id", F.col("llm_predicted_label").alias("few_pred"))
    j = both.join(zero, "Id", "left").join(few, "Id", "left")
    long_df = M.melt_predictions(j, "label", {
        "Rule-Based Baseline": "rule_based_prediction", "TF-IDF + Logistic Regression": "logreg_prediction",
        "Qwen Zero-Shot": "zero_pred", "Qwen Few-Shot": "few_pred", "Hybrid ML + Qwen": "logreg_prediction"})
    return M.model_comparison(M.confusion_cells(long_df), MODEL_ROLES)


@register("lr_prediction_check", "M6 M7 M8 S7",
          sql=O.with_ctes(O.SPLIT_CTE) + "SELECT Id, label, true AS agrees FROM split_alerts WHERE split = 'test'")
def q_lr_prediction_check(spark, sf_dir):
    """Every prediction of the loaded model against the class of the largest score
    over the relational TF-IDF weights, without the model's transformers."""
    split = jobs.stored_split(spark, sf_dir)
    model = jobs.saved_classifier(split)
    test, train = split.where(F.col("split") == "test"), split.where(F.col("split") == "train")
    terms = TM.tfidf_terms(test.select("Id", "alert_text"), fit_df=train)
    want = TM.predict_relational(model, terms).withColumnRenamed("predicted_label", "want")
    p = TM.predict(model, test, keep=["Id", "label"]).join(want, "Id", "left")
    return p.select("Id", "label", F.coalesce(F.col("predicted_label") == F.col("want"), F.lit(False)).alias("agrees"))


@register("lr_gradient_bound", "M6",
          sql=O.with_ctes(O.SPLIT_CTE) + """
SELECT count(*) AS n_train, true AS is_stationary FROM split_alerts WHERE split = 'train'""")
def q_lr_gradient_bound(spark, sf_dir):
    """The objective's gradient at the stored fit is under 1 % of that at zero weights."""
    split = jobs.stored_split(spark, sf_dir)
    train = split.where(F.col("split") == "train")
    ratio = TM.gradient_ratio(jobs.saved_classifier(split), train)
    return train.agg(F.count(F.lit(1)).alias("n_train")).withColumn("is_stationary", F.lit(ratio < 0.01))


# What SQL can say about the classifier's rows: which alerts it scores, that every
# prediction is a learned label, and everything of its records but that label.
@register("lr_scored_rows", "M6 M7 M8 S7",
          sql=O.with_ctes(O.SPLIT_CTE) + "SELECT Id, label, true AS is_known FROM split_alerts WHERE split = 'test'")
def q_lr_scored_rows(spark, sf_dir):
    p = _lr_job(spark, sf_dir)
    return p.select("Id", "label", F.col("predicted_label").isin(LABELS).alias("is_known"))


@register("hybrid_records_lr", "L18 J2 M7 S7",
          sql=O.with_ctes(O.HYBRID_CTE, O.EVAL_CTE[len(O.ALERTS_CTE) + 2:]) + """
SELECT Id, true_label, true AS is_known, status, analyst_summary, risk_explanation, mitre_json, actions_json,
  containment_priority, round(coalesce(latency_seconds, 0.0), 6) AS latency_seconds
FROM hyb WHERE Id IN (SELECT Id FROM eval_subset)""")
def q_hybrid_records_lr(spark, sf_dir):
    """Hybrid records of the evaluation subset with the trained classifier's label."""
    split = jobs.stored_split(spark, sf_dir)
    scored = TM.predict(jobs.saved_classifier(split), jobs.eval_subset(split))
    h = H.hybrid_records(scored, "predicted_label", fixtures.hybrid_answers(spark, sf_dir))
    return h.select("Id", "true_label", F.col("ml_predicted_label").isin(LABELS).alias("is_known"), "status",
                    "analyst_summary", "risk_explanation", F.to_json("mitre_interpretation").alias("mitre_json"),
                    F.to_json("recommended_actions").alias("actions_json"), "containment_priority",
                    F.round("latency_seconds", DIGITS).alias("latency_seconds"))


# ===========================================================================
# Same operators on other driver tables (FIXTURES 2.3)
# ===========================================================================
from triageflow.sources.tables import read_table  # noqa: E402


@register("document_tokens", "M1",
          sql=f"""SELECT doc_id, CAST(len({O.DOC_TOKENS_SQL}) AS INTEGER) AS n_tokens,
  md5(array_to_string({O.DOC_TOKENS_SQL}, ' ')) AS tokens_md5 FROM documents""")
def q_document_tokens(spark, sf_dir):
    """Word tokens of whole multilingual texts (Unicode letters/numbers)."""
    configure(spark)
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True)
    t = TM.tokens("text")
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@register("document_term_stats", "M2 M3",
          sql=O.with_ctes(O.DOC_TERMS_CTE) + "SELECT term, df, total FROM dterm_stats")
def q_document_term_stats(spark, sf_dir):
    configure(spark)
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"], spread=True)
    return TM.term_stats(d, "text")


BINARY_PREDS_SQL = "SELECT 'quality vs toxic' AS model, CAST(quality AS VARCHAR) AS true_label, " \
                   "CAST(toxic AS VARCHAR) AS pred_label FROM labels"


@register("binary_report", "A10 A13",
          sql=O.with_ctes(O.metric_ctes(BINARY_PREDS_SQL, ["0", "1"]))
          + REPORT_SQL.replace("SELECT model, 3,", "SELECT model, 2,").replace("SELECT model, 4,", "SELECT model, 3,")
                      .replace("SELECT model, 5,", "SELECT model, 4,"))
def q_binary_report(spark, sf_dir):
    """Two-label report over the ``labels`` table (quality as truth, toxic as
    prediction): the metric operators with a label list other than the three
    triage grades."""
    configure(spark)
    lab = read_table(spark, sf_dir, "labels", ["quality", "toxic"])
    long_df = lab.select(F.lit("quality vs toxic").alias("model"), F.col("quality").cast("string").alias("true_label"),
                         F.col("toxic").cast("string").alias("pred_label"))
    r = M.classification_report(M.confusion_cells(long_df), ["0", "1"])
    return r.select("model", "row_order", "row_name", *[F.round(c, DIGITS).alias(c) for c in
                                                        ["precision", "recall", "f1"]],
                    F.col("support").cast("long").alias("support"))
