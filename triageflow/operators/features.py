"""Alert preprocessing and rule scoring operators (DataFrame -> DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triageflow.constants import FEATURE_COLUMNS, ID_COLUMNS, TARGET_COL
from triageflow.functions import rules as R
from triageflow.functions.text import alert_text, is_non_empty

PROCESSED_COLUMNS = ID_COLUMNS + ["alert_text", "label"]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Input guard: fail with a clear message when required columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Required column(s) {missing} not found; have {df.columns}")
    return df


def preprocess_alerts(raw: DataFrame, target_col: str = TARGET_COL,
                      feature_columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Drop unlabelled rows, assemble ``alert_text``, keep ids + text + label.

    Filter and projection are declarative, so the not-null predicate and the
    column list reach the parquet scan.
    """
    require_columns(raw, [target_col])
    labelled = raw.dropna(subset=[target_col])
    keep = [c for c in ID_COLUMNS if c in labelled.columns]
    return labelled.select(*keep, alert_text(labelled, feature_columns).alias("alert_text"),
                           F.col(target_col).alias("label"))


def online_alerts(raw: DataFrame, target_col: str = TARGET_COL, feature_columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Alerts as they arrive: ids, ``alert_text`` and the label where there is
    one (null, or the column missing, until an analyst has graded the alert)."""
    label = F.col(target_col) if target_col in raw.columns else F.lit(None).cast("string")
    keep = [c for c in ID_COLUMNS if c in raw.columns]
    return raw.select(*keep, alert_text(raw, feature_columns).alias("alert_text"), label.alias("label"))


def split_non_empty(df: DataFrame, text_col: str = "alert_text") -> tuple[DataFrame, DataFrame]:
    """Accepted / rejected rows by the strip-then-non-empty input check (null rejected)."""
    ok = is_non_empty(text_col)
    return df.where(ok), df.where(~ok)


def score_rules(df: DataFrame, text_col: str = "alert_text", pred_col: str = "predicted_label",
                keep_scores: bool = True) -> DataFrame:
    """Keyword scores (tp / benign / fp) and the rule decision, one projection."""
    low = R.lowered_text(text_col)
    tp, bn, fp = R.tp_score(low), R.benign_score(low), R.fp_score(low)
    scored = df.select("*", tp.alias("tp_score"), bn.alias("benign_score"), fp.alias("fp_score"))
    out = scored.withColumn(pred_col, R.rule_decision(F.col("tp_score"), F.col("fp_score")))
    return out if keep_scores else out.drop("tp_score", "benign_score", "fp_score")
