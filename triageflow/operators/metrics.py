"""Multi-class classification metrics from one confusion-cell table.

Every metric starts from ``confusion_cells``: a single ``groupBy(model, true,
pred).count()`` over the prediction rows. That is the only pass over the big
input; with map-side partial aggregation each task emits at most
``models x labels^2`` rows, so a hot label or model cannot skew the shuffle.
Everything after it (per-class precision/recall/F1, macro and weighted means,
reports, comparisons) runs on that tiny table.

Semantics follow the multi-class convention with an explicit label list:
  precision_c = tp_c / #(pred = c)   (0 when no prediction is c)
  recall_c    = tp_c / #(true = c)   (0 when c has no support)
  f1_c        = 2 tp_c / (#pred_c + #true_c)   (0 when both are 0)
Predictions outside the list lower the recall of their true class and touch
no precision. Accuracy counts every row; invalid predictions are wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triageflow.constants import LABELS

MODEL = "model"
TRUE = "true_label"
PRED = "pred_label"


def long_predictions(df: DataFrame, true_col: str, pred_col: str, model: str | Column | None = None) -> DataFrame:
    """Melt one prediction column into ``(model, true_label, pred_label)``."""
    model_col = F.lit(model) if isinstance(model, str) else (model if model is not None else F.lit("model"))
    return df.select(model_col.alias(MODEL), F.col(true_col).alias(TRUE), F.col(pred_col).alias(PRED))


def melt_predictions(df: DataFrame, true_col: str, pred_cols: dict[str, str]) -> DataFrame:
    """Several prediction columns of one table -> long form in a single scan.

    ``pred_cols`` maps model name -> column. Uses ``explode`` of an array of
    structs, so the table is read once for all models.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias(MODEL), F.col(c).cast("string").alias(PRED))
                      for m, c in pred_cols.items()])
    return (df.select(F.col(true_col).alias(TRUE), F.explode(pairs).alias("_p"))
              .select(F.col("_p." + MODEL).alias(MODEL), F.col(TRUE), F.col("_p." + PRED).alias(PRED)))


def confusion_cells(long_df: DataFrame) -> DataFrame:
    """``(model, true_label, pred_label, n)`` for the cells that occur."""
    return long_df.groupBy(MODEL, TRUE, PRED).agg(F.count(F.lit(1)).alias("n"))


def valid_prediction_cells(cells: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Cells restricted to rows whose prediction is a valid label.

    Expressed as a projection (counts of invalid predictions become 0), not a
    row filter: a filter on the predicted label would be pushed below the
    projection that parses the answers and make Catalyst evaluate the whole
    parse chain twice (once in the filter, once in the projection).
    """
    valid = F.coalesce(F.col(PRED).isin(labels), F.lit(False))
    return cells.withColumn("n", F.when(valid, F.col("n")).otherwise(F.lit(0)).cast("long"))


def confusion_matrix_long(cells: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Every ``labels x labels`` cell per model, zero cells included.

    Cells with either side outside ``labels`` are dropped. A model's observed
    cells (at most one per grid cell) and a zero for every grid cell are summed
    by place, so the work is the grid plus the cells, and ``cells`` is read by a
    single chain.
    """
    k = len(labels)
    at = lambda c: F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)) - 1
    listed = F.coalesce(F.col(TRUE).isin(labels) & F.col(PRED).isin(labels), F.lit(False))
    seen = F.collect_list(F.when(listed, F.struct((at(TRUE) * k + at(PRED)).cast("int").alias("cell_order"), F.col("n").cast("long").alias("n"))))
    zeros = F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda i: F.struct(i.alias("cell_order"), F.lit(0).cast("long").alias("n")))
    grid = (cells.groupBy(MODEL).agg(seen.alias("_s")).select(MODEL, F.explode(F.concat("_s", zeros)).alias("_g"))
                 .groupBy(MODEL, F.col("_g.cell_order").alias("cell_order")).agg(F.sum("_g.n").alias("n")))
    name = lambda i: F.get(F.array(*[F.lit(x) for x in labels]), i.cast("int"))
    return grid.select(MODEL, name(F.floor(F.col("cell_order") / k)).alias(TRUE), name(F.col("cell_order") % k).alias(PRED), "n", "cell_order")


def confusion_matrix_wide(cells: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Rows = true label, one column per predicted label (in list order), zeros filled."""
    long_m = confusion_matrix_long(cells, labels)
    wide = long_m.groupBy(MODEL, TRUE).pivot(PRED, labels).agg(F.sum("n"))
    return wide.fillna(0, subset=labels)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _prf(tp: Column, n_pred: Column, support: Column) -> list[Column]:
    return [_ratio(tp, n_pred).alias("precision"), _ratio(tp, support).alias("recall"),
            _ratio(tp * 2, n_pred + support).alias("f1")]


def per_class(cells: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``(model, label, label_order, tp, n_pred, support, precision, recall, f1,
    n_rows, n_correct, n_out_of_list)``; the last three are per-model totals.

    Each cell contributes (a) to its true label: tp, support, row totals;
    (b) to its predicted label: n_pred; (c) a zero row to every listed label so
    labels without rows still appear. One group-by, then a per-model window
    for the totals: ``cells`` is consumed by a single chain.
    """
    t, p, n = F.col(TRUE), F.col(PRED), F.col("n")
    zero = F.lit(0).cast("long")
    in_list = F.coalesce(t.isin(labels) & p.isin(labels), F.lit(False))
    hit = F.coalesce(t == p, F.lit(False))

    def part(label, tp, n_pred, support, rows, correct, out):
        return F.struct(label.alias("label"), tp.cast("long").alias("tp"), n_pred.cast("long").alias("n_pred"),
                        support.cast("long").alias("support"), rows.cast("long").alias("rows"),
                        correct.cast("long").alias("correct"), out.cast("long").alias("out"))

    parts = [part(t, F.when(hit, n).otherwise(zero), zero, n, n, F.when(hit, n).otherwise(zero),
                  F.when(in_list, zero).otherwise(n)),
             part(p, zero, n, zero, zero, zero, zero)]
    parts += [part(F.lit(x), zero, zero, zero, zero, zero, zero) for x in labels]
    sums = (cells.select(MODEL, F.explode(F.array(*parts)).alias("_c"))
                 .groupBy(MODEL, F.col("_c.label").alias("label"))
                 .agg(*[F.sum("_c." + c).alias(c) for c in ["tp", "n_pred", "support", "rows", "correct", "out"]]))
    w = Window.partitionBy(MODEL)
    order = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    with_tot = sums.select(
        "*", F.sum("rows").over(w).alias("n_rows"), F.sum("correct").over(w).alias("n_correct"),
        F.sum("out").over(w).alias("n_out_of_list"))
    return (with_tot.where(F.col("label").isin(labels))
                    .select(MODEL, "label", order[F.col("label")].alias("label_order"), "tp", "n_pred", "support",
                            *_prf(F.col("tp"), F.col("n_pred"), F.col("support")),
                            "n_rows", "n_correct", "n_out_of_list"))


def _model_aggregates(pc: DataFrame) -> list[Column]:
    sup = F.col("support").cast("double")
    return [
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("precision") * sup).alias("_wp"), F.sum(F.col("recall") * sup).alias("_wr"),
        F.sum(F.col("f1") * sup).alias("_wf"), F.sum(sup).alias("_sup"),
        F.sum("tp").alias("_stp"), F.sum("n_pred").alias("_spred"),
        F.first("n_rows").alias("n_rows"), F.first("n_correct").alias("n_correct"),
        F.first("n_out_of_list").alias("n_out_of_list"),
    ]


def _weighted(name: str) -> Column:
    return F.when(F.col("_sup") > 0, F.col(name) / F.col("_sup")).otherwise(F.lit(0.0))


def model_summary(cells: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """One row per model: accuracy, macro P/R/F1, weighted P/R/F1 (full precision)."""
    agg = per_class(cells, labels).groupBy(MODEL).agg(*_model_aggregates(None))
    return agg.select(
        MODEL, _ratio(F.col("n_correct"), F.col("n_rows")).alias("accuracy"),
        "macro_precision", "macro_recall", "macro_f1",
        _weighted("_wp").alias("weighted_precision"), _weighted("_wr").alias("weighted_recall"),
        _weighted("_wf").alias("weighted_f1"), "n_rows")


def classification_report(cells: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Long-form report: one row per class, then ``accuracy`` (or ``micro avg`` when
    some row falls outside ``labels``), ``macro avg`` and ``weighted avg``.

    Columns ``(model, row_order, row_name, precision, recall, f1, support)``;
    the ``accuracy`` row carries only f1 (= accuracy) and the total support.
    Per-class rows ride along the per-model aggregate as a list of at most
    ``len(labels)`` structs, so the whole report is one chain.
    """
    k = len(labels)
    row = lambda order, name, pr, rc, f1, sup: F.struct(
        F.lit(order).alias("row_order") if isinstance(order, int) else order.alias("row_order"),
        (F.lit(name) if isinstance(name, str) else name).alias("row_name"),
        pr.cast("double").alias("precision"), rc.cast("double").alias("recall"), f1.cast("double").alias("f1"),
        sup.cast("long").alias("support"))
    pc = per_class(cells, labels)
    class_row = row(F.col("label_order"), F.col("label"), F.col("precision"), F.col("recall"), F.col("f1"),
                    F.col("support"))
    agg = pc.groupBy(MODEL).agg(F.collect_list(class_row).alias("_rows"), *_model_aggregates(None))
    is_acc = F.col("n_out_of_list") == 0
    null = F.lit(None).cast("double")
    micro = row(k, F.when(is_acc, F.lit("accuracy")).otherwise(F.lit("micro avg")),
                F.when(is_acc, null).otherwise(_ratio(F.col("_stp"), F.col("_spred"))),
                F.when(is_acc, null).otherwise(_ratio(F.col("_stp"), F.col("_sup"))),
                F.when(is_acc, _ratio(F.col("n_correct"), F.col("n_rows")))
                 .otherwise(_ratio(F.col("_stp") * 2, F.col("_spred") + F.col("_sup"))),
                F.when(is_acc, F.col("n_rows")).otherwise(F.col("_sup")))
    macro = row(k + 1, "macro avg", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1"),
                F.col("_sup"))
    weighted = row(k + 2, "weighted avg", _weighted("_wp"), _weighted("_wr"), _weighted("_wf"), F.col("_sup"))
    rows = F.concat(F.col("_rows"), F.array(micro, macro, weighted))
    return agg.select(MODEL, F.explode(rows).alias("_r")).select(
        MODEL, "_r.row_order", "_r.row_name", "_r.precision", "_r.recall", "_r.f1", "_r.support")


def model_comparison(cells: DataFrame, roles: dict[str, str] | None = None,
                     labels: list[str] = LABELS, digits: int = 4) -> DataFrame:
    """Comparison table: model, role, accuracy, macro P/R/F1, weighted F1, rounded."""
    s = model_summary(cells, labels)
    role = (F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[F.col(MODEL)] if roles
            else F.lit(None).cast("string"))
    return s.select(MODEL, role.alias("role"), *[F.round(c, digits).alias(c) for c in
                                                 ["accuracy", "macro_precision", "macro_recall", "macro_f1",
                                                  "weighted_f1"]])


def label_distribution(df: DataFrame, col: str) -> DataFrame:
    """Value counts: nulls excluded; ``rank`` = descending count, ties by value.

    Meant for class columns (A2 over labels): the rank window runs over the
    count table, one row per distinct value, after the partially aggregated
    group-by, so its size is the label domain, not the input."""
    from pyspark.sql import Window
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    # The count table has one row per distinct value (small); ranking it needs no big sort.
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), F.col(col))))


def distinct_values(df: DataFrame, col: str, max_values: int = 10000) -> list:
    """Sorted distinct non-null values of a low-cardinality column (like pivot's value
    discovery), with a hard cap so an unbounded column fails fast instead of
    flooding the driver."""
    rows = (df.where(F.col(col).isNotNull()).select(col).distinct()
              .orderBy(col).limit(max_values + 1).collect())
    if len(rows) > max_values:
        raise ValueError(f"column {col!r} has more than {max_values} distinct values")
    return [r[0] for r in rows]


def validity_summary(df: DataFrame, true_col: str, pred_col: str, labels: list[str] = LABELS,
                     extra: list[Column] | None = None) -> DataFrame:
    """One row: total, valid, invalid, strict accuracy, accuracy on valid rows (null if none).
    ``extra`` aggregates (aliased) ride along in the same single pass."""
    valid = F.coalesce(F.col(pred_col).isin(labels), F.lit(False))
    correct = F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False))
    extra = extra or []
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(valid.cast("long")).alias("valid"),
        F.sum(correct.cast("long")).alias("correct"),
        F.sum((valid & correct).cast("long")).alias("valid_correct"),
        *extra,
    )
    return agg.select(
        "total",
        F.coalesce(F.col("valid"), F.lit(0)).alias("valid"),
        (F.col("total") - F.coalesce(F.col("valid"), F.lit(0))).alias("invalid"),
        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).alias("strict_accuracy"),
        F.when(F.col("valid") > 0, F.col("valid_correct") / F.col("valid")).alias("valid_accuracy"),
        *[F.col(c) for c in agg.columns[4:]],
    )
