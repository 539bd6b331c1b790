"""Bulk model-answer parsing: stored raw answers -> typed prediction/guidance rows.

Each answer row carries ``raw_response`` and ``request_error`` (the text of a
failed call, else null). A missing answer row (after a left join from the
alerts) is a request error too. ``status`` is OK / PARSE_ERROR / REQUEST_ERROR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triageflow.constants import (HYBRID_DEFAULT_PRIORITY, HYBRID_PARSE_FALLBACK_SUMMARY, ID_COLUMNS, INVALID_LABEL,
                                  LABEL_ALIASES_NARROW, LABEL_ALIASES_WIDE, LABELS, PARSE_ERROR,
                                  REQUEST_ERROR, TRIAGE_PARSE_FALLBACK_SUMMARY,
                                  TRIAGE_REQUEST_FAILED_PREFIX)
from triageflow.functions import jsonparse as J
from triageflow.functions.labels import normalize_label
from triageflow.functions.text import let

NO_ANSWER_TEXT = "no answer stored for this alert"


def _status(raw: Column, error: Column, parsed: Column) -> Column:
    return (F.when(error.isNotNull() | raw.isNull(), F.lit(REQUEST_ERROR))
             .when(parsed.isNull(), F.lit(PARSE_ERROR))
             .otherwise(F.lit("OK")))


def _error_text(error: Column) -> Column:
    return F.coalesce(error, F.lit(NO_ANSWER_TEXT))


def parse_triage_answers(df: DataFrame, raw_col: str = "raw_response", error_col: str = "request_error",
                         greedy: bool = True, aliases: dict[str, str] = LABEL_ALIASES_WIDE,
                         labels: list[str] = LABELS, with_details: bool = True) -> DataFrame:
    """Label answers (zero-/few-shot profile; ``greedy=False`` + narrow aliases
    is the fine-tuned-model profile). Adds ``status``, raw and normalised label,
    and (``with_details``) confidence, reasoning summary and action list."""
    raw = F.col(raw_col)
    error = F.col(error_col) if error_col in df.columns else F.lit(None).cast("string")
    out = _with_parsed(df, raw, greedy)
    parsed = F.col("_parsed")
    out = out.withColumn("status", _status(raw, error, parsed))
    st = F.col("status")
    label_raw = let(F.struct(st.alias("s"), parsed.alias("p")), lambda x: (
        F.when(x["s"] == REQUEST_ERROR, F.lit(REQUEST_ERROR))
         .when(x["s"] == PARSE_ERROR, F.lit(PARSE_ERROR))
         .otherwise(F.coalesce(J.field_text(x["p"], "predicted_label"), F.lit(INVALID_LABEL)))))
    out = out.withColumn("llm_predicted_label_raw", label_raw)
    out = out.withColumn("llm_predicted_label", normalize_label(F.col("llm_predicted_label_raw"), aliases, labels))
    if with_details:
        ok = st == F.lit("OK")
        out = out.select(
            "*",
            F.when(ok, F.coalesce(J.field_double(parsed, "confidence"), F.lit(0.0))).otherwise(F.lit(0.0))
             .alias("llm_confidence"),
            F.when(ok, F.coalesce(J.field_text(parsed, "reasoning_summary"), F.lit("")))
             .when(st == PARSE_ERROR, F.lit(TRIAGE_PARSE_FALLBACK_SUMMARY))
             .otherwise(F.concat(F.lit(TRIAGE_REQUEST_FAILED_PREFIX), _error_text(error)))
             .alias("llm_reasoning_summary"),
            F.when(ok, J.field_list(parsed, "recommended_actions")).otherwise(F.array().cast("array<string>"))
             .alias("llm_recommended_actions"),
        )
    return out.withColumn(raw_col, F.coalesce(raw, error)).drop("_parsed")


def answer_labels(df: DataFrame, profiles: dict[str, tuple[bool, dict[str, str]]],
                  raw_col: str = "raw_response", error_col: str = "request_error") -> DataFrame:
    """Normalised labels of several answer profiles from one scan: ``profiles``
    maps output column -> (greedy, alias map). Adds one column per profile."""
    raw = F.col(raw_col)
    error = F.col(error_col) if error_col in df.columns else F.lit(None).cast("string")
    cols = []
    failed = error.isNotNull() | raw.isNull()
    for name, (greedy, aliases) in profiles.items():
        # a request error needs no parse; the parse result is bound once (the
        # status test and the field read share it)
        label_raw = F.when(failed, F.lit(REQUEST_ERROR)).otherwise(let(J.extract_answer(raw, greedy), lambda p: (
            F.when(p.isNull(), F.lit(PARSE_ERROR))
             .otherwise(F.coalesce(J.field_text(p, "predicted_label"), F.lit(INVALID_LABEL))))))
        cols.append(normalize_label(label_raw, aliases).alias(name))
    return df.select("*", *cols)


def parse_sft_answers(df: DataFrame, raw_col: str = "raw_response", error_col: str = "request_error") -> DataFrame:
    """Fine-tuned-model profile: non-greedy span, narrow alias map, label only."""
    return parse_triage_answers(df, raw_col, error_col, greedy=False, aliases=LABEL_ALIASES_NARROW,
                                with_details=False)


def parse_guidance_answers(df: DataFrame, raw_col: str = "raw_response", error_col: str = "request_error",
                           parse_fallback: str = HYBRID_PARSE_FALLBACK_SUMMARY) -> DataFrame:
    """Hybrid guidance profile: summary, risk, MITRE list, action list, priority."""
    raw = F.col(raw_col)
    error = F.col(error_col) if error_col in df.columns else F.lit(None).cast("string")
    out = _with_parsed(df, raw, greedy=True)
    parsed = F.col("_parsed")
    out = out.withColumn("status", _status(raw, error, parsed))
    ok = F.col("status") == F.lit("OK")
    perr = F.col("status") == F.lit(PARSE_ERROR)
    empty = F.array().cast("array<string>")
    out = out.select(
        "*",
        F.when(ok, F.coalesce(J.field_text(parsed, "analyst_summary"), F.lit("")))
         .when(perr, F.lit(parse_fallback))
         .otherwise(F.concat(F.lit(TRIAGE_REQUEST_FAILED_PREFIX), _error_text(error))).alias("analyst_summary"),
        F.when(ok, F.coalesce(J.field_text(parsed, "risk_explanation"), F.lit(""))).otherwise(F.lit(""))
         .alias("risk_explanation"),
        F.when(ok, J.field_list(parsed, "mitre_interpretation")).otherwise(empty).alias("mitre_interpretation"),
        F.when(ok, J.field_list(parsed, "recommended_actions")).otherwise(empty).alias("recommended_actions"),
        F.when(ok, F.coalesce(J.field_text(parsed, "containment_priority"), F.lit(HYBRID_DEFAULT_PRIORITY)))
         .otherwise(F.lit(HYBRID_DEFAULT_PRIORITY)).alias("containment_priority"),
    )
    return out.withColumn(raw_col, F.coalesce(raw, error)).drop("_parsed")


def pick_answers(answers: DataFrame, keys: list[str], latest_col: str | None = "answered_at",
                 raw_col: str = "raw_response", error_col: str = "request_error", greedy: bool = True) -> DataFrame:
    """One answer per key, of several the best: first one that parses, then one
    that does not, then a failed call; of those the latest by ``latest_col`` (where
    the table has it; no time counts as earliest), then the greatest text, then the
    greatest of the other columns.

    One grouped maximum: partial maxima meet in any order, so a key that holds a
    large share of the answers is reduced before the shuffle. Every answer is judged
    before; its columns are held once, with the place of its object in the text. The
    objects of the picked answers are ``_parsed``, where a later step asks for them."""
    raw = F.col(raw_col)
    failed = F.col(error_col).isNotNull() if error_col in answers.columns else F.lit(False)
    rest = [c for c in answers.columns if c not in keys]
    first = [c for c in (latest_col, raw_col) if c in rest]

    def order(text: Column) -> Column:
        rank = F.when(text.isNotNull(), 2).when(~failed & raw.isNotNull(), 1).otherwise(0)
        return F.struct(rank.alias("_rank"), *first, *(c for c in rest if c not in first),
                        F.instr(raw, text).alias("_at"), F.length(text).alias("_n"))

    best = answers.groupBy(*keys).agg(F.max(let(F.when(~failed, J.answer_text(raw, greedy)), order)).alias("_a"))
    found = F.substr(F.col("_a")[raw_col], F.col("_a._at"), F.col("_a._n"))
    return best.select(*keys, *[F.col("_a")[c].alias(c) for c in rest],
                       J.parsed_object(F.when(F.col("_a._rank") == 2, found)).alias("_parsed"))


def attach_answers(alerts: DataFrame, answers: DataFrame, id_col: str = "Id", greedy: bool = True,
                   latest_col: str | None = "answered_at") -> DataFrame:
    """Alerts LEFT JOIN stored answers on the id (never by position), and on the
    other id columns where both sides have them. Answers are first brought to
    one per key (:func:`pick_answers`), so every alert stays one row even
    if ids repeat; a null key has no answer. Both sides grow with the data: a merge
    join, as the planner takes the answers by the size of their compressed ids for
    small and would send millions of them through the driver. The result carries the parsed object
    (``_parsed``, by the ``greedy`` or the other span) for the parsers of this module."""
    keys = [id_col, *(c for c in ID_COLUMNS if c != id_col and c in alerts.columns and c in answers.columns)]
    return alerts.join(pick_answers(answers, keys, latest_col, greedy=greedy).hint("merge"), keys, "left")


def _with_parsed(df: DataFrame, raw: Column, greedy: bool) -> DataFrame:
    """``_parsed`` as :func:`attach_answers` left it, or parsed here."""
    return df if "_parsed" in df.columns else df.withColumn("_parsed", J.extract_answer(raw, greedy))


def with_field_dumps(df: DataFrame, fields: dict[str, str], raw_col: str = "raw_response", greedy: bool = True) -> DataFrame:
    """``df`` (parsed answers with ``status``) with each column of ``fields`` holding its
    answer field as JSON text, of whatever kind it is: what the batch jobs store in
    their CSV files, where the coerced lists are what the service returns. Rows
    without a parsed answer, or whose answer lacks the field, hold an empty list."""
    raw = F.when(F.col("status") == "OK", F.col(raw_col))
    # the text is told once, the object parsed from it
    told = let(J.answer_text(raw, greedy), lambda t: F.struct(J.parsed_object(t).alias("p"), t.alias("t")))
    both = df.withColumn("_answer", told)
    dumps = {c: J.field_dump(F.col("_answer.p"), F.col("_answer.t"), f) for c, f in fields.items()}
    return both.withColumns(dumps).drop("_answer")


def llm_prediction_table(alerts: DataFrame, answers: DataFrame, greedy: bool = True,
                         aliases: dict[str, str] = LABEL_ALIASES_WIDE) -> DataFrame:
    """The ``llm_prediction`` schema: ids, text, true label, raw/normalised label,
    confidence, summary, actions, raw response, latency."""
    j = attach_answers(alerts.withColumnRenamed("label", "true_label"), answers, greedy=greedy)
    p = parse_triage_answers(j, greedy=greedy, aliases=aliases)
    return p.select("Id", "IncidentId", "AlertId", "Timestamp", "alert_text", "true_label",
                    "llm_predicted_label_raw", "llm_predicted_label", "llm_confidence",
                    "llm_reasoning_summary", "llm_recommended_actions", "raw_response",
                    F.coalesce(F.col("latency_seconds"), F.lit(0.0)).alias("latency_seconds"), "status")
