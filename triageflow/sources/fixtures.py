"""Reference-shaped inputs derived from the driver tables.

The reference reads a labelled alert CSV and stored LLM answers, neither of
which ships. These builders derive the same shapes from ``orders``,
``customer`` and ``nation`` so that every job runs over whole tables and its
work grows with them. Each builder has a DuckDB twin in ``plans.oracle``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triageflow.sources.tables import read_table


def _case(col: Column, mapping: list[tuple], default=None) -> Column:
    expr = None
    for key, value in mapping:
        cond = col == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _grade() -> Column:
    grade = _case(F.col("o_orderstatus"), [("F", "TruePositive"), ("O", "FalsePositive")], "BenignPositive")
    return F.when(F.col("o_orderkey") % 50 != 49, grade)


def alert_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(Id, IncidentGrade)`` of every raw alert. The grade depends on ``orders``
    alone and the joins of :func:`raw_alerts` go to unique keys (one alert per
    order), so label reports scan two columns and join nothing."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    return o.select(F.col("o_orderkey").alias("Id"), _grade().alias("IncidentGrade"))


def raw_alerts(spark: SparkSession, sf_dir: str, first_n: int | None = None,
               labelled_only: bool = False) -> DataFrame:
    """``raw_alert`` shape: orders LEFT JOIN customer LEFT JOIN nation.

    ``customer`` grows with the data, so its join strategy is left to the
    planner (size statistics + AQE). ``nation`` is the fixed 25-row TPC-H
    dimension, a proven bound, so it is broadcast explicitly.

    ``first_n`` (bounded scan): only the ``first_n`` orders by key enter the
    joins. Every order yields at least one row of a left join, so the first
    ``first_n`` rows by ``Id`` of the full result come from those orders; the
    caller's ordered limit then gives exactly the same rows, without joining
    the whole table (Catalyst does not push a sort + limit below a join).
    ``labelled_only`` drops unlabelled orders first (the grade depends on
    ``orders`` alone), so ``first_n`` then counts labelled alerts.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                               "o_orderdate", "o_orderpriority"], spread=first_n is None)
    key = F.col("o_orderkey")
    o = o.withColumn("_grade", _grade())
    if labelled_only:
        o = o.where(F.col("_grade").isNotNull())
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    if first_n is not None:
        o = o.orderBy("o_orderkey").limit(first_n)  # distributed top-k: <= first_n rows per task
        # customer is probed against the <= first_n keys (broadcast, bounded by
        # first_n) instead of being shuffled whole into a join with them
        keys = o.select(F.col("o_custkey").alias("c_custkey")).distinct()
        c = c.join(F.broadcast(keys), "c_custkey", "left_semi")
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    cust = F.col("o_custkey")
    return j.select(
        key.alias("Id"),
        cust.alias("IncidentId"),
        (key % 1000).alias("AlertId"),
        F.col("o_orderdate").cast("string").alias("Timestamp"),
        _case(F.col("o_orderpriority"), [("1-URGENT", "CredentialAccess"), ("2-HIGH", "Exfiltration"),
                                         ("3-MEDIUM", "InitialAccess"), ("4-NOT SPECIFIED", "Discovery")],
              "Execution").alias("Category"),
        _case(cust % 4, [(1, "T1110;T1078"), (2, "T1566"), (3, "T1059.005;T1021")]).alias("MitreTechniques"),
        _case(F.col("c_mktsegment"), [("AUTOMOBILE", "User"), ("BUILDING", "Url"), ("FURNITURE", "Ip"),
                                      ("HOUSEHOLD", "Mailbox")], "File").alias("EntityType"),
        F.when(key % 2 == 0, "Impacted").otherwise("Related").alias("EvidenceRole"),
        (key % 97).alias("DetectorId"),
        (cust % 53).alias("AlertTitle"),
        F.when(F.col("o_totalprice") > 400000, "Suspicious").alias("SuspicionLevel"),
        _case(key % 5, [(0, "Malicious"), (1, "Clean"), (2, "Suspicious")]).alias("LastVerdict"),
        F.col("c_nationkey").alias("CountryCode"),
        F.col("n_regionkey").alias("State"),
        (cust % 101).alias("City"),
        (key % 6).alias("OSFamily"),
        (key % 67).alias("OSVersion"),
        F.col("_grade").alias("IncidentGrade"),
    )


# ---------------------------------------------------------------------------
# FIXED VALUES: stored model answers, one shape per remainder of Id % 12.
# Shapes cover strict JSON, prose around JSON, code fences, aliases, two
# objects, no JSON, a JSON array, nested objects, missing key, bad alias.
# ---------------------------------------------------------------------------
TRIAGE_ANSWER_SHAPES = [
    '{"predicted_label": "TruePositive", "confidence": 0.9, "reasoning_summary": "r", "recommended_actions": ["a", "b"]}',
    'Sure. {"predicted_label": "FalsePositive", "confidence": 0.5} Done.',
    '```json\n{"predicted_label":\n"BenignPositive"}\n```',
    '{"predicted_label": " true positive "}',
    '{"predicted_label": "Benign_Positive"}',
    '{"predicted_label": "malicious"}',
    'A {"predicted_label": "FalsePositive"} B {"predicted_label": "TruePositive"}',
    'I cannot answer.',
    '[1, 2]',
    'x {"predicted_label": "TruePositive", "meta": {"a": 1}} y',
    '{"confidence": "0.1"}',
    '{"predicted_label": "true-positive"}',
]

# Hybrid guidance answers by Id % 4: actions as list / plain string / blank / absent.
HYBRID_ANSWER_SHAPES = [
    '{"analyst_summary": "s", "risk_explanation": "r", "mitre_interpretation": ["T1110"], '
    '"recommended_actions": ["isolate host", "reset credentials"], "containment_priority": "High"}',
    'Here you go: {"analyst_summary": "s2", "mitre_interpretation": "T1566", '
    '"recommended_actions": "block sender", "containment_priority": "Medium"}',
    '{"analyst_summary": "s3", "risk_explanation": "", "recommended_actions": "   ", "mitre_interpretation": []}',
    'no json here',
]
# Actions of every JSON kind, by Id % 12: lists, text, numbers, boolean, null,
# objects, non-ASCII characters; the last answer has no actions.
ACTION_VALUES = [
    ["isolate host", "reset credentials"], "close alert, keep: watching", 3, 2.5, True, None,
    {"step": "block", "after": ["review", {"owner": "Zoë"}]}, ["prüfen", "日本", "ok 👍"], [], "", ["tab\t", "quote \"q\"", "back\\slash", "line\n"],
]
DUMP_ANSWER_SHAPES = [
    ("Here you go: " if i % 4 == 3 else "") + json.dumps({"analyst_summary": "s", "recommended_actions": v}, ensure_ascii=i % 2 == 0)
    for i, v in enumerate(ACTION_VALUES)] + ['{"analyst_summary": "s"}']
# Answers of Id % 13 == 12 carry a request error instead of a response.
REQUEST_ERROR_TEXT = "connection refused"


def _pick(key: Column, shapes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in shapes]), (key % len(shapes) + 1).cast("int"))


def triage_answers(spark: SparkSession, sf_dir: str, shift: int = 0, orders: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """Stored triage answers ``(Id, raw_response, request_error, latency_seconds)``.

    ``shift`` rotates the shapes so a second model's answers differ. ``orders`` may
    be given, with columns to ``keep``.
    """
    o = orders if orders is not None else read_table(spark, sf_dir, "orders", ["o_orderkey"], spread=True)
    key = F.col("o_orderkey") + F.lit(shift)
    failed = F.col("o_orderkey") % 13 == 12
    return o.select(
        F.col("o_orderkey").alias("Id"),
        F.when(~failed, _pick(key, TRIAGE_ANSWER_SHAPES)).alias("raw_response"),
        F.when(failed, F.lit(REQUEST_ERROR_TEXT)).alias("request_error"),
        (F.lit(0.5) + (F.col("o_orderkey") % 40) / F.lit(10.0)).alias("latency_seconds"),
        *(keep or []),
    )


def online_requests(alerts: DataFrame) -> DataFrame:
    """What clients post: the text of an alert, with white space around it, empty,
    blank or missing by ``Id % 9``."""
    text = F.concat(F.lit(" \n"), F.col("alert_text"), F.lit("\t "))
    kind = F.col("Id") % 9
    return alerts.select("Id", F.when(kind == 2, "").when(kind == 5, " \t\n ").when(kind != 7, text).alias("alert_text"))


def repeated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage answers of incidents: every order of a customer gave one answer to
    the same id (``Id = o_custkey``), good, unparsable or failed, at its own time."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"], spread=True)
    a = triage_answers(spark, sf_dir, orders=o.withColumns({"incident": F.col("o_custkey"), "answered_at": F.col("o_orderdate").cast("string")}),
                       keep=["incident", "answered_at"])
    return a.drop("Id").withColumnRenamed("incident", "Id")


def hybrid_answers(spark: SparkSession, sf_dir: str, shapes: list[str] = HYBRID_ANSWER_SHAPES) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey"], spread=True)
    key = F.col("o_orderkey")
    failed = key % 13 == 12
    return o.select(
        key.alias("Id"),
        F.when(~failed, _pick(key, shapes)).alias("raw_response"),
        F.when(failed, F.lit(REQUEST_ERROR_TEXT)).alias("request_error"),
        (F.lit(0.5) + (key % 40) / F.lit(10.0)).alias("latency_seconds"),
    )
