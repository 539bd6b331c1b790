"""Hybrid triage records, example cards and the responder hook.

The model call is an external service. What runs on Spark is the table work
around it: prompts out (``operators.prompts``), a responder hook that calls a
user function per prompt batch inside tasks (``respond``), materialised raw
answers, and parsing back in (``operators.answers``).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triageflow.operators import answers as A
from triageflow.session import materialize as _materialize

ANSWER_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("request_error", T.StringType()),
    T.StructField("latency_seconds", T.DoubleType()),
])


def hybrid_records(alerts: DataFrame, ml_pred_col: str, answers: DataFrame) -> DataFrame:
    """``hybrid_output``: ids, text, true label, ML label, ``is_correct`` (a null
    prediction counts as wrong), parsed guidance with coerced lists, raw answer,
    latency. Answers join on ``Id``; a missing answer is a request error."""
    j = A.attach_answers(alerts.withColumnRenamed("label", "true_label")
                               .withColumnRenamed(ml_pred_col, "ml_predicted_label"), answers)
    return _records(j)


def answered_records(answered: DataFrame) -> DataFrame:
    """:func:`hybrid_records` of alerts that already carry their answer: the output
    of :func:`respond` with ``keep=RECORD_COLUMNS``. No join."""
    return _records(answered)


#: What the records need from an alert, besides its answer.
RECORD_COLUMNS = ["IncidentId", "AlertId", "Timestamp", "alert_text", "true_label", "ml_predicted_label"]


def _records(answered: DataFrame) -> DataFrame:
    g = A.parse_guidance_answers(answered)
    return g.select(
        "Id", *RECORD_COLUMNS,
        F.coalesce(F.col("true_label") == F.col("ml_predicted_label"), F.lit(False)).alias("is_correct"),
        "analyst_summary", "risk_explanation", "mitre_interpretation", "recommended_actions",
        "containment_priority", F.col("raw_response").alias("raw_llm_response"),
        F.coalesce(F.col("latency_seconds"), F.lit(0.0)).alias("latency_seconds"), "status")


def example_cards(hybrid: DataFrame, n: int = 5, order_cols: list[str] | None = None) -> DataFrame:
    """First ``n`` hybrid rows (by ``order_cols``) rendered as Markdown blocks.

    The limit is the feature (a top-n report): ``orderBy().limit()`` plans as
    a distributed top-k (TakeOrderedAndProject); numbering runs on n rows.
    """
    order = [F.col(c) for c in (order_cols or ["Id"])]
    top = hybrid.orderBy(*order).limit(n)
    top = top.withColumn("example", F.row_number().over(Window.orderBy(*order)))
    card = F.concat(
        F.lit("## Example "), F.col("example").cast("string"), F.lit("\n\n"),
        F.lit("**True Label:** "), F.coalesce(F.col("true_label"), F.lit("")), F.lit("\n\n"),
        F.lit("**ML Prediction:** "), F.coalesce(F.col("ml_predicted_label"), F.lit("")), F.lit("\n\n"),
        F.lit("**Correct:** "), F.when(F.col("is_correct"), F.lit("True")).otherwise(F.lit("False")), F.lit("\n\n"),
        F.lit("**Alert Text:**\n\n`"), F.coalesce(F.col("alert_text"), F.lit("")), F.lit("`\n\n"),
        F.lit("**Analyst Summary:**\n\n"), F.coalesce(F.col("analyst_summary"), F.lit("")), F.lit("\n\n"),
        F.lit("**Risk Explanation:**\n\n"), F.coalesce(F.col("risk_explanation"), F.lit("")), F.lit("\n\n"),
        F.lit("**Recommended Actions:**\n\n"), F.to_json(F.col("recommended_actions")), F.lit("\n\n"),
        F.lit("---\n\n"))
    return top.select("example", "Id", card.alias("card"))


def respond(prompts: DataFrame, responder: Callable[[str], str], prompt_col: str = "prompt",
            id_col: str = "Id", concurrency: int | None = None, keep: list[str] | None = None,
            in_flight: int = 1, calls_per_second: float | None = None) -> DataFrame:
    """Responder hook: call ``responder(prompt)`` for every row inside the tasks.

    ``mapInArrow`` streams batches through the function; each call is
    timed on its own (without the wait for its turn); an exception is kept as
    ``request_error`` and the batch continues. ``keep`` columns ride along with
    their answer (no join back to the prompts).

    ``in_flight`` calls of a task overlap on threads: a waiting model service, not
    the CPU, takes the time. Each thread takes the next prompt of the batch, so at
    most that many calls are open, and answers keep the order of their prompts. The
    responder must allow calls from several threads when it is above 1.

    ``concurrency`` round-robins the prompts into that many tasks (no key: a
    repeated id cannot pile up in one), so ``concurrency * in_flight`` bounds the
    calls open at a time. ``calls_per_second`` bounds the rate of the whole job:
    each of the ``concurrency`` tasks starts its calls at least
    ``concurrency / calls_per_second`` apart, so it needs ``concurrency``.
    """
    if in_flight < 1:
        raise ValueError("in_flight must be at least 1")
    if calls_per_second is not None and not (concurrency and calls_per_second > 0):
        raise ValueError("calls_per_second must be positive and needs concurrency, the number of tasks that share it")
    keep = [c for c in (keep or []) if c not in (id_col, prompt_col)]
    src = prompts.select(F.col(id_col).cast("long").alias("Id"), F.col(prompt_col).alias("prompt"), *keep)
    if concurrency:
        src = src.repartition(concurrency)
    schema = T.StructType(ANSWER_SCHEMA.fields + [prompts.schema[c] for c in keep])
    apart = concurrency / calls_per_second if calls_per_second else 0.0

    def call(prompt: str) -> tuple[str | None, str | None, float]:
        t0 = time.monotonic()
        try:
            raw, error = responder(prompt), None
        except Exception as e:  # noqa: BLE001 - the error text is data
            raw, error = None, str(e)
        return raw, error, time.monotonic() - t0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, turn = Paced(apart), Lock()

        def work(prompts: Iterator[tuple[int, str]], answers: list) -> None:
            while True:
                with turn:
                    at, prompt = next(prompts, (None, None))
                    if at is None:
                        return
                    start.wait()
                answers[at] = call(prompt)

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                answers = [None] * batch.num_rows
                prompts = iter(enumerate(batch.column("prompt").to_pylist()))
                if in_flight == 1:  # one call after the other needs no thread of its own
                    work(prompts, answers)
                else:
                    for done in [pool.submit(work, prompts, answers) for _ in range(in_flight)]:
                        done.result()
                raw, error, latency = zip(*answers) if answers else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("Id"), pa.array(raw, pa.string()), pa.array(error, pa.string()), pa.array(latency, pa.float64()),
                     *(batch.column(c) for c in keep)], names=schema.names)

    return src.mapInArrow(run, schema)


class Paced:
    """Turns at least ``apart`` seconds apart."""

    def __init__(self, apart: float):
        self.apart, self.next = apart, 0.0

    def wait(self) -> None:
        if self.apart:
            now = time.monotonic()
            time.sleep(max(0.0, self.next - now))
            self.next = max(self.next, now) + self.apart


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Responder output is written once to the shared folder before parsing, so
    the external calls run exactly once and every downstream plan (filters,
    projections, retries after a lost executor) reads the stored answers."""
    return _materialize(spark, df, name)
