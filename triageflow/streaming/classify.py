"""Structured Streaming scoring jobs (the online path, re-aimed as streams).

R1 ``stream_rule_predictions``: a file-source stream of raw alert files ->
non-empty check -> alert text -> rule scores -> Parquet sink with a
checkpoint. Stateless and append-only, so no watermark is needed; with
``trigger(availableNow=True)`` it drains what is there and stops, and a
restart resumes from the checkpoint (exactly-once file sink).

R2 ``stream_triage``: ``foreachBatch`` runs the hybrid triage per
micro-batch (prompt -> responder hook -> guidance parse) and overwrites the
batch's own ``batch_id`` partition, so a replayed batch rewrites the same
output instead of duplicating it.

``run_request_stream`` is the service's whole path: requests (id and text), stripped;
empty ones go to a sink of their own with the reason, the others are labelled by the
loaded classifier and triaged. Both sinks are written from one micro-batch, each
under its batch id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triageflow.constants import HYBRID_TEMPLATE_SERVICE, SERVICE_PARSE_FALLBACK_SUMMARY
from triageflow.functions.text import py_strip
from triageflow.operators import answers as A
from triageflow.operators import features as feat
from triageflow.operators import hybrid as H
from triageflow.operators import prompts as P
from triageflow.operators import textml as TM
from triageflow.session import checkpoint_root

RAW_ALERT_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType()), T.StructField("IncidentId", T.LongType()),
    T.StructField("AlertId", T.LongType()), T.StructField("Timestamp", T.StringType()),
    T.StructField("Category", T.StringType()), T.StructField("MitreTechniques", T.StringType()),
    T.StructField("EntityType", T.StringType()), T.StructField("EvidenceRole", T.StringType()),
    T.StructField("DetectorId", T.LongType()), T.StructField("AlertTitle", T.LongType()),
    T.StructField("SuspicionLevel", T.StringType()), T.StructField("LastVerdict", T.StringType()),
    T.StructField("CountryCode", T.IntegerType()), T.StructField("State", T.IntegerType()),
    T.StructField("City", T.LongType()), T.StructField("OSFamily", T.LongType()),
    T.StructField("OSVersion", T.LongType()), T.StructField("IncidentGrade", T.StringType()),
])


#: Parts of a micro-batch for each core.
BATCH_PARTS_PER_CORE = 4


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def alert_stream(spark: SparkSession, path: str, schema: T.StructType = RAW_ALERT_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def spread(batch: DataFrame) -> DataFrame:
    """A micro-batch over all cores: its files are few, and as many tasks would do
    all of its work. Rows only move; the parts are handed to tasks one by one."""
    return batch.repartition(BATCH_PARTS_PER_CORE * batch.sparkSession.sparkContext.defaultParallelism)


def classify(raw: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Per-row scoring shared by batch and stream: every alert, graded or not
    -> text -> non-empty check -> label of the trained ``model`` (loaded by the
    caller), or the rule scores and label without one."""
    accepted, _ = feat.split_non_empty(feat.online_alerts(raw))
    return TM.predict(model, accepted) if model is not None else feat.score_rules(accepted)


def run_rule_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                    max_files_per_trigger: int | None = 1, timeout_s: float | None = None) -> None:
    """Drain ``source_dir`` into ``sink_dir`` (Parquet, append) and stop."""
    scored = classify(spread(alert_stream(spark, source_dir, max_files_per_trigger=max_files_per_trigger)))
    query = (scored.writeStream.format("parquet").option("path", sink_dir)
             .option("checkpointLocation", checkpoint_dir).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def stage_files(df: DataFrame, path: str, n_files: int) -> str:
    """Write ``df`` as ``n_files`` Parquet files (an arriving-files source)."""
    df.repartition(n_files).write.mode("overwrite").parquet(path)
    return path


def triage_batch(batch: DataFrame, batch_id: int, responder: Callable[[str], str], out_dir: str,
                 ml_pred_col: str = "predicted_label") -> None:
    """One micro-batch of the triage service: prompt -> responder -> parsed
    ``triage_response`` rows, written to ``out_dir/batch_id=<id>``."""
    spark = batch.sparkSession
    prompts = batch.select("Id", "alert_text", F.col(ml_pred_col).alias("ml_predicted_label"),
                           P.hybrid_prompt("alert_text", ml_pred_col, HYBRID_TEMPLATE_SERVICE).alias("prompt"))
    # the batch's text and ML label ride along with each answer: no join back
    answers = H.materialize(spark, H.respond(prompts, responder, keep=["alert_text", "ml_predicted_label"]),
                            f"answers-batch{batch_id}")
    parsed = A.parse_guidance_answers(answers, parse_fallback=SERVICE_PARSE_FALLBACK_SUMMARY)
    out = parsed.select("Id", "alert_text", "ml_predicted_label", "analyst_summary", "risk_explanation",
                        "mitre_interpretation", "recommended_actions", "containment_priority",
                        F.col("raw_response").alias("raw_llm_response"), "latency_seconds", "status")
    out.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")


REQUEST_SCHEMA = T.StructType([T.StructField("Id", T.LongType()), T.StructField("alert_text", T.StringType())])
EMPTY_REASON = "alert_text cannot be empty"


def request_batch(batch: DataFrame, batch_id: int, responder: Callable[[str], str], out_dir: str, rejected_dir: str,
                  model: PipelineModel | None = None) -> None:
    """One micro-batch of requests into both sinks. The batch is kept for the two
    passes; a replay of the same batch overwrites both of its folders."""
    batch = batch.withColumn("alert_text", py_strip("alert_text")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        accepted, rejected = feat.split_non_empty(batch)
        rejected.select("*", F.lit(EMPTY_REASON).alias("reason")).write.mode("overwrite").parquet(f"{rejected_dir}/batch_id={batch_id}")
        scored = TM.predict(model, accepted) if model is not None else feat.score_rules(accepted)
        triage_batch(scored, batch_id, responder, out_dir)
    finally:
        batch.unpersist()


def run_request_stream(spark: SparkSession, source_dir: str, out_dir: str, rejected_dir: str, checkpoint_dir: str,
                       responder: Callable[[str], str], model: PipelineModel | None = None,
                       max_files_per_trigger: int | None = 1, timeout_s: float | None = None) -> None:
    """Drain the requests of ``source_dir`` into ``out_dir`` and ``rejected_dir``."""
    requests = spread(alert_stream(spark, source_dir, REQUEST_SCHEMA, max_files_per_trigger))
    query = (requests.writeStream.option("checkpointLocation", checkpoint_dir)
             .foreachBatch(lambda b, i: request_batch(b, i, responder, out_dir, rejected_dir, model))
             .trigger(availableNow=True).start())
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_triage_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                      responder: Callable[[str], str], max_files_per_trigger: int | None = 1,
                      timeout_s: float | None = None, model: PipelineModel | None = None) -> None:
    scored = classify(spread(alert_stream(spark, source_dir, max_files_per_trigger=max_files_per_trigger)), model)
    query = (scored.writeStream.option("checkpointLocation", checkpoint_dir)
             .foreachBatch(lambda b, i: triage_batch(b, i, responder, out_dir))
             .trigger(availableNow=True).start())
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
