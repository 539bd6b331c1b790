"""Corpus pipeline: documents to token ids, stage by stage.

Every stage reads what its predecessor wrote and calls one operator of
``triageflow.llm`` over all of it. ``run`` applies the stages to the documents
table, with each result stored under the shared checkpoint folder.

All stages: null and repeated ids and repeated rows stay rows of their own (but in
``near_dedup``, where equal texts are one class); a null text counts as empty; ties as
the operator breaks them; a text of any length is worked through whole; an empty table gives
an empty result. All but the last return the columns they got, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from triageflow.llm import bpe, decontaminate, langid, pii, simhash
from triageflow.llm.common import free_name, stored
from triageflow.sources.tables import table_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language, that is all with a letter: the
    score of a short text is small however clear its language."""
    model = langid.fit(docs.where(~langid.held_out()))
    name = free_name(docs, "_language")
    judged = docs.withColumn(name, langid.language(spark, model)("text"))
    return judged.where(F.col(name)["lang_pred"] != langid.UNKNOWN).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash class: the one of the smallest id."""
    return simhash.first_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminated(spark, docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the kind of personal data in place of each span; n_chars follows."""
    name = free_name(docs, "_pii")
    clean = docs.withColumn(name, pii.redacted(spark, pii.fit(docs))("text"))
    return clean.withColumn("text", F.col(name)["text"]).withColumn("n_chars", F.length("text").cast("bigint")).drop(name)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of what they decode to."""
    coded = docs.select("doc_id", "lang", "source", bpe.bpe_encode(spark)("text").alias("coded"))
    return coded.select("doc_id", "lang", "source", F.size("coded.ids").cast("bigint").alias("n_tokens"), F.col("coded.ids").alias("ids"),
                        F.sha2(F.col("coded.decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokenised", tokenised),
]

#: The stages rest on a trained kernel machine, a BiLSTM-CRF and 64-bit xxHash
#: majorities, which SQL cannot express; tests/llm/ holds brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs
