"""End-to-end jobs composed from the operators (the reference's numbered steps).

E1 corpus preparation: ``processed_alerts`` -> ``corpus_split`` -> ``eval_subset``
-> ``sft_corpus``. E2 train/compare and E3 answer jobs live in their operator
modules and are wired here.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triageflow.constants import (EVAL_SUBSET_SIZE, LR_C, LR_MAX_ITER, RANDOM_STATE, SFT_MAX_TRAIN_ROWS, SFT_VAL_SIZE,
                                  TEST_FRACTION, TFIDF_MAX_FEATURES, TFIDF_MIN_DF)
from triageflow.operators import features as feat
from triageflow.operators import modelstore as MS
from triageflow.operators import prompts as P
from triageflow.operators import sampling as S
from triageflow.operators import textml as TM
from triageflow.session import checkpoint_root, configure, materialize
from triageflow.sources import fixtures
from triageflow.sources import io as IO


def processed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return feat.preprocess_alerts(fixtures.raw_alerts(spark, sf_dir))


def alert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(Id, label)`` of the processed alerts from the two columns behind them: what
    the sampler's key passes need, without the joins and the text."""
    grades = fixtures.alert_grades(spark, sf_dir).withColumnRenamed("IncidentGrade", "label")
    return grades.where(F.col("label").isNotNull())


def corpus_split(alerts: DataFrame, test_size: float = TEST_FRACTION, seed: int = RANDOM_STATE,
                 keys: DataFrame | None = None) -> DataFrame:
    """All processed alerts with ``split`` in {train, test}."""
    return S.stratified_split(alerts, "label", test_size, id_col="Id", seed=seed, salt="split", keys=keys)


def stored_split(spark: SparkSession, sf_dir: str, test_size: float = TEST_FRACTION,
                 seed: int = RANDOM_STATE) -> DataFrame:
    """E1 output, written once (Parquet, shared folder): the split corpus that every
    later step (subset, SFT corpus, training) scans. The thresholds come from ids
    and labels alone; the joins and the text assembly run in the writing pass only."""
    # one directory per split value: readers of one side (the test split for the
    # evaluation subset, the train split for training) prune the other at planning
    split = corpus_split(processed_alerts(spark, sf_dir), test_size, seed, alert_keys(spark, sf_dir))
    return materialize(spark, split, "split-corpus", partition_by=["split"])


CLASSIFIER_PARAMS = {"max_features": TFIDF_MAX_FEATURES, "min_df": TFIDF_MIN_DF, "c": LR_C, "max_iter": LR_MAX_ITER}
KEPT_MODELS = 8


def saved_classifier(split_df: DataFrame) -> PipelineModel:
    """The classifier of the train split, loaded from the model store;
    the first job that asks for these rows and parameters fits and saves it, all
    others (scoring, comparison, hybrid records, stream) share that fit."""
    spark = split_df.sparkSession
    train = split_df.where(F.col("split") == "train")
    store = MS.ModelStore(spark, "tfidf-lr")
    key = MS.fingerprint(train, ["alert_text", "label"], **CLASSIFIER_PARAMS)
    if not store.has(key):
        store.prune(KEPT_MODELS - 1)
    return store.load_or_fit(key, lambda: TM.fit_tfidf_lr(train, **CLASSIFIER_PARAMS))


def eval_subset(split_df: DataFrame, size: int = EVAL_SUBSET_SIZE, seed: int = RANDOM_STATE) -> DataFrame:
    """T3 over the test split: the shared balanced evaluation subset, with its
    shuffle key (T4) for sinks that need the shuffled order."""
    test = split_df.where(F.col("split") == "test").drop("split")
    sub = S.balanced_sample(test, "label", size, id_col="Id", seed=seed, salt="subset")
    # stored once (<= size rows, like the reference's subset file): the SFT
    # anti join, the SFT test part and the subset scoring read it instead of
    # each re-running the selection pass over the test split
    return materialize(split_df.sparkSession, S.with_shuffle_key(sub, "Id", seed, salt="subset-shuffle"),
                       "eval-subset")


def sft_corpus(split_df: DataFrame, eval_df: DataFrame, max_train_rows: int = SFT_MAX_TRAIN_ROWS,
               val_size: int = SFT_VAL_SIZE, seed: int = RANDOM_STATE) -> DataFrame:
    """Train split minus evaluation ids (J1) -> balanced sample (T3) ->
    stratified train/val split of ``val_size`` rows (T2); the evaluation subset
    is the test part. Columns: processed alert + ``sft_split`` + ``shuffle_key``."""
    train = split_df.where(F.col("split") == "train").drop("split")
    clean = S.exclude_ids(train, eval_df, "Id", "Id")
    balanced = S.balanced_sample(clean, "label", max_train_rows, id_col="Id", seed=seed, salt="sft")
    # At most ``max_train_rows`` rows: stored once so the val split's passes
    # do not repeat the anti join and the balancing.
    balanced = materialize(balanced.sparkSession, balanced, "sft-balanced")
    tv = S.stratified_split(balanced, "label", val_size, id_col="Id", seed=seed, salt="sft-val",
                            split_col="sft_split", names=("train", "val"))
    tv = S.with_shuffle_key(tv, "Id", seed, salt="sft-shuffle")
    test = eval_df.drop("shuffle_key").withColumn("sft_split", F.lit("test"))
    test = S.with_shuffle_key(test, "Id", seed, salt="sft-shuffle")
    return tv.unionByName(test)


#: Columns of the corpus files.
CORPUS_SCHEMA = "Id long, instruction string, input string, output string, sft_split string"


def write_corpus(corpus: DataFrame, path: str | None = None) -> str:
    """The instruction records as JSON files, one folder per split,
    in shuffled order (ties by id). The folder written to."""
    path = path or f"{checkpoint_root(corpus.sparkSession)}/sft-json-{uuid.uuid4().hex}"
    records = P.instruction_records(corpus, keep=["Id", "sft_split", "shuffle_key"])
    IO.write_json_records(records, path, "sft_split", order=["shuffle_key", "Id"])
    return path
