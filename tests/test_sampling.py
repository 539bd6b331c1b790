"""Sampling and splitting: quota-exact, disjoint, complete, partition-independent,
identical to a plain per-class rank; leakage guard."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from triageflow.operators import sampling as S
from triageflow.plans import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def alerts(spark):
    return jobs.processed_alerts(spark, SF).cache()


def _plain_rank(df, quotas, salt):
    key = S.order_key("Id", 42, salt)
    w = Window.partitionBy("label").orderBy(key, F.col("Id"))
    q = S._lookup("label", quotas)
    return {r.Id for r in df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= q).collect()}


def test_quota_arithmetic():
    counts = {"a": 5514, "b": 1026, "c": 8160}
    q = S.split_quotas(counts, 0.2)
    assert sum(q.values()) == 2940
    assert all(abs(q[c] - 0.2 * counts[c]) <= 1 for c in counts)
    assert S.largest_remainder({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert S.balanced_quotas({"a": 10, "b": 500, None: 3}, 300) == {"a": 10, "b": 150}
    with pytest.raises(ValueError):
        S.split_quotas({"a": 3}, 5)


@pytest.mark.parametrize("digits", [1, 2, 5])
def test_split_equals_plain_rank_and_is_exact(spark, alerts, digits):
    flagged = S.stratified_split(alerts, "label", 0.2, salt="split", digits=digits)
    rows = flagged.select("Id", "label", "split").collect()
    assert len(rows) == alerts.count() and len({r.Id for r in rows}) == len(rows)   # complete, disjoint
    counts = S.class_counts(alerts, "label")
    quotas = S.split_quotas(counts, 0.2)
    test_ids = {r.Id for r in rows if r.split == "test"}
    for c, q in quotas.items():
        assert sum(1 for r in rows if r.split == "test" and r.label == c) == q
    assert test_ids == _plain_rank(alerts, quotas, "split")


def test_split_is_partition_independent(spark, alerts):
    one = S.stratified_split(alerts.coalesce(1), "label", 0.2).where("split = 'test'").select("Id")
    many = S.stratified_split(alerts.repartition(8), "label", 0.2).where("split = 'test'").select("Id")
    assert {r.Id for r in one.collect()} == {r.Id for r in many.collect()}


def test_absolute_size_split(spark, alerts):
    out = S.stratified_split(alerts, "label", 100, salt="v", names=("train", "val"))
    assert out.where("split = 'val'").count() == 100


def test_balanced_sample(spark, alerts):
    sub = S.balanced_sample(alerts, "label", 30, digits=1)
    got = {r.label: r["count"] for r in sub.groupBy("label").count().collect()}
    assert got == {"BenignPositive": 10, "FalsePositive": 10, "TruePositive": 10}
    quotas = S.balanced_quotas(S.class_counts(alerts, "label"), 30)
    assert {r.Id for r in sub.collect()} == _plain_rank(alerts, quotas, "balanced")


def test_exclude_ids_is_null_safe(spark):
    train = spark.createDataFrame([(1,), (2,), (None,), (4,)], "Id long")
    ev = spark.createDataFrame([(2,), (None,)], "Id long")
    assert sorted(r.Id for r in S.exclude_ids(train, ev).collect()) == [1, 4]


def test_sft_corpus_has_no_eval_ids(spark):
    split = jobs.stored_split(spark, SF)
    ev = jobs.eval_subset(split, 30)
    corpus = jobs.sft_corpus(split, ev, max_train_rows=300, val_size=30)
    ev_ids = {r.Id for r in ev.collect()}
    train_ids = {r.Id for r in corpus.where("sft_split != 'test'").collect()}
    assert ev_ids and not (ev_ids & train_ids)
    counts = {r.sft_split: r["count"] for r in corpus.groupBy("sft_split").count().collect()}
    assert counts["val"] == 30 and counts["test"] == 30 and counts["train"] == 270


def test_shuffle_key_deterministic(spark):
    df = spark.createDataFrame([(7,)], "Id long")
    k = S.with_shuffle_key(df, salt="").collect()[0].shuffle_key
    import hashlib
    assert k == hashlib.md5(b"42::7").hexdigest()
