"""Unlabelled alerts, repeated ids, CSV by name, large label lists, equal rows."""

import glob
import uuid
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triageflow.operators import answers as A
from triageflow.operators import metrics as M
from triageflow.operators import sampling as S
from triageflow.operators.position import row_at_position
from triageflow.functions.text import alert_text
from triageflow.session import checkpoint_root
from triageflow.sources import io as IO
from triageflow.streaming.classify import classify


def test_alerts_without_a_grade_are_scored(spark):
    raw = spark.createDataFrame([(1, "Malware", None), (2, None, "TruePositive")], "Id long, Category string, IncidentGrade string")
    assert {r.Id: r.label for r in classify(raw).collect()} == {1: None, 2: "TruePositive"}
    online = classify(raw.drop("IncidentGrade")).collect()
    assert len(online) == 2 and all(r.label is None and r.predicted_label for r in online)


def test_alerts_that_share_an_id_keep_one_row_each(spark):
    alerts = spark.createDataFrame([(7, 1, "a", "TruePositive"), (7, 2, "b", "FalsePositive"), (7, 2, "b", "FalsePositive"), (None, 3, "c", "TruePositive")],
                                   "Id long, AlertId long, alert_text string, label string") \
        .withColumn("IncidentId", F.lit(0)).withColumn("Timestamp", F.lit("t"))
    answers = spark.createDataFrame([(7, '{"predicted_label": "TruePositive"}', None, 1.0), (7, "x", None, 2.0), (7, "x", "e", 2.0), (None, "y", None, 1.0)],
                                    "Id long, raw_response string, request_error string, latency_seconds double")
    assert A.llm_prediction_table(alerts, answers).count() == 4
    own = answers.where("Id = 7").limit(2).withColumn("AlertId", F.when(F.col("latency_seconds") == 1.0, 1).otherwise(2).cast("long"))
    rows = A.llm_prediction_table(alerts, own).where("Id = 7").collect()
    assert Counter((r.AlertId, r.latency_seconds) for r in rows) == {(1, 1.0): 1, (2, 2.0): 2}


def test_split_of_repeated_ids_does_not_depend_on_partitions(spark):
    rows = [(i % 5 if i % 7 else None, f"text {i}", "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "Id long, alert_text string, label string")
    held = [sorted(r.alert_text for r in S.stratified_split(df.repartition(n), "label", 0.25).where("split = 'test'").collect()) for n in (1, 3, 8)]
    assert len(held[0]) == 30 and held[0] == held[1] == held[2]


SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def _file(spark, text):
    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_csv_is_read_by_name(spark):
    path = _file(spark, 'b,extra,a\n"  kept  ",x,1\nNA,y,242.0\n"q""q",z,')
    assert sorted(map(tuple, IO.read_csv(spark, path, SCHEMA).collect()), key=str) == [(1, "  kept  "), (242, None), (None, 'q"q')]
    with pytest.raises(ValueError, match="not found"):
        IO.read_csv(spark, _file(spark, "a,c\n1,2"), SCHEMA)
    with pytest.raises(Exception, match="abc"):
        IO.read_csv(spark, _file(spark, "a,b\nabc,2"), SCHEMA).collect()


def test_csv_keeps_outer_white_space_and_lines(spark):
    df = spark.createDataFrame([(1, "  lead and trail  "), (2, "\n{...}\n"), (3, 'a "quote", comma')], SCHEMA)
    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    IO.write_csv(df, path)
    assert sorted(map(tuple, IO.read_csv(spark, path, SCHEMA, multi_line=True).collect())) == sorted(map(tuple, df.collect()))
    assert glob.glob(path.removeprefix("file:") + "/*.csv")


def test_no_local_folder_on_a_cluster():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default=None: default)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_root(session(master))


def test_nan_is_unknown(spark):
    df = spark.createDataFrame([(float("nan"),), (3.0,), (None,)], "City double")
    assert sorted(r.t for r in df.select(alert_text(df, ["City"]).alias("t")).collect()) == ["City: 3", "City: unknown", "City: unknown"]


def test_confusion_grid_of_200_labels(spark):
    labels = [f"l{i:03d}" for i in range(200)]
    long_df = spark.range(4000).select(F.lit("m").alias("model"), F.format_string("l%03d", F.col("id") % 200).alias("true_label"),
                                       F.format_string("l%03d", F.col("id") % 201).alias("pred_label"))
    rows = M.confusion_matrix_long(M.confusion_cells(long_df), labels).collect()
    want = Counter((i % 200, i % 201) for i in range(4000) if i % 201 < 200)
    assert len(rows) == 40_000
    assert all(r.n == want.get((int(r.true_label[1:]), int(r.pred_label[1:])), 0) and r.cell_order == int(r.true_label[1:]) * 200 + int(r.pred_label[1:])
               for r in rows)


def test_position_among_equal_rows(spark):
    df = spark.createDataFrame([(1, "same")] * 200, "Id long, t string")
    assert [tuple(r) for r in row_at_position(df, 120, "Id", max_rank_rows=50).collect()] == [(1, "same")]
