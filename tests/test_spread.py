"""Work of few files or row groups goes to all cores; strips look at the ends only."""

import random

import pytest
from pyspark.sql import functions as F

from triageflow.functions.text import py_strip
from triageflow.operators import textml as TM
from triageflow.sources.tables import spread_small_input
from triageflow.streaming import classify as ST


def rows_by_task(df):
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.fixture
def many_splits(spark):
    """Splits of a few bytes each: many more than a file has row groups."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_row_group_of_many_splits_is_spread(spark, many_splits):
    path = ST.scratch(spark, "t-one-group")
    spark.range(4000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert df.rdd.getNumPartitions() >= 8 and rows_by_task(df) == [4000]
    got = rows_by_task(spread_small_input(df, min_partitions=8))
    assert sum(got) == 4000 and max(got) <= 1000


def test_tasks_take_a_bounded_number_of_rows(spark):
    df = spark.range(0, 4000, 1, 2)
    assert max(rows_by_task(spread_small_input(df, min_partitions=2, task_rows=100))) <= 200
    even = spark.range(0, 4000, 1, 40)
    assert spread_small_input(even, min_partitions=8, task_rows=100) is even
    assert spread_small_input(spark.range(0)).count() == 0


def test_strip_is_pythons_and_no_pattern(spark):
    some = [chr(c) for c in (*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)] + ["a", "\U0001f600"]
    rng = random.Random(3)
    texts = ["", " \n", "a \n", *some, *("".join(rng.choices(some, k=rng.randint(1, 12))) for _ in range(500))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", py_strip("t").alias("s"))
    assert [(r.t, r.s) for r in df.collect() if r.t is None or r.s != r.t.strip()] == [(None, None)]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_micro_batch_of_one_file_is_worked_on_by_many_tasks(spark):
    rows = spark.range(2000).select(F.col("id").alias("Id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in ST.RAW_ALERT_SCHEMA.fields[1:]])
    src = ST.stage_files(rows, ST.scratch(spark, "t-one-file"), 1)
    sink, ckpt = ST.scratch(spark, "t-sink"), ST.scratch(spark, "t-ckpt")
    ST.run_rule_stream(spark, src, sink, ckpt)
    got = spark.read.parquet(sink)
    assert got.select("Id").distinct().count() == got.count() == 2000
    assert got.select(F.input_file_name()).distinct().count() > 1


def test_training_rows_are_bounded_in_a_task(spark):
    one = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") % 2 == 0, "x y").alias("alert_text"), F.when(F.col("id") % 10 > 0, "a").alias("label"))
    clean = TM.training_rows(one, task_rows=100)
    assert clean.count() == 900 and not clean.where("alert_text is null").count()
    assert max(rows_by_task(clean)) <= 200


def test_term_counts_of_repeats_and_empty_texts(spark):
    df = spark.createDataFrame([("aa bb aa bb",), ("aa",), ("",), (None,), ("é x",)], "alert_text string")
    got = {r.term: (r.df, r.total) for r in TM.term_stats(df).collect()}
    assert got == {"aa": (2, 3), "bb": (1, 2), "aa bb": (1, 2), "bb aa": (1, 1)}


def test_a_term_is_counted_from_one_row_each_time_it_occurs(spark):
    """A document's distinct terms are not generated again beside all of its terms."""
    df = spark.createDataFrame([("aa bb aa bb cc",), ("aa aa",), ("",), (None,), ("x y",), ("bb aa bb",)], "alert_text string")
    found = TM.term_stats(df)
    assert sorted(map(tuple, found.collect())) == [("aa", 3, 5), ("aa aa", 1, 1), ("aa bb", 2, 3), ("bb", 2, 4), ("bb aa", 2, 2), ("bb cc", 1, 1), ("cc", 1, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "array_distinct" not in plan
