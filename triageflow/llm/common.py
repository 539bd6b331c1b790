"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from triageflow.session import checkpoint_root, materialize

#: Rows and bytes of one Arrow batch: what a Python worker holds at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well as rows, so that a run of very
    long texts does not make one huge batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def struct_udf(ddl: str, fn: Callable[[list], Iterable[tuple]]):
    """Arrow scalar UDF: ``fn`` maps the list of one column's values of a batch
    to one tuple per value, typed by ``ddl``."""
    schema: StructType = _parse_datatype_string(ddl)
    names = [f.name for f in schema.fields]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(values: pa.Array) -> pa.Array:
        rows = list(fn(values.to_pylist()))
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

    return F.arrow_udf(run, schema)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back."""
    return materialize(spark, df, f"llm-{name}")


def stored_at(spark: SparkSession, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Like :func:`stored`, with the folder, for :func:`discard`. Read back by the
    schema of ``df``, so that a partitioned table may be empty."""
    path = f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str = "text") -> Column:
    """128-bit key of a text (null: of the empty text)."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: ``node, component``
    (the smallest node reachable), one row per node that has an edge.

    Alternating large-star / small-star rounds: every round is a grouped minimum
    and an equi-join, so no component is gathered in a task. The minima are
    stored before they are joined, which leaves a plain exchange on both sides
    and lets AQE split a node that holds a large share of the edges. Nulls and
    self loops are ignored; an empty edge list gives an empty table.
    """
    e = stored(spark, edges.where(F.col(a) != F.col(b))
               .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(spark, both.groupBy("u").agg(F.min("v").alias("m"))
                     .select("u", F.least("u", "m").alias("m")), "low")
        # large star: neighbours above u hang on the minimum around u
        large = (both.where("v > u").join(low, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(spark, large, "large")
        # small star: u and its neighbours below hang on the minimum below u
        low = stored(spark, large.groupBy("u").agg(F.min("v").alias("m")), "low")
        below = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(spark, below.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    low = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return low.unionByName(low.select(F.col("component").alias("node"), "component").distinct())
