"""Dataset profile: one row per (table, column).

The reference previews five rows of every CSV it finds. Re-aimed as a
distributed profile: per table one aggregate pass (row count, non-null count
and exact distinct count of every column, text compared by fingerprint;
map-side partial aggregation keeps low-cardinality columns cheap), unpivoted with ``stack``, unioned over tables.
An unreadable table is reported with ``error`` instead of failing the job.

``sketch_profile`` counts distinct values by sketches of fixed size instead, one per
file and column, that merge: nothing but the sketches is shuffled, whatever the number of
distinct values, and a table that grows by files only needs those of the new ones
(``file_sketches`` of them, unioned with the stored ones). Columns named ``exact``
are counted exactly beside it. It also tells types and the first rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triageflow.sources.tables import read_table

PROFILE_COLUMNS = ["table_name", "column_name", "column_position", "data_type", "row_count", "null_count",
                   "distinct_count"]


FINGERPRINT_OVER_BYTES = 32


def _distinct_key(df: DataFrame, c: str):
    """The value itself; text longer than 32 bytes as a tagged 128-bit md5
    fingerprint, so the distinct aggregation shuffles at most 33 bytes per
    distinct value instead of whole documents (collision odds ~ n^2 / 2^129,
    nil at any real n). Short text keeps its bytes (tag 0x00, tag 0x01 marks a
    fingerprint, so the two never meet). Null stays null."""
    dtype = df.schema[c].dataType
    if not isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.col(c)
    raw = F.col(c) if isinstance(dtype, T.BinaryType) else F.encode(F.col(c), "UTF-8")
    return F.when(F.octet_length(raw) > FINGERPRINT_OVER_BYTES,
                  F.concat(F.unhex(F.lit("01")), F.unhex(F.md5(raw)))) \
            .otherwise(F.concat(F.unhex(F.lit("00")), raw))


def profile_table(df: DataFrame, table_name: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(F.col(c)).alias(f"_nn{i}"))
        aggs.append(F.count_distinct(_distinct_key(df, c)).alias(f"_nd{i}"))
    one = df.agg(*aggs)
    n = len(df.columns)
    types = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    stack = "stack({n}, {rows}) AS (column_name, column_position, data_type, non_null, distinct_count)".format(
        n=n, rows=", ".join(f"'{c}', {i}, '{types[c]}', _nn{i}, _nd{i}" for i, c in enumerate(df.columns)))
    return one.select(F.lit(table_name).alias("table_name"), F.col("_rows").alias("row_count"), F.expr(stack)) \
              .select("table_name", "column_name", F.col("column_position").cast("int").alias("column_position"),
                      "data_type", "row_count", (F.col("row_count") - F.col("non_null")).alias("null_count"),
                      F.col("distinct_count").cast("long").alias("distinct_count"))


SKETCH_BITS = 12  # 2^12 registers: about 1.6 % standard error
FIRST_CHARS = 40


def file_sketches(df: DataFrame) -> DataFrame:
    """``file, column_position, row_count, non_null, sketch``: one row per file and
    column of a table read from files. Values enter the sketch by 64-bit hash."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(df.columns):
        value = F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c)))
        aggs += [F.count(F.col(c)).alias(f"_n{i}"), F.hll_sketch_agg(value, SKETCH_BITS).alias(f"_s{i}")]
    per_file = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(*aggs)
    columns = F.array(*[F.struct(F.lit(i).alias("column_position"), F.col(f"_n{i}").alias("non_null"), F.col(f"_s{i}").alias("sketch"))
                        for i in range(len(df.columns))])
    return per_file.select("file", "row_count", F.explode(columns).alias("_c")).select("file", "row_count", "_c.*")


def sketch_profile(spark: SparkSession, df: DataFrame, table_name: str, exact: list[str] | None = None, first: int = 5,
                   sketches: DataFrame | None = None) -> DataFrame:
    """One row per column: type, rows, nulls, estimated distinct values (and the exact
    number for columns named ``exact``) and the values of the ``first`` rows by the
    first column (whole numbers and text, at most 40 characters). ``sketches``: stored
    ones of all files (default: made here)."""
    merged = (sketches if sketches is not None else file_sketches(df)).groupBy("column_position").agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null").alias("non_null"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
    counted = {c: df.agg(F.count_distinct(_distinct_key(df, c))).first()[0] for c in exact or []}
    top = df.orderBy(df.columns[0]).limit(first).collect()  # a preview
    plain = (T.LongType, T.IntegerType, T.StringType)
    told = [(i, c, df.schema[c].dataType.simpleString(), counted.get(c),
             [None if r[c] is None else str(r[c])[:FIRST_CHARS] for r in top] if isinstance(df.schema[c].dataType, plain) else None)
            for i, c in enumerate(df.columns)]
    names = spark.createDataFrame(told, "column_position int, column_name string, data_type string, distinct_count long, first_values array<string>")
    return names.join(merged, "column_position", "left").select(
        F.lit(table_name).alias("table_name"), "column_name", "column_position", "data_type", F.coalesce("row_count", F.lit(0)).alias("row_count"),
        (F.coalesce("row_count", F.lit(0)) - F.coalesce("non_null", F.lit(0))).alias("null_count"), "distinct_count",
        F.coalesce("distinct_estimate", F.lit(0)).alias("distinct_estimate"), "first_values")


def profile_tables(spark: SparkSession, sf_dir: str, tables: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Union of per-table profiles, plus ``(table, error)`` for unreadable tables."""
    parts, errors = [], []
    for t in tables:
        try:
            parts.append(profile_table(read_table(spark, sf_dir, t), t))
        except Exception as e:  # noqa: BLE001 - reported, the profile continues
            errors.append((t, f"{type(e).__name__}: {str(e)[:200]}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, errors
