"""CSV / JSON sources and sinks with the reference's null handling.

Pandas reads a fixed set of tokens (``NA``, ``N/A``, ``nan``, ``null``, ...)
as missing; Spark's CSV reader keeps them as text. After the scan, string
columns map those tokens to null. Arrays are stored as JSON text in CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triageflow.constants import CSV_NULL_TOKENS
from triageflow.operators.features import require_columns
from triageflow.operators.ordering import positions


CORRUPT = "_corrupt_record"


def null_tokens_to_null(df: DataFrame, tokens: list[str] = CSV_NULL_TOKENS, columns: list[str] | None = None) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns):
            cols.append(F.when(F.col(f.name).isin(tokens), F.lit(None).cast("string"))
                         .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             glob: str | None = None, max_rows: int | None = None, order_by: str | None = None,
             multi_line: bool = False) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data).

    Columns are taken by header name: files may order them otherwise and hold
    more. Values are read as text and cast, ``242.0`` to an integer as well; one
    that does not fit its type fails the read, naming it, whatever the session's
    ANSI mode (:func:`read_csv_checked` sets such rows aside instead). ``multi_line`` reads quoted
    fields that span lines (model answers do), one file a task; without it
    files are split. ``glob`` keeps only matching files of a directory. ``max_rows`` is the
    bounded scan: the first rows by ``order_by`` (file order is not a Spark
    concept); default is the whole input.
    """
    reader = (spark.read.option("header", True).option("multiLine", multi_line)
              .option("escape", '"').option("mode", "FAILFAST"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = null_tokens_to_null(reader.option("inferSchema", False).csv(path))
        df = require_columns(df, schema.fieldNames()).select(*[_cast(df, f) for f in schema.fields])
    else:
        df = null_tokens_to_null(reader.option("inferSchema", True).csv(path))
    if max_rows is not None:
        df = df.orderBy(order_by or df.columns[0]).limit(max_rows)
    return df


def _number_text(field: T.StructField) -> Column:
    """A text column, for whole numbers without a ``.0`` at its end."""
    text = F.col(field.name)
    return F.regexp_replace(F.trim(text), r"\.0+$", "") if isinstance(field.dataType, T.IntegralType) else text


def _misfit(field: T.StructField) -> Column:
    """Why a value does not fit its field, else null."""
    bad = F.col(field.name).isNotNull() & _number_text(field).try_cast(field.dataType).isNull()
    return F.when(bad, F.concat(F.lit(f"{field.name}: "), F.to_json(F.struct(F.col(field.name).alias("value"))),
                                F.lit(f" is not {field.dataType.simpleString()}")))


def _cast(df: DataFrame, field: T.StructField) -> Column:
    """A text column as the field's type; a value that does not fit ends the read."""
    value = _number_text(field).try_cast(field.dataType)
    return F.when(_misfit(field).isNotNull(), F.raise_error(_misfit(field)).cast(field.dataType)).otherwise(value).alias(field.name)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None,
                     multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Like :func:`read_csv` with a schema, but rows that do not fit are a second
    table ``file, record, reason, raw`` instead of an error: records with too many,
    too few or unclosed fields and values that do not fit their type (every such value is
    named). Does not depend on the session's ANSI mode.

    ``record`` counts the data records of the file from 1 (header and blank lines
    are none). It comes from one count per file block and the place in the block, so
    no file is read by one task alone (but with ``multi_line``, where files are not split)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    names = require_columns(reader.option("inferSchema", False).csv(path), schema.fieldNames()).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    rows = (reader.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("enforceSchema", False).csv(path))
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = rows.select("*", *block, F.monotonically_increasing_id().alias("_id"))
    # numbers of a block start anywhere but run on: the first one and their count tell the place
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count(CORRUPT).alias("_bad"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("_file"), F.col("_block").alias("_start"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    clean = null_tokens_to_null(rows.select(*[F.col(n) for n in names], CORRUPT, "file", "_block", "_id"), columns=names)
    reasons = F.array_compact(F.array(F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed record")), *[_misfit(f) for f in schema.fields]))
    judged = clean.withColumn("_reasons", reasons)
    good = judged.where(F.size("_reasons") == 0).select(*[_number_text(f).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    bad = judged.where(F.size("_reasons") > 0).select(
        "file", "_block", "_id", F.array_join("_reasons", "; ").alias("reason"),
        F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[F.col(n) for n in names]))).alias("raw"))
    bad = bad.join(blocks, (F.col("file") == F.col("_file")) & (F.col("_block") == F.col("_start")))
    return good, bad.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("record"), "reason", "raw")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV; array columns become JSON text first (CSV has no arrays)."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name) for f in df.schema.fields]
    (df.select(*cols).write.mode(mode).option("header", True).option("escape", '"')
       .option("quoteAll", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("emptyValue", "").csv(path))


def write_json_records(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite",
                       order: list[str] | None = None) -> None:
    """JSON lines, UTF-8 (non-ASCII kept), optionally one folder per split.

    With ``order`` the files hold the rows in that order, part by part: rows are
    range-partitioned and sorted (by split first), and part numbers follow the
    ranges. No task holds more than its range; equal order values share one."""
    if order:
        by = [*([partition_by] if partition_by else []), *order]
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def read_json_in_order(spark: SparkSession, path: str, schema: T.StructType | str, partition_by: str | None = None,
                       position_col: str = "position") -> DataFrame:
    """JSON lines with the 0-based position of each in its split: by file, place of
    the block in the file and place in the block, as written by an ordered sink."""
    rows = spark.read.schema(schema).json(path)
    names = rows.columns
    place = {"_file": F.col("_metadata.file_name"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    rows = rows.select(*names, *[c.alias(k) for k, c in place.items()])
    order = [*([partition_by] if partition_by else []), *place]
    return positions(rows, order, position_col, partition_by, "json-lines").drop(*place)
