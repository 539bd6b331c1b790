"""Row at a global position of an ordering, exact and distributed.

``orderBy(col).offset(i).limit(1)`` plans as ``TakeOrderedAndProject``: every
task keeps its ``i + 1`` smallest rows and one task merges them, so a large
``i`` puts ``i + 1`` rows into a single task. Below ``max_rank_rows`` that is
bounded and is what we use. Beyond it, and for many positions, an ordinal index
answers: order value and row key of every row, range-partitioned, sorted and
stored with the rows of each partition counted (``operators.ordering``). A position
is then one lookup: the partition whose running count holds it, the place in it
(a filter on the stored number, which skips all other row groups), and the row of
that value and key in the table.

Ordering: ``order_col`` ascending with nulls first (Spark's default), ties by a
seeded md5 key of the row, so a value that a third of the rows share spreads over
many partitions and strings that share any prefix need no special care. Equal
rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triageflow.operators import ordering as O
from triageflow.operators.sampling import order_key
from triageflow.session import materialize

RANK_ROWS = 100_000  # largest candidate set ranked with a bounded top-k
_ROW_KEY = "_row_key"
_VALUE = "_value"


def _tie_key(df: DataFrame, tiebreak: list[str] | None) -> Column:
    cols = tiebreak or df.columns
    return order_key(F.to_json(F.struct(*[F.col(c) for c in cols])), salt="position")


def _rank_small(cand: DataFrame, order_col: str, index: int) -> DataFrame:
    return cand.orderBy(F.col(order_col).asc_nulls_first(), F.col(_ROW_KEY)).offset(index).limit(1)


def ordinal_index(df: DataFrame, order_col: str, tiebreak: list[str] | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored index ``(order value, row key, number)`` and its running counts."""
    narrow = df.select(F.col(order_col).alias(_VALUE), _tie_key(df, tiebreak).alias(_ROW_KEY))
    index = O.sorted_rows(narrow, [F.col(_VALUE).asc_nulls_first(), F.col(_ROW_KEY)], "ordinal-index", partitions)
    return index, materialize(df.sparkSession, O.part_offsets(index), "ordinal-counts")


def rows_at(df: DataFrame, index: tuple[DataFrame, DataFrame], positions: DataFrame, order_col: str,
            tiebreak: list[str] | None = None) -> DataFrame:
    """``position`` and the columns of ``df`` for each row of ``positions`` (column
    ``position``, 0-based, distinct); positions out of range give no row. The
    positions asked for are few: they are broadcast."""
    rows, counts = index
    at = (positions.select(F.col("position").cast("long").alias("position"))
          .join(counts, (F.col("position") >= F.col(O.BEFORE)) & (F.col("position") < F.col(O.BEFORE) + F.col("_n")))
          .select("position", (F.shiftleft(F.col(O.PART), O.PLACE_BITS) + F.col("position") - F.col(O.BEFORE)).alias(O.ROW)))
    found = rows.join(F.broadcast(at), O.ROW).select("position", _VALUE, F.col(_ROW_KEY).alias("_key"))
    keyed = df.withColumn(_ROW_KEY, _tie_key(df, tiebreak))
    on = F.col(order_col).eqNullSafe(F.col(_VALUE)) & (F.col(_ROW_KEY) == F.col("_key"))
    met = keyed.join(F.broadcast(found), on)
    # equal rows share a key: each is the row at the position
    return met.dropDuplicates(["position"]).select("position", *df.columns)


def row_at_position(df: DataFrame, index: int, order_col: str, tiebreak: list[str] | None = None,
                    max_rank_rows: int = RANK_ROWS, n_buckets: int | None = None) -> DataFrame:
    """The row at 0-based ``index`` (empty when out of range), columns of ``df``.
    ``n_buckets``: partitions of the index (default: those of a shuffle)."""
    if index < 0:
        return df.limit(0)
    if index < max_rank_rows:  # each task keeps <= index + 1 rows: bounded
        return _rank_small(df.withColumn(_ROW_KEY, _tie_key(df, tiebreak)), order_col, index).select(*df.columns)
    stored = ordinal_index(df, order_col, tiebreak, n_buckets)
    counts = stored[1].where((F.col(O.BEFORE) <= index) & (F.col(O.BEFORE) + F.col("_n") > index)).first()
    if counts is None:
        return df.limit(0)
    number = (counts[O.PART] << O.PLACE_BITS) + index - counts[O.BEFORE]
    at = stored[0].where(F.col(O.ROW) == number).first()
    # value and key as literals: the value reaches the scan as a pushed filter
    value = F.col(order_col).eqNullSafe(F.lit(at[_VALUE]).cast(df.schema[order_col].dataType))
    return df.where(value & (_tie_key(df, tiebreak) == at[_ROW_KEY])).limit(1)
