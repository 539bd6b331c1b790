"""Total order over a distributed table: positions and running sums.

``row_number() OVER (ORDER BY ...)`` puts all rows into one task. Here the rows are
range-partitioned and sorted, and stored with the number of their partition and
their place in it (``monotonically_increasing_id``: partition number in the upper
bits, place in the lower 33). The rows per partition, a table of as many rows as
there are partitions, are summed up once; a row's position is the sum of all
partitions before its own plus its place. Stored, the numbers stay what they
were when a later stage is run again after an executor was lost.

Rows that are equal in all order columns share a partition: give an order that
tells rows apart, or collapse equal rows first (:func:`running_sum` takes counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triageflow.session import materialize

ROW = "_row"
PART = "_part"
BEFORE = "_before"
PLACE_BITS = 33


def sorted_rows(df: DataFrame, order: list[Column | str], name: str = "sorted", partitions: int | None = None) -> DataFrame:
    """``df`` in order, stored, with ``_row`` (partition and place)."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return materialize(df.sparkSession, dealt.sortWithinPartitions(*by).withColumn(ROW, F.monotonically_increasing_id()), name)


def part() -> Column:
    return F.shiftrightunsigned(F.col(ROW), PLACE_BITS)


def place() -> Column:
    return F.col(ROW).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("bigint"))


def part_offsets(rows: DataFrame, weight: Column | None = None, group: str | None = None) -> DataFrame:
    """``_part`` (and the group), ``_n`` and ``_before``: rows, or summed weights, of
    each partition and of all before it. One row per partition and group."""
    keys = [F.col(group)] if group else []
    total = F.sum(weight) if weight is not None else F.count(F.lit(1))
    sizes = rows.groupBy(*keys, part().alias(PART)).agg(total.alias("_n"))
    w = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(BEFORE, F.coalesce(F.sum("_n").over(w), F.lit(0)))


def positions(df: DataFrame, order: list[Column | str], position_col: str = "position", group: str | None = None,
              name: str = "sorted") -> DataFrame:
    """``df`` with the 0-based position of every row, per value of ``group`` if given
    (which then must be the first of ``order``)."""
    if group is not None:
        return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", position_col, group, name).drop("_one")
    rows = sorted_rows(df, order, name)
    at = part_offsets(rows).select(PART, BEFORE)  # one row per partition
    return rows.withColumn(PART, part()).join(F.broadcast(at), PART).select(*df.columns, (F.col(BEFORE) + place()).alias(position_col))


def running_sum(df: DataFrame, order: list[Column | str], weight: str, sum_col: str, group: str, name: str = "sorted") -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows of the same ``group`` before each
    row. Sorted partitions are summed apart, in parallel, from the sum of all
    partitions of the group before them. ``group`` must be the first of ``order``."""
    rows = sorted_rows(df, order, name).withColumn(PART, part())
    at = part_offsets(rows, F.col(weight), group).select(F.col(group).alias("_group"), F.col(PART).alias("_at"), BEFORE)
    inside = Window.partitionBy(PART, group).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    # partitions + groups rows at most, as the order starts with the group
    joined = rows.join(at, (F.col(PART) == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col(BEFORE) + F.col("_inside")).alias(sum_col))
