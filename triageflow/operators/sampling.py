"""Exact, seeded, partition-independent stratified sampling and splitting.

Contract (``SURVEY`` 2.5.1): quota-exact per class, seeded, independent of
partitioning and input order. Row order inside a class is the seeded key
``md5("<seed>:<salt>:<id>")`` with the id, then all other columns, as
tie-break, so rows that share an id are told apart; the lowest ``quota_c`` keys of class ``c`` are selected.

Scale design. A plain ``row_number() OVER (PARTITION BY class ORDER BY key)``
puts a whole class in one task; with three classes and 100 TB that is a
third of the data in one sort. Instead a threshold row is found per class, from
``(class, key)`` alone, and every row is compared with it:

1. one aggregate pass builds a histogram ``(class, key-prefix bucket) -> n``
   (at most ``classes x 16^5`` rows), written once to the shared folder;
2. per-class totals (one row per class, capped) come from the histogram and
   give the quotas (largest remainder, exact integers);
3. a running sum over the small histogram finds each class's boundary bucket, and
   one over the distinct keys of that bucket alone (~n_c / 16^5, counted per key
   before the shuffle) the threshold key and how many of its rows are taken;
4. one scan compares each row's key with its class's threshold. The whole rows
   are read by this pass only: ``keys`` may name a narrower source of class and id
   for the passes before it, so no text is assembled twice or stored.

Rows that share the threshold's id (a hot id may hold a third of all rows) and are
only partly taken are put in order by all columns: equal ones collapse into one
with a count, the rest is range-sorted over many tasks with a running sum
(``operators.ordering``). Their count decides how many copies of each are taken. It is
the only case in which a second scan, of that id alone, is added.

The only values on the driver are per-class scalars (row counts, quotas, thresholds).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triageflow.constants import RANDOM_STATE
from triageflow.operators.ordering import running_sum
from triageflow.session import materialize

KEY = "_order_key"
BUCKET = "_bucket"
MAX_CLASSES = 10000


def order_key(id_col: str | Column, seed: int = RANDOM_STATE, salt: str = "") -> Column:
    """``md5("<seed>:<salt>:<id>")`` as lowercase hex; null id hashes as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.coalesce(c.cast("string"), F.lit(""))))


def class_counts(df: DataFrame, class_col: str, max_classes: int = MAX_CLASSES) -> dict:
    """Rows per class (nulls form their own class). Capped: a class column with
    more distinct values than ``max_classes`` is not a stratum and is rejected."""
    rows = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"{class_col!r} has more than {max_classes} classes")
    return {r[0]: int(r[1]) for r in rows}


def _sort_key(label):
    return (label is None, "" if label is None else str(label))


def largest_remainder(counts: dict, n_draws: int) -> dict:
    """Allocate ``n_draws`` proportionally: floor, then +1 by largest remainder
    (exact integer arithmetic; ties by class value ascending)."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    floor = {c: (n_draws * k) // n for c, k in counts.items()}
    rem = {c: (n_draws * k) % n for c, k in counts.items()}
    extra = n_draws - sum(floor.values())
    order = sorted(counts, key=lambda c: (-rem[c], _sort_key(c)))
    return {c: floor[c] + (1 if i < extra else 0) for i, c in enumerate(order)}


def split_quotas(counts: dict, test_size: float | int) -> dict:
    """Per-class size of the held-out part of a stratified split.

    ``test_size`` < 1 is a fraction (held-out total ``ceil(f * n)``), otherwise an
    absolute row count. The kept part is allocated first by largest remainder
    and the held-out part is the rest of each class, so both parts keep the
    class shares.
    """
    n = sum(counts.values())
    n_test = math.ceil(test_size * n) if isinstance(test_size, float) and test_size < 1 else int(test_size)
    if not 0 < n_test < n:
        raise ValueError(f"test_size={test_size} gives {n_test} of {n} rows")
    train = largest_remainder(counts, n - n_test)
    return {c: counts[c] - train[c] for c in counts}


def balanced_quotas(counts: dict, total: int) -> dict:
    """``k = total // n_classes`` per class, capped by the class size (nulls excluded)."""
    real = {c: k for c, k in counts.items() if c is not None}
    k = total // len(real) if real else 0
    return {c: min(k, n) for c, n in real.items()}


BUCKET_DIGITS = 5  # 16^5 buckets per class: a boundary bucket of a 10^12-row class holds ~10^6 rows


def _lookup(class_col: str, values: dict) -> Column:
    """Per-class literal lookup: a literal map for non-null classes (constant-folded,
    one hash probe per row) plus a branch for the null class."""
    pairs = [x for c, v in values.items() if c is not None for x in (F.lit(c), F.lit(v))]
    expr = F.create_map(*pairs)[F.col(class_col)] if pairs else F.lit(None)
    if None in values:
        expr = F.when(F.col(class_col).isNull(), F.lit(values[None])).otherwise(expr)
    return expr


def key_histogram(df: DataFrame, class_col: str, key: Column, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``(class, bucket, n)``: rows per class and key-prefix bucket. Partial
    aggregation keeps the shuffle at <= classes x 16^digits rows per task."""
    keyed = df.select(F.col(class_col), F.substring(key, 1, digits).alias(BUCKET))
    return keyed.groupBy(class_col, BUCKET).agg(F.count(F.lit(1)).alias("_n"))


def _store_histogram(df: DataFrame, class_col: str, key: Column, digits: int) -> tuple[DataFrame, dict]:
    """Histogram written once to the shared folder (it is read twice) and the
    per-class totals summed from it (one row per class, capped)."""
    hist = materialize(df.sparkSession, key_histogram(df, class_col, key, digits), "key-histogram")
    rows = hist.groupBy(class_col).agg(F.sum("_n").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{class_col!r} has more than {MAX_CLASSES} classes")
    return hist, {r[0]: int(r[1]) for r in rows}


def thresholds(keys: DataFrame, class_col: str, quotas: dict, digits: int, hist: DataFrame) -> dict:
    """``class -> (key, taken, n)``: the rows of smaller keys are selected, and
    ``taken`` of the ``n`` rows of this key. ``keys`` holds the class and ``KEY``."""
    w = Window.partitionBy(class_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def boundary(counted: DataFrame, by: str, quota: dict) -> DataFrame:
        h = counted.withColumn("_quota", _lookup(class_col, quota)).where(F.col("_quota").isNotNull())
        h = h.withColumn("_cum", F.sum("_n").over(w.orderBy(by)))
        before = F.col("_cum") - F.col("_n")
        return h.where((before < F.col("_quota")) & (F.col("_quota") <= F.col("_cum"))).select(class_col, by, (F.col("_quota") - before).alias("_need"), "_n")

    buckets = boundary(hist, BUCKET, quotas).collect()  # one row per class, like the next
    bucket_of = _lookup(class_col, {r[0]: r[1] for r in buckets})
    inside = keys.where(F.substring(KEY, 1, digits) == bucket_of).groupBy(class_col, KEY).agg(F.count(F.lit(1)).alias("_n"))
    return {r[0]: (r[1], int(r[2]), int(r[3])) for r in boundary(inside, KEY, {r[0]: int(r[2]) for r in buckets}).collect()}


def select_by_quota(df: DataFrame, class_col: str, quotas: dict, key: Column,
                    tiebreak: Sequence[str], flag: str = "selected", digits: int = BUCKET_DIGITS,
                    hist: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """All rows of ``df`` plus boolean ``flag``: True for the ``quotas[c]`` rows of
    class ``c`` with the lowest ``(key, *tiebreak)``. ``keys``: a narrower source of
    the same rows' class and id columns (default: ``df``)."""
    active = {c: q for c, q in quotas.items() if q > 0}
    if not active:
        return df.withColumn(flag, F.lit(False))
    keys = df if keys is None else keys
    if hist is None:
        hist = key_histogram(keys, class_col, key, digits)
    limit = thresholds(keys.select(F.col(class_col), key.alias(KEY)), class_col, active, digits, hist)
    keyed = df.withColumn(KEY, key)
    at = F.col(KEY) == _lookup(class_col, {c: k for c, (k, _, _) in limit.items()})
    below = F.col(KEY) < _lookup(class_col, {c: k for c, (k, _, _) in limit.items()})
    partly = {c: taken for c, (_, taken, n) in limit.items() if taken < n}
    if not partly:
        return keyed.withColumn(flag, F.coalesce(below | at, F.lit(False))).drop(KEY)
    split = F.coalesce(at & _lookup(class_col, partly).isNotNull(), F.lit(False))
    outside = keyed.where(~split).withColumn(flag, F.coalesce(below | at, F.lit(False)))
    return outside.drop(KEY).unionByName(_copies(keyed.where(split).drop(KEY), class_col, partly, tiebreak, flag))


def _copies(rows: DataFrame, class_col: str, taken: dict, tiebreak: Sequence[str], flag: str) -> DataFrame:
    """Rows that share their class's threshold key: the first ``taken`` by ``tiebreak``."""
    order = [class_col, *(c for c in tiebreak if c != class_col), *(c for c in rows.columns if c != class_col and c not in tiebreak)]
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    summed = running_sum(distinct, order, "_n", "_cum", class_col, "threshold-rows")
    take = F.greatest(F.lit(0), F.least(F.col("_n"), _lookup(class_col, taken) - F.col("_cum")))
    copies = summed.withColumn("_take", take).select(*rows.columns, "_take", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    return copies.select(*rows.columns, (F.col("_copy") <= F.col("_take")).alias(flag))


def stratified_split(df: DataFrame, class_col: str, test_size: float | int, id_col: str = "Id",
                     seed: int = RANDOM_STATE, salt: str = "split", tiebreak: Sequence[str] | None = None,
                     split_col: str = "split", names: tuple[str, str] = ("train", "test"),
                     digits: int = BUCKET_DIGITS, keys: DataFrame | None = None) -> DataFrame:
    """Every row with ``split_col`` = train/test; test is ``test_size`` (fraction
    or row count) of the rows, class shares kept, disjoint and complete. ``keys``: see
    :func:`select_by_quota`."""
    key = order_key(id_col, seed, salt)
    hist, counts = _store_histogram(df if keys is None else keys, class_col, key, digits)
    quotas = split_quotas(counts, test_size)
    tb = list(tiebreak) if tiebreak is not None else [id_col, *(c for c in df.columns if c != id_col)]
    flagged = select_by_quota(df, class_col, quotas, key, tb, "_held", digits, hist, keys)
    return flagged.withColumn(split_col, F.when(F.col("_held"), F.lit(names[1])).otherwise(F.lit(names[0]))) \
                  .drop("_held")


def balanced_sample(df: DataFrame, class_col: str, total: int, id_col: str = "Id",
                    seed: int = RANDOM_STATE, salt: str = "balanced", tiebreak: Sequence[str] | None = None,
                    digits: int = BUCKET_DIGITS, keys: DataFrame | None = None) -> DataFrame:
    """``min(total // n_classes, class size)`` rows per class, without replacement.
    ``keys``: see :func:`select_by_quota`."""
    key = order_key(id_col, seed, salt)
    hist, counts = _store_histogram(df if keys is None else keys, class_col, key, digits)
    quotas = balanced_quotas(counts, total)
    tb = list(tiebreak) if tiebreak is not None else [id_col, *(c for c in df.columns if c != id_col)]
    flagged = select_by_quota(df, class_col, quotas, key, tb, "_take", digits, hist, keys)
    return flagged.where(F.col("_take")).drop("_take")


def with_shuffle_key(df: DataFrame, id_col: str = "Id", seed: int = RANDOM_STATE, salt: str = "shuffle",
                     key_col: str = "shuffle_key") -> DataFrame:
    """Seeded shuffle as a sort key; sinks ``orderBy(shuffle_key, id)`` (a
    range-partitioned distributed sort), nothing is ordered before that."""
    return df.withColumn(key_col, order_key(id_col, seed, salt))


def exclude_ids(df: DataFrame, other: DataFrame, id_col: str = "Id", other_id_col: str = "Id") -> DataFrame:
    """Leakage guard: drop rows whose id, compared as text, occurs in ``other``.

    Null-safe like the reference (its string cast turns null into ``nan``, so
    a null id matches a null id). The planner broadcasts ``other`` when its
    size statistics are under the broadcast threshold and shuffles otherwise.
    """
    ids = other.select(F.col(other_id_col).cast("string").alias("_xid")).distinct()
    return df.join(ids, F.col(id_col).cast("string").eqNullSafe(F.col("_xid")), "left_anti")
