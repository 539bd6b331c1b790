"""Text column expressions: whitespace strip, alert text assembly, non-empty test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triageflow.constants import FEATURE_COLUMNS, FIELD_SEPARATOR, NULL_VALUE_TEXT

# Python's str.strip() whitespace set (without it, Spark's trim only removes spaces).
PY_WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                  0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and return ``body(v)``.

    Catalyst inlines a derived column into every reference when it pushes a
    filter below a projection; an expression that mentions a large
    sub-expression several times (JSON parse chains, label normalisation) would
    then be copied that many times into the predicate. Binding it as a lambda
    variable keeps one copy per reference.
    """
    return F.transform(F.array(value), body).getItem(0)


def py_strip(col: Column | str) -> Column:
    """``str.strip()``: remove leading/trailing whitespace incl. tabs and newlines.
    A trim looks at both ends only; a pattern would be tried at every character."""
    c = F.col(col) if isinstance(col, str) else col
    return F.btrim(c, F.lit(PY_WHITESPACE))


def value_text(df: DataFrame, name: str) -> Column:
    """One field value as text; null and NaN -> ``unknown``; integral floats print as integers."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.when(F.isnan(c), F.lit(None)).when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_VALUE_TEXT))


def alert_text(df: DataFrame, columns: list[str] = FEATURE_COLUMNS) -> Column:
    """``"Col: value | Col: value ..."`` over ``columns`` in order.

    Every part is non-null before ``concat_ws`` (which would silently skip
    null parts). A column missing from ``df`` renders as ``"Col: "``.
    """
    present = set(df.columns)
    parts = []
    for name in columns:
        if name in present:
            parts.append(F.concat(F.lit(f"{name}: "), value_text(df, name)))
        else:
            parts.append(F.lit(f"{name}: "))
    return F.concat_ws(FIELD_SEPARATOR, *parts)


def is_non_empty(col: Column | str) -> Column:
    """True when the stripped text is non-empty; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.length(py_strip(c)) > 0, F.lit(False))
