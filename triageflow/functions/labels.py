"""Label normalisation as a literal-map lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triageflow.constants import INVALID_LABEL, LABEL_ALIASES_WIDE, LABELS
from triageflow.functions.text import let, py_strip


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def normalize_label(raw: Column, aliases: dict[str, str] = LABEL_ALIASES_WIDE,
                    labels: list[str] = LABELS) -> Column:
    """strip; an exact label passes; else lower-case, ``_`` -> space, strip and
    look the key up; else look it up with all spaces removed; else INVALID_LABEL.
    Null input is invalid."""
    amap = _literal_map(aliases)

    def body(label: Column) -> Column:
        def by_key(key: Column) -> Column:
            return F.coalesce(amap[key], amap[F.replace(key, F.lit(" "), F.lit(""))], F.lit(INVALID_LABEL))
        return (F.when(label.isin(labels), label)
                 .otherwise(let(py_strip(F.replace(F.lower(label), F.lit("_"), F.lit(" "))), by_key)))

    return let(py_strip(raw), body)
