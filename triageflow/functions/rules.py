"""Keyword-rule scoring as column expressions (one pass, whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triageflow.constants import (BENIGN_KEYWORDS, FALSE_POSITIVE_KEYWORDS,
                                  TRUE_POSITIVE_KEYWORDS)


def keyword_hits(lowered: Column, keywords: list[str]) -> Column:
    """Number of keywords contained (as substrings) in ``lowered``; presence, not occurrences."""
    total = None
    for kw in keywords:
        hit = lowered.contains(kw).cast("int")
        total = hit if total is None else total + hit
    return total


def lowered_text(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.lower(F.coalesce(c, F.lit("")))


def tp_score(lowered: Column) -> Column:
    return keyword_hits(lowered, TRUE_POSITIVE_KEYWORDS)


def benign_score(lowered: Column) -> Column:
    return keyword_hits(lowered, BENIGN_KEYWORDS)


def fp_score(lowered: Column) -> Column:
    return keyword_hits(lowered, FALSE_POSITIVE_KEYWORDS)


def rule_decision(tp: Column, fp: Column) -> Column:
    """tp>=2 -> TruePositive; fp>=2 and tp=0 -> FalsePositive; else BenignPositive.

    The benign branch of the reference returns the fallback label, so the
    benign score never changes the decision.
    """
    return (F.when(tp >= 2, F.lit("TruePositive"))
             .when((fp >= 2) & (tp == 0), F.lit("FalsePositive"))
             .otherwise(F.lit("BenignPositive")))
