"""Prompt, chat-message and instruction-record tables (one projection each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triageflow.constants import (FEW_SHOT_EXAMPLE_FORMAT, FEW_SHOT_EXAMPLES, FEW_SHOT_FOOTER, FEW_SHOT_HEADER,
                                  HYBRID_TEMPLATE, SFT_INPUT_PREFIX, SFT_INPUT_SUFFIX, SFT_OUTPUT_PREFIX,
                                  SFT_OUTPUT_SUFFIX, SFT_SYSTEM_PROMPT, ZERO_SHOT_TEMPLATE)
from triageflow.functions.text import py_strip


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render(template: str, **values: Column | str) -> Column:
    """Fill ``{name}`` placeholders with columns, then strip outer whitespace.

    The template is cut at its placeholders into literal pieces once, on the
    driver; per row it is a single ``concat`` (null values render as empty).
    """
    pieces: list[Column] = []
    rest = template
    while True:
        hits = [(rest.find("{" + k + "}"), k) for k in values if ("{" + k + "}") in rest]
        if not hits:
            pieces.append(F.lit(rest))
            break
        pos, name = min(hits)
        pieces.append(F.lit(rest[:pos]))
        pieces.append(F.coalesce(_col(values[name]).cast("string"), F.lit("")))
        rest = rest[pos + len(name) + 2:]
    return py_strip(F.concat(*pieces))


def few_shot_template(examples: list[tuple[str, str]] = FEW_SHOT_EXAMPLES) -> str:
    shots = "".join(FEW_SHOT_EXAMPLE_FORMAT.replace("{alert_text}", a).replace("{label}", lab)
                    for a, lab in examples)
    return FEW_SHOT_HEADER + shots + FEW_SHOT_FOOTER


def zero_shot_prompt(text: Column | str = "alert_text") -> Column:
    return render(ZERO_SHOT_TEMPLATE, alert_text=text)


def few_shot_prompt(text: Column | str = "alert_text",
                    examples: list[tuple[str, str]] = FEW_SHOT_EXAMPLES) -> Column:
    return render(few_shot_template(examples), alert_text=text)


def hybrid_prompt(text: Column | str = "alert_text", ml_prediction: Column | str = "ml_predicted_label",
                  template: str = HYBRID_TEMPLATE) -> Column:
    return render(template, ml_prediction=ml_prediction, alert_text=text)


def sft_input(text: Column | str = "alert_text") -> Column:
    return F.concat(F.lit(SFT_INPUT_PREFIX), F.coalesce(_col(text), F.lit("")), F.lit(SFT_INPUT_SUFFIX))


def chat_messages(text: Column | str = "alert_text") -> Column:
    """``[{system}, {user}]`` as ``array<struct<role, content>>``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SFT_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), sft_input(text).alias("content")),
    )


def instruction_records(df: DataFrame, text_col: str = "alert_text", label_col: str = "label",
                        keep: list[str] | None = None) -> DataFrame:
    """``instruction, input, output`` per row. ``output`` is built by ``concat``
    to keep the ``": "`` spacing of the reference's JSON dump (labels are the
    closed label domain, so no escaping is needed)."""
    return df.select(*(keep or []),
                     F.lit(SFT_SYSTEM_PROMPT).alias("instruction"),
                     sft_input(text_col).alias("input"),
                     F.concat(F.lit(SFT_OUTPUT_PREFIX), F.col(label_col), F.lit(SFT_OUTPUT_SUFFIX)).alias("output"))
