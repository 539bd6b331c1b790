"""Strict JSON extraction, label normalisation and list coercion."""

import pytest

from triageflow.functions import jsonparse as J
from triageflow.functions.labels import normalize_label
from triageflow.constants import LABEL_ALIASES_NARROW
from triageflow.operators import answers as A
from triageflow.sources.fixtures import TRIAGE_ANSWER_SHAPES


def _obj(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F
    return [r[0] for r in df.select(F.to_json(J.strict_object(F.col("t")))).collect()]


def test_strict_json_edges(spark):
    got = _obj(spark, ['{"a":1} trailing', '{"a":1},"b"', '{"a":1}] junk [', "[1,2]", "5", "",
                       '{"a":1,"a":2}', '{"a":null}', '{"a":1}\n', None])
    assert got[:6] == [None] * 6
    assert got[6] == '{"a":2}'            # last duplicate wins, like Python
    assert got[7] == '{"a":null}'
    assert got[8] == '{"a":1}'
    assert got[9] is None


# (raw shape index) -> (greedy/wide label, non-greedy/narrow label, greedy status)
EXPECTED = {
    0: ("TruePositive", "TruePositive", "OK"),
    1: ("FalsePositive", "FalsePositive", "OK"),
    2: ("BenignPositive", "BenignPositive", "OK"),
    3: ("TruePositive", "TruePositive", "OK"),
    4: ("BenignPositive", "BenignPositive", "OK"),
    5: ("TruePositive", "INVALID_LABEL", "OK"),
    6: ("INVALID_LABEL", "FalsePositive", "PARSE_ERROR"),
    7: ("INVALID_LABEL", "INVALID_LABEL", "PARSE_ERROR"),
    8: ("INVALID_LABEL", "INVALID_LABEL", "PARSE_ERROR"),
    9: ("TruePositive", "INVALID_LABEL", "OK"),
    10: ("INVALID_LABEL", "INVALID_LABEL", "OK"),
    11: ("INVALID_LABEL", "INVALID_LABEL", "OK"),
}


def test_answer_shapes(spark):
    df = spark.createDataFrame([(i, s, None) for i, s in enumerate(TRIAGE_ANSWER_SHAPES)],
                               "Id long, raw_response string, request_error string")
    wide = {r.Id: r for r in A.parse_triage_answers(df).collect()}
    narrow = {r.Id: r for r in A.parse_sft_answers(df).collect()}
    for i, (w, n, st) in EXPECTED.items():
        assert wide[i].llm_predicted_label == w, i
        assert narrow[i].llm_predicted_label == n, i
        assert wide[i].status == st, i
    assert wide[6].llm_predicted_label_raw == "PARSE_ERROR"
    assert narrow[9].status == "PARSE_ERROR"
    assert wide[0].llm_confidence == 0.9 and wide[0].llm_recommended_actions == ["a", "b"]
    assert wide[10].llm_confidence == pytest.approx(0.1)
    assert wide[7].llm_reasoning_summary == "Could not parse model output as JSON."


def test_request_errors_and_missing_answers(spark):
    df = spark.createDataFrame([(1, None, "timeout"), (2, None, None)],
                               "Id long, raw_response string, request_error string")
    rows = {r.Id: r for r in A.parse_triage_answers(df).collect()}
    assert rows[1].status == "REQUEST_ERROR" and rows[1].llm_predicted_label_raw == "REQUEST_ERROR"
    assert rows[1].llm_predicted_label == "INVALID_LABEL"
    assert rows[1].raw_response == "timeout"
    assert rows[1].llm_reasoning_summary.endswith("timeout")
    assert rows[2].status == "REQUEST_ERROR"


@pytest.mark.parametrize("raw,wide,narrow", [
    ("TruePositive", "TruePositive", "TruePositive"),
    (" false_positive ", "FalsePositive", "FalsePositive"),
    ("Real Threat", "TruePositive", "INVALID_LABEL"),
    ("real_threat", "TruePositive", "INVALID_LABEL"),
    ("BENIGN", "BenignPositive", "BenignPositive"),
    ("benign  positive", "BenignPositive", "BenignPositive"),
    ("true-positive", "INVALID_LABEL", "INVALID_LABEL"),
    (None, "INVALID_LABEL", "INVALID_LABEL"),
    ("PARSE_ERROR", "INVALID_LABEL", "INVALID_LABEL"),
])
def test_normalize_label(spark, raw, wide, narrow):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(raw,)], "r string")
    got = df.select(normalize_label(F.col("r")), normalize_label(F.col("r"), LABEL_ALIASES_NARROW)).collect()[0]
    assert (got[0], got[1]) == (wide, narrow)


def test_list_coercion(spark):
    df = spark.createDataFrame([
        (1, '{"recommended_actions": ["a", 2]}', None),
        (2, '{"recommended_actions": "do x"}', None),
        (3, '{"recommended_actions": "   "}', None),
        (4, '{"analyst_summary": "s"}', None),
        (5, '{"recommended_actions": {"k": 1}}', None),
    ], "Id long, raw_response string, request_error string")
    rows = {r.Id: r for r in A.parse_guidance_answers(df).collect()}
    assert rows[1].recommended_actions == ["a", "2"]
    assert rows[2].recommended_actions == ["do x"]
    assert rows[3].recommended_actions == [] and rows[4].recommended_actions == []
    assert rows[5].recommended_actions == []
    assert rows[4].containment_priority == "Unknown" and rows[4].analyst_summary == "s"
