"""Alert text assembly, keyword rules, prompts and records."""

import pytest
from pyspark.sql import functions as F

from triageflow.constants import FEW_SHOT_EXAMPLES, FEW_SHOT_EXAMPLE_FORMAT, FEW_SHOT_FOOTER, FEW_SHOT_HEADER, \
    HYBRID_TEMPLATE, SFT_SYSTEM_PROMPT, ZERO_SHOT_TEMPLATE
from triageflow.functions.text import py_strip
from triageflow.operators import features as feat
from triageflow.operators import prompts as P
from triageflow.streaming.classify import RAW_ALERT_SCHEMA

GOLDEN_TEXT = ("Category: InitialAccess | MitreTechniques: T1566 | EntityType: Mailbox | EvidenceRole: Impacted | "
               "DetectorId: 789 | AlertTitle: 1079 | SuspicionLevel: unknown | LastVerdict: unknown | "
               "CountryCode: 242 | State: 1445 | City: 10630 | OSFamily: 5 | OSVersion: 66")


def _raw(spark, **over):
    row = dict(Id=1, IncidentId=2, AlertId=3, Timestamp="t", Category="InitialAccess", MitreTechniques="T1566",
               EntityType="Mailbox", EvidenceRole="Impacted", DetectorId=789, AlertTitle=1079, SuspicionLevel=None,
               LastVerdict=None, CountryCode=242, State=1445, City=10630, OSFamily=5, OSVersion=66,
               IncidentGrade="TruePositive")
    row.update(over)
    return spark.createDataFrame([tuple(row[f.name] for f in RAW_ALERT_SCHEMA.fields)], RAW_ALERT_SCHEMA)


def test_alert_text_golden(spark):
    out = feat.preprocess_alerts(_raw(spark)).collect()[0]
    assert out.alert_text == GOLDEN_TEXT and out.label == "TruePositive"


def test_integral_floats_render_as_integers(spark):
    df = _raw(spark).withColumn("DetectorId", F.col("DetectorId").cast("double"))
    assert feat.preprocess_alerts(df).collect()[0].alert_text == GOLDEN_TEXT


def test_missing_column_and_null_grade(spark):
    df = _raw(spark).drop("City")
    assert "| City:  |" in feat.preprocess_alerts(df).collect()[0].alert_text
    assert feat.preprocess_alerts(_raw(spark, IncidentGrade=None)).count() == 0
    with pytest.raises(ValueError):
        feat.preprocess_alerts(_raw(spark).drop("IncidentGrade"))


@pytest.mark.parametrize("text,label", [(a, None) for a, _ in FEW_SHOT_EXAMPLES])
def test_rules_on_published_examples(spark, text, label):
    expected = {0: "TruePositive", 1: "BenignPositive", 2: "FalsePositive", 3: "TruePositive"}
    idx = [a for a, _ in FEW_SHOT_EXAMPLES].index(text)
    df = spark.createDataFrame([(text,)], "alert_text string")
    assert feat.score_rules(df).collect()[0].predicted_label == expected[idx]


def test_rule_traps(spark):
    df = spark.createDataFrame([("LastVerdict: Benign",), (None,), ("Category: Executions",)], "alert_text string")
    rows = feat.score_rules(df).collect()
    assert rows[0].benign_score == 2          # "benign" is inside "lastverdict: benign"
    assert rows[1].predicted_label == "BenignPositive"
    assert rows[2].tp_score == 1              # substring match


def test_rule_counts_sf0001(queries, spark):
    rows = queries["rule_confusion"](spark, "/root/testdata/sf0.001").collect()
    by_pred = {}
    for r in rows:
        by_pred[r.pred_label] = by_pred.get(r.pred_label, 0) + r.n
    assert sum(r.n for r in rows) == 1470
    assert by_pred == {"BenignPositive": 561, "FalsePositive": 98, "TruePositive": 811}
    assert sum(r.n for r in rows if r.true_label == r.pred_label) == 511


def test_py_strip_matches_python(spark):
    samples = ["  a b \n", "\t\nx\r\n", " y　", "", "   ", "z"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip("s")).collect()]
    assert got == [s.strip() for s in samples]


def _py_render(template, **vals):
    out = template
    for k, v in vals.items():
        out = out.replace("{" + k + "}", v)
    return out.strip()


def test_prompts_match_template_rendering(spark):
    text = "Category: Exfiltration | DetectorId: 7  \n"
    df = spark.createDataFrame([(text, "FalsePositive")], "alert_text string, ml string")
    row = df.select(P.zero_shot_prompt("alert_text").alias("z"), P.few_shot_prompt("alert_text").alias("f"),
                    P.hybrid_prompt("alert_text", "ml").alias("h")).collect()[0]
    assert row.z == _py_render(ZERO_SHOT_TEMPLATE, alert_text=text)
    assert row.z.startswith("You are a cybersecurity SOC alert triage analyst.")
    assert row.z.endswith("Security alert:\nCategory: Exfiltration | DetectorId: 7")
    few = FEW_SHOT_HEADER + "".join(FEW_SHOT_EXAMPLE_FORMAT.replace("{alert_text}", a).replace("{label}", b)
                                    for a, b in FEW_SHOT_EXAMPLES) + FEW_SHOT_FOOTER
    assert row.f == _py_render(few, alert_text=text)
    assert "Label:\nBenignPositive\n\nNow classify the new alert." in row.f
    assert row.h == _py_render(HYBRID_TEMPLATE, ml_prediction="FalsePositive", alert_text=text)
    assert '{\n  "analyst_summary"' in row.h


def test_instruction_records_and_chat(spark):
    df = spark.createDataFrame([("A: 1", "TruePositive")], "alert_text string, label string")
    r = P.instruction_records(df).collect()[0]
    assert r.instruction == SFT_SYSTEM_PROMPT
    assert r.input == "Security alert:\nA: 1\n\nReturn only JSON."
    assert r.output == '{"predicted_label": "TruePositive"}'
    msgs = df.select(P.chat_messages("alert_text").alias("m")).collect()[0].m
    assert [m.role for m in msgs] == ["system", "user"] and msgs[1].content == r.input


def test_non_empty_split(spark):
    df = spark.createDataFrame([("x",), ("  \n",), (None,), ("",)], "alert_text string")
    ok, bad = feat.split_non_empty(df)
    assert ok.count() == 1 and bad.count() == 3
