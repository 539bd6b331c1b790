"""Answers are parsed, picked and joined once, without copies of them; calls overlap freely."""

import time

from pyspark.sql import functions as F

from triageflow.functions import jsonparse as J
from triageflow.operators import answers as A
from triageflow.operators import hybrid as H

TEXTS = ['{"a":1}', ' \n{"a":1}', '{"a":1} x', 'x {"a":1} y', '[{"a":1}]', "5", "null", '"{"', "", "{", '{"a":1}{"b":2}', '1,"~end~"', '1,"~end~",null',
         '{"a":1},"~end~"', '{"a":1},"~end~",null', '{"a":[1,{"b":null}],"a":"ü"}', 'é ü {"a":"日本"} é', "{{}", '{"a":1}] junk [', "\u00a0{}\u00a0", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_object_and_its_text_agree(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for greedy in (True, False):
        own, text = J.extract_answer(F.col("t"), greedy), J.answer_text(F.col("t"), greedy)
        rows = df.select("t", F.to_json(own).alias("a"), F.to_json(J.parsed_object(text)).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
        got = {r.t: r.a for r in rows}
        assert got[' \n{"a":1}'] == got['x {"a":1} y'] == '{"a":1}' and got["\u00a0{}\u00a0"] == "{}"
        assert all(got[t] is None for t in ('[{"a":1}]', "5", "null", '"{"', "", "{", '1,"~end~"', '1,"~end~",null'))
        assert got['é ü {"a":"日本"} é'] == '{"a":"日本"}' and got['{"a":1}{"b":2}'] == (None if greedy else '{"a":1}')


def test_a_parse_tells_no_schema_and_copies_no_element(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(J.extract_answer(F.col("t")).alias("p"))
    assert "schema_of_variant" not in plan(df) and "array<variant>" not in plan(df) and "ArrayType(VariantType" not in plan(df)


def test_lists_of_every_kind(spark):
    kinds = ['["a",2,null,{"k":[1]}]', "[]", '"x"', '" "', '"[1]"', "3", "true", "null", '{"k":1}']
    df = spark.createDataFrame([('{"v": %s}' % k,) for k in kinds], "t string")
    got = [r[0] for r in df.select(J.field_list(J.extract_answer(F.col("t")), "v")).collect()]
    assert got == [["a", "2", None, '{"k":[1]}'], [], ["x"], [], ["[1]"], [], [], [], []]


ANSWERS = "Id long, raw_response string, request_error string, answered_at string"


def test_picked_answers_hold_their_text_once(spark):
    rows = [(1, "no json", None, "3"), (1, 'ü {"predicted_label": "A"} ü', None, "1"), (1, '{"predicted_label": "B"}', None, "0"), (1, None, "err", "9"),
            (2, "none", None, None), (2, None, "err", "5"), (3, None, "err", None), (4, '{"x": "{"} {"x": 1}', None, None), (None, "{}", None, None)]
    df = spark.createDataFrame(rows, ANSWERS)
    best = A.pick_answers(df, ["Id"])
    got = {r.Id: (r.raw_response, r.p) for r in best.select("Id", "raw_response", F.to_json("_parsed").alias("p")).collect()}
    assert got == {1: ('ü {"predicted_label": "A"} ü', '{"predicted_label":"A"}'), 2: ("none", None), 3: (None, None),
                   4: ('{"x": "{"} {"x": 1}', None), None: ("{}", "{}")}
    assert best.columns == ["Id", "raw_response", "request_error", "answered_at", "_parsed"]
    assert "max_by" not in plan(best)


def test_answers_do_not_pass_the_driver(spark):
    alerts = spark.createDataFrame([(1, "A"), (1, "B"), (5, "C"), (None, "D")], "Id long, label string")
    answers = spark.createDataFrame([(1, "{}", None, "0"), (None, "{}", None, "0")], ANSWERS)
    j = A.attach_answers(alerts, answers)
    assert sorted((r.label, r.raw_response) for r in j.collect()) == [("A", "{}"), ("B", "{}"), ("C", None), ("D", None)]
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()


def test_a_slow_call_holds_up_no_others(spark):
    def answer(prompt):
        time.sleep(1.5 if prompt == "p0" else 0.02)
        return str(time.time())

    prompts = spark.range(0, 12, 1, 1).select(F.col("id").alias("Id"), F.format_string("p%d", "id").alias("prompt"),
                                              F.array(F.lit("k"), F.lit(None)).alias("kind"), F.lit(b"\x00\xff").alias("raw"))
    got = H.respond(prompts, answer, keep=["kind", "raw"], in_flight=2).collect()
    assert [r.Id for r in got] == list(range(12)) and all(r.kind == ["k", None] and bytes(r.raw) == b"\x00\xff" for r in got)
    ended = [float(r.raw_response) for r in got]
    assert sum(e < ended[0] for e in ended[1:]) > 3
