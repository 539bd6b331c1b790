"""Overlapped responder calls, ranked answers, threshold split, row-local TF-IDF,
model store, ordered JSON files, JSON dumps, CSV rejects, sketches, ordinal index,
request stream."""

import glob
import json
import random
import time
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from triageflow.functions import jsonparse as J
from triageflow.operators import answers as A
from triageflow.operators import hybrid as H
from triageflow.operators import modelstore as MS
from triageflow.operators import ordering as O
from triageflow.operators import position as PO
from triageflow.operators import responders
from triageflow.operators import sampling as S
from triageflow.operators import textml as TM
from triageflow.plans import jobs
from triageflow.session import checkpoint_root
from triageflow.sources import fixtures
from triageflow.sources import io as IO
from triageflow.sources import profile as PR
from triageflow.streaming import classify as ST

SF = "/root/testdata/sf0.001"


def scratch(spark, name):
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------- responder
def test_overlapped_calls_give_the_serial_rows_in_less_time(spark):
    def slow_answer(prompt):
        time.sleep(0.05)
        if prompt.endswith("7"):
            raise TimeoutError(f"no answer to {prompt}")
        return prompt.upper()

    prompts = spark.createDataFrame([(i % 50, f"p{i}", f"note {i}") for i in range(80)], "Id long, prompt string, note string").coalesce(1)
    took, rows = {}, {}
    for in_flight in (1, 8):
        t0 = time.time()
        got = H.respond(prompts, slow_answer, keep=["note"], in_flight=in_flight).collect()
        took[in_flight] = time.time() - t0
        rows[in_flight] = [(r.Id, r.note, r.raw_response, r.request_error) for r in got]
        assert all(0.04 < r.latency_seconds < 1 for r in got)
    assert rows[1] == rows[8] and [n for _, n, _, _ in rows[8]] == [f"note {i}" for i in range(80)]  # order kept
    assert sum(e is not None for *_, e in rows[8]) == 8
    assert took[8] < took[1] / 2


def test_calls_per_second_hold_over_all_tasks(spark):
    prompts = spark.range(24).select(F.col("id").alias("Id"), F.format_string("p%d", "id").alias("prompt"))
    starts = H.respond(prompts, lambda p: str(time.time()), concurrency=2, in_flight=4, calls_per_second=20.0).collect()
    at = sorted(float(r.raw_response) for r in starts)
    assert at[-1] - at[0] >= 0.9 * 11 / 10  # two tasks of 12 calls, each 10 a second
    with pytest.raises(ValueError, match="concurrency"):
        H.respond(prompts, str, calls_per_second=5.0)
    with pytest.raises(ValueError, match="in_flight"):
        H.respond(prompts, str, in_flight=0)


def test_answered_records_equal_the_joined_ones(spark):
    alerts = jobs.processed_alerts(spark, SF).limit(200).cache()
    scored = alerts.withColumn("predicted_label", F.lit("TruePositive"))
    prompts = scored.withColumn("prompt", F.col("alert_text")).withColumnsRenamed({"label": "true_label", "predicted_label": "ml_predicted_label"})
    answers = H.materialize(spark, H.respond(prompts, responders.guidance_stub, keep=H.RECORD_COLUMNS), "t-answered")
    own = H.answered_records(answers).drop("latency_seconds")
    joined = H.hybrid_records(scored, "predicted_label", answers.select("Id", "raw_response", "request_error", "latency_seconds")).drop("latency_seconds")
    assert own.exceptAll(joined).count() == 0 and joined.exceptAll(own).count() == 0


# --------------------------------------------------------------- ranked answers
def test_the_best_answer_is_picked(spark):
    good, bad = '{"predicted_label": "TruePositive"}', "I cannot answer"
    rows = [(1, None, "timeout", "2024-03-01"), (1, good, None, "2024-01-01"), (1, bad, None, "2024-02-01"),
            (2, good, None, "2024-01-01"), (2, '{"predicted_label": "FalsePositive"}', None, "2024-02-01"), (2, good, "late", "2024-09-01"),
            (3, bad, None, "2024-01-01"), (3, None, "timeout", "2024-05-01"), (4, None, "a", None), (4, None, "b", None),
            (5, good, None, None), (5, '{"predicted_label": "BenignPositive"}', None, "2020-01-01"), (None, good, None, None)]
    df = spark.createDataFrame(rows * 3, "Id long, raw_response string, request_error string, answered_at string").repartition(5)
    got = {r.Id: r for r in A.pick_answers(df, ["Id"]).drop("_parsed").collect()}
    assert got[1].raw_response == good and got[1].request_error is None
    assert "FalsePositive" in got[2].raw_response and got[3].raw_response == bad
    assert got[4].request_error == "b" and "Benign" in got[5].raw_response and len(got) == 6
    again = {r.Id: r for r in A.pick_answers(df.coalesce(1), ["Id"]).drop("_parsed").collect()}
    assert again == got


# -------------------------------------------------------------- threshold split
def plain_split(df, quota, key):
    w = Window.partitionBy("label").orderBy(key, "Id", *[c for c in df.columns if c != "Id"])
    return df.withColumn("_r", F.row_number().over(w)).withColumn("q", F.create_map(*[x for c, q in quota.items() for x in (F.lit(c), F.lit(q))])[F.col("label")])


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_rows_that_share_an_id_are_split_like_a_plain_rank(spark, share):
    rng = random.Random(1)
    rows = [(7 if rng.random() < share else rng.randint(0, 400), rng.choice("ab"), rng.randint(0, 30), rng.choice([None, "x", "y"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "Id long, label string, v int, note string")
    key = S.order_key("Id", 42, "t")
    quota = S.split_quotas(S.class_counts(df, "label"), 0.3)
    want = plain_split(df, quota, key).where("_r <= q").drop("_r", "q")
    for parts in (1, 6):
        got = S.stratified_split(df.repartition(parts), "label", 0.3, salt="t")
        assert got.count() == 900
        test = got.where("split = 'test'").drop("split")
        assert test.exceptAll(want).count() == 0 and want.exceptAll(test).count() == 0


def test_unique_ids_are_split_in_one_scan_without_a_window(spark):
    df = spark.range(5000).select(F.col("id").alias("Id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.repeat(F.lit("x"), 50).alias("alert_text"))
    split = S.stratified_split(df, "label", 0.2, keys=df.select("Id", "label"))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Union", "Join", "Exchange"))
    assert split.where("split = 'test'").count() == 1000


def test_positions_and_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randint(0, 50), rng.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, n int").repartition(7)
    got = O.positions(df, ["v", "g", "n"]).collect()
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.position)] == sorted(rows, key=lambda r: (r[1], r[0], r[2]))
    assert sorted(r.position for r in got) == list(range(500))
    sums = O.running_sum(df.distinct(), ["g", "v", "n"], "n", "before", "g").collect()
    for g in "abc":
        own = sorted((r.v, r.n, r.before) for r in sums if r.g == g)
        assert [b for *_, b in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))]


# ------------------------------------------------------------------ text features
def test_row_local_tfidf_shuffles_no_text(spark):
    df = spark.createDataFrame([(1, "a1 bb bb cc"), (1, "a1 bb bb cc"), (2, "bb cc dd"), (3, None), (4, ""), (5, "zz")], "Id long, alert_text string")
    out = TM.tfidf_terms(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in out.collect()]
    assert {i for i, *_ in rows} == {1, 2} and len([r for r in rows if r[0] == 1]) % 2 == 0
    for i in (1, 2):
        assert sum(w * w for j, _, w in rows if j == i) == pytest.approx(2 if i == 1 else 1)


def test_term_runs_and_lookup(spark):
    df = spark.createDataFrame([(["b", "a", "b", "é"],), ([],), (["x"],)], "t array<string>")
    got = [[tuple(x) for x in r.r] for r in df.select(TM.term_runs(F.col("t")).alias("r")).collect()]
    assert got == [[("a", 1), ("b", 2), ("é", 1)], [], [("x", 1)]]
    values = {f"t{i} é": float(i) for i in range(500)}
    look = TM.term_lookup(values, buckets=16)
    words = spark.createDataFrame([(w,) for w in [*values, "no", None]], "w string")
    assert {r.w: r.v for r in words.select("w", look(F.col("w")).alias("v")).collect()} == {**values, "no": None, None: None}


# -------------------------------------------------------------------- model store
def test_model_store_reuses_and_prunes(spark, monkeypatch):
    split = jobs.stored_split(spark, SF)
    first = jobs.saved_classifier(split)
    monkeypatch.setattr(TM, "fit_tfidf_lr", lambda *a, **k: pytest.fail("fitted again"))
    again = jobs.saved_classifier(jobs.stored_split(spark, SF))  # same rows, other folder
    rows = [[(r.Id, r.predicted_label) for r in TM.predict(m, split.where("split = 'test'"), keep=["Id"]).orderBy("Id").collect()] for m in (first, again)]
    assert rows[0] == rows[1]
    train = split.where("split = 'train'")
    key = MS.fingerprint(train, ["alert_text", "label"], c=1.0)
    assert key == MS.fingerprint(train.repartition(5), ["alert_text", "label"], c=1.0)
    assert key != MS.fingerprint(train, ["alert_text", "label"], c=2.0) != MS.fingerprint(train.limit(100), ["alert_text", "label"], c=2.0)
    monkeypatch.undo()
    store = MS.ModelStore(spark, f"t-{uuid.uuid4().hex}")
    model = TM.fit_tfidf_lr(train.limit(300), max_iter=5)
    for k in "abc":
        store.load_or_fit(k, lambda: model)
        time.sleep(1.1)  # modification times of whole seconds
    assert store.keys() == ["c", "b", "a"] and store.prune(1) == ["b", "a"] and store.keys() == ["c"]


def test_relational_predictions_equal_the_models(spark):
    split = jobs.stored_split(spark, SF)
    model = jobs.saved_classifier(split)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    want = {r.Id: r.predicted_label for r in TM.predict(model, test, keep=["Id"]).collect()}
    got = {r.Id: r.predicted_label for r in TM.predict_relational(model, TM.tfidf_terms(test, fit_df=train)).collect()}
    assert got == want and TM.gradient_ratio(model, train) < 0.01


# ------------------------------------------------------------ JSON files and dumps
def test_json_files_hold_the_shuffled_order(spark):
    rows = [(i, f"t{i % 3}", f"k{(i * 7919) % 500:03d}", "ü" * (i % 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "Id long, sft_split string, shuffle_key string, text string").repartition(9)
    path = scratch(spark, "ordered-json")
    IO.write_json_records(df, path, "sft_split", order=["shuffle_key", "Id"])
    want = {s: [r[0] for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))] for s in ("t0", "t1", "t2")}
    for s in want:  # by the files themselves, part by part
        lines = [json.loads(x) for f in sorted(glob.glob(f"{path.removeprefix('file:')}/sft_split={s}/part-*")) for x in open(f, encoding="utf-8")]
        assert [x["Id"] for x in lines] == want[s]
    back = IO.read_json_in_order(spark, path, df.schema, "sft_split").collect()
    for s in want:
        assert [r.Id for r in sorted((r for r in back if r.sft_split == s), key=lambda r: r.position)] == want[s]
        assert sorted(r.position for r in back if r.sft_split == s) == list(range(len(want[s])))


def test_dumps_equal_python(spark):
    values = [["a", "b, c: d"], "close alert", 3, 3.5, -0.0, 100000.0, True, None, {"b": 1, "a": [1, {"z": "é"}]},
              ["日本", "😀", "tab\t\"q\"\\", "nl\n", "\x01\x1f", "\x7f"], [], "", {}, [1, 2.0, None, False], "back\\u00e9slash", "/"]
    rows = [(2 * i + k, json.dumps({"k": v, "o": 1}, ensure_ascii=bool(k)), json.dumps(v)) for i, v in enumerate(values) for k in (0, 1)]
    rows += [(100, '{"o":1}', "[]"), (101, "nope", "[]"), (102, 'x {"k": [1,2]} y', "[1, 2]"), (103, None, "[]"), (104, "[1]", "[]")]
    df = spark.createDataFrame(rows, "i int, raw string, want string").select("*", J.extract_answer(F.col("raw")).alias("p"), J.answer_text(F.col("raw")).alias("t"))
    for r in df.select("i", "want", J.field_dump(F.col("p"), F.col("t"), "k").alias("got")).collect():
        assert r.got == r.want, r.i


# ---------------------------------------------------------------------- CSV rejects
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_rejects_tell_file_record_and_reason(spark, ansi):
    text = 'a,b,c\n1,x,2.5\nabc,y,1\n\n3,z\n4,"q,""r""",NA\n5,w,1,9\n6.0,NA,none!\n99999999999999999999,t,\n'
    path = scratch(spark, "rejects")
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        good, bad = IO.read_csv_checked(spark, path, "a bigint, b string, c double")
        assert sorted(map(tuple, good.collect()), key=str) == [(1, "x", 2.5), (4, 'q,"r"', None)]
        rows = sorted(bad.collect(), key=lambda r: r.record)
        assert [r.record for r in rows] == [2, 3, 5, 6, 7]
        assert [r.reason.split(";")[0] for r in rows] == ['a: {"value":"abc"} is not bigint', "malformed record", "malformed record",
                                                          'c: {"value":"none!"} is not double', 'a: {"value":"99999999999999999999"} is not bigint']
        assert all(r.file.endswith(".txt") for r in rows) and "abc" in rows[0].raw
        with pytest.raises(Exception, match="abc"):
            IO.read_csv(spark, scratch_csv(spark, "a,b\nabc,2"), "a bigint, b string").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def scratch_csv(spark, text):
    path = scratch(spark, "csv")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_record_numbers_across_blocks(spark):
    path = scratch(spark, "blocks")
    lines = ["a,b", *(f"{i}{'x' if i % 100 == 7 else ''},{'t' * 40}" for i in range(1, 5001))]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = IO.read_csv_checked(spark, path, "a bigint, b string")
        assert good.count() == 4950
        assert all(r.raw.startswith(f'{{"a":"{r.record}x"') for r in bad.collect()) and bad.count() == 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# -------------------------------------------------------------------------- profile
def test_sketches_of_files_merge(spark):
    path = scratch(spark, "profile")
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 700).cast("string").alias("few"), F.when(F.col("id") % 2 == 0, F.rand(1)).alias("half"))
    df.repartition(6).write.parquet(path)
    table = spark.read.parquet(path)
    sketches = PR.file_sketches(table)
    assert sketches.select("file").distinct().count() == 6 and sketches.count() == 18
    for given in (None, sketches):
        got = {r.column_name: r for r in PR.sketch_profile(spark, table, "t", exact=["few"], sketches=given).collect()}
        assert got["id"].row_count == 20000 and got["half"].null_count == 10000 and got["few"].distinct_count == 700
        for c, n in (("id", 20000), ("few", 700), ("half", 10000)):
            assert abs(got[c].distinct_estimate - n) <= 0.05 * n
        assert got["id"].first_values == ["0", "1", "2", "3", "4"] and got["id"].data_type == "bigint" and got["half"].first_values is None


# --------------------------------------------------------------------- ordinal index
def test_positions_among_strings_that_share_their_start(spark):
    rows = [(i, "https://example.com/" * 30 + f"{i * 37 % 400:04d}") for i in range(400)]
    df = spark.createDataFrame(rows, "Id long, url string")
    want = [i for i, _ in sorted(rows, key=lambda r: r[1])]
    index = PO.ordinal_index(df, "url", ["Id"], 6)
    at = spark.createDataFrame([(p,) for p in (0, 57, 399, 400, -1)], "position long")
    assert {r.position: r.Id for r in PO.rows_at(df, index, at, "url", ["Id"]).collect()} == {p: want[p] for p in (0, 57, 399)}
    assert PO.row_at_position(df, 300, "url", max_rank_rows=50).first().Id == want[300]


# -------------------------------------------------------------------- request stream
def test_requests_go_to_one_of_two_sinks_and_replays_add_nothing(spark):
    alerts = jobs.processed_alerts(spark, SF)
    requests = fixtures.online_requests(alerts)
    src = ST.stage_files(requests, ST.scratch(spark, "t-requests"), 3)
    out, rejected, ckpt = (ST.scratch(spark, f"t-{x}") for x in ("out", "rejected", "ckpt"))
    for _ in range(2):  # a restart finds nothing new
        ST.run_request_stream(spark, src, out, rejected, ckpt, responders.guidance_stub)
    bad, ok = spark.read.parquet(rejected), spark.read.parquet(out)
    n, empty = alerts.count(), alerts.where("Id % 9 in (2, 5, 7)").count()
    assert (bad.count(), ok.count()) == (empty, n - empty) and ok.select("batch_id").distinct().count() == 3
    assert not ok.where("alert_text != trim(alert_text)").count() and {r.reason for r in bad.collect()} == {ST.EMPTY_REASON}
    batch = spark.read.schema(ST.REQUEST_SCHEMA).parquet(src)
    a, b = ST.scratch(spark, "t-a"), ST.scratch(spark, "t-b")
    for _ in range(2):
        ST.request_batch(batch, 4, responders.guidance_stub, a, b)
    assert (spark.read.parquet(b).count(), spark.read.parquet(a).count()) == (empty, n - empty)
