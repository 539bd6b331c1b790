"""BPE against the tokenizers library, personal data against plain patterns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triageflow.llm import bpe, pii

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODER = bpe.Coder(bpe.load_vocabulary(PATH))
THEIRS = Tokenizer.from_file(PATH)


def theirs(text):
    ids = THEIRS.encode(text or "", add_special_tokens=False).ids
    return ids, THEIRS.decode(ids, skip_special_tokens=False)


CASES = [None, "", " ", "a", "  a  b \n\n c\x1c\x85d", "it's <|endoftext|>x<|endoftext|>", "<|endoftext|>", "日本語 テスト 😀👍🏽",
         "a" * 3000 + "  ", "​﻿ x٣٤½²", "we'LL don't \r\n\t", "x" * 70 + " " + "é" * 40, "word " * 30_000, "q" * 100_000]


def test_cases_equal_the_library():
    for got, text in zip(CODER.digests(CASES), CASES):
        ids, back = theirs(text)
        assert got == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_random_text_equals_the_library(texts):
    for t in texts:
        ids, back = theirs(t)
        assert CODER.encode(t) == ids and CODER.decode(ids) == back
    assert [n for n, _, _ in CODER.digests(texts)] == [len(theirs(t)[0]) for t in texts]


def test_documents_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("ids", F.lit("clash"))
    for r in docs.select("text", bpe.bpe_encode(spark, PATH)("text").alias("b")).collect():
        assert (r.b.ids, r.b.decoded) == theirs(r.text)


def test_lockstep_trees_equal_single_trees():
    rng = random.Random(3)
    for size in (2, 4, 8, 64):
        words = [bytes(rng.choice(b"the and ing") for _ in range(rng.randint(max(2, size // 2), size))) for _ in range(50)]
        length = np.array([len(w) for w in words])
        ids = CODER.first[np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8)].reshape(-1, size)
        for w, row in zip(words, bpe.merge_pieces(ids, length, CODER.pairs)):
            assert [x for x in row.tolist() if x >= 0] == bpe.merge_piece(CODER.first[list(w)].tolist(), CODER.merges)


def test_cache_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 16)
    c = bpe.Coder(bpe.load_vocabulary(PATH))
    texts = ["one two three four five six seven", "", "one two  three\nfour " * 9, None, "z" * 50]
    assert [c.encode(t) for t in texts] == [theirs(t)[0] for t in texts]
    assert [x[0] for x in c.digests(texts)] == [len(theirs(t)[0]) for t in texts]


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    def luhn(s):
        ds = [int(c) for c in s][::-1]
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09._%+-@ ()1234é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_known_cases():
    t = "mail a.b@c.de, 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 4041 8949-7460 8795 +1 (988) 555-2485 a@b@c.d é+49 30 1234567"
    assert pii.base_spans(t) == brute_spans(t)
    assert [k for k, _, _ in pii.base_spans(t)].count("ip") == 3
    long = "1" * 5000 + " " + "a" * 50_000 + "@x.yz " + "9." * 3000
    assert pii.base_spans(long) == brute_spans(long)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    lines = []
    for i in range(120):
        pieces = [f"{word()}.{i}@mail{i % 9}.example.com", f"{i}.{i + 7}.3.{i}", f"+1 ({200 + i}) 555-{1000 + i}", "Version 2.0.", f"id {i}"]
        lines.append(" ".join([*(word() for _ in range(8)), pieces[i % 5], *(word() for _ in range(6))]))
    return pii.train(lines, steps=160)


def test_crf_gradient_by_differences():
    rng = np.random.default_rng(0)
    e, trans = rng.standard_normal((5, 2, pii.TAGS)), rng.standard_normal((pii.TAGS, pii.TAGS))
    tags, mask = np.array([[0, 1], [1, 2], [2, 2], [0, 0], [3, 0]]), np.ones((5, 2))
    mask[4, 1] = 0
    _, de, dt = pii.crf_gradient(e, tags, mask, trans)
    for array, grad, at in [(e, de, (0, 0, 1)), (e, de, (2, 1, 3)), (e, de, (4, 1, 0)), (trans, dt, (1, 2)), (trans, dt, (0, 0))]:
        old, loss = array[at], []
        for step in (1e-5, -1e-5):
            array[at] = old + step
            loss.append(pii.crf_gradient(e, tags, mask, trans)[0])
        array[at] = old
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(grad[at], abs=1e-6)


def test_base_spans_stay_and_windows_without_a_trigger_change_nothing(model, monkeypatch):
    texts = [None, "", "plain words only, none of the four kinds here. " * 9, "call (988) 555-2485 or +1 (988) 555-2485 now",
             "x " * 400 + "joe.7@mail3.example.com" + " y" * 400, "10.1.2.3 and 10.1.2.3"]
    got = list(pii.find(model, texts))
    for t, (base, spans) in zip(texts, got):
        assert base == brute_spans(t or "") and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))

    def every_window(text):
        return [(at, text[at:at + pii.WINDOW]) for at in range(0, max(1, len(text) - (pii.WINDOW - pii.STRIDE)), pii.STRIDE)]

    monkeypatch.setattr(pii, "windows_of", every_window)
    assert list(pii.find(model, texts)) == got


def test_windows_cover_the_text_and_overlap():
    text = "".join(str(i % 10) for i in range(1000))
    ws = pii.windows_of(text)
    assert ws[0][0] == 0 and ws[-1][0] + len(ws[-1][1]) == 1000
    assert all(b - a == pii.STRIDE for (a, _), (b, _) in zip(ws, ws[1:]))


def test_reconciling_takes_the_heaviest_set():
    spans = [(5.0, 0, 10, "ip"), (4.0, 0, 4, "card"), (4.0, 5, 9, "phone"), (1.0, 20, 30, "ip"), (3.0, 20, 30, "ip"), (-1.0, 40, 50, "ip")]
    assert pii.reconciled(spans) == [("card", 0, 4), ("phone", 5, 9), ("ip", 20, 30)]
    assert pii.reconciled([]) == []


def test_redaction_and_query_columns(spark, model):
    rows = [(1, "mail a@b.cd now", "x"), (2, None, "y"), (None, "", None), (1, "mail a@b.cd now", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = df.select("doc_id", "spans", pii.redacted(spark, model)("text").alias("r")).collect()
    assert [(r.doc_id, r.spans, r.r.text, r.r.n) for r in got] == [
        (1, "x", "mail <email> now", 1), (2, "y", None, 0), (None, None, "", 0), (1, "x", "mail <email> now", 1)]
    d = df.limit(1).select(pii.pii_digest(spark, model)("text").alias("d")).first().d
    assert (d.n_email, d.n_ip, d.spans, d.base_sha256) == (1, 0, "email:5:11", hashlib.sha256(b"email:5:11").hexdigest())


def test_training_on_an_empty_table(spark):
    assert pii.training_windows(spark.createDataFrame([], "text string")) == []
