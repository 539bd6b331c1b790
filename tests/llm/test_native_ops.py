"""Decontamination, fingerprints, licence scan and URL filters against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triageflow.llm import decontaminate, fingerprint, license, urlfilter

DOCS = "doc_id bigint, text string"


# ---------------------------------------------------------------- decontamination

def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def bag(ws, k):
    return Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))


def brute_leaks(docs, items, least=0.8):
    """Best window per document and item, over every window position."""
    out = {}
    lists = {i: tokens(t) for i, t in items if tokens(t)}
    ks = {i: min(5, len(w)) for i, w in lists.items()}
    for d, text in docs:
        ws = tokens(text)
        for i, w in lists.items():
            k, n = ks[i], sum(v == ks[i] for v in ks.values())
            if len(ws) < k:
                continue
            df = Counter(s for j, o in lists.items() if ks[j] == k for s in bag(o, k))
            weight = lambda s: math.log(1 + n / df[s]) if s in a else math.log(1 + n)
            a, best = bag(w, k), 0.0
            for at in range(max(1, len(ws) - len(w) + 1)):
                b = bag(ws[at:at + len(w)], k)
                lo = sum(weight(s) * min(a[s], b[s]) for s in a)
                best = max(best, lo / sum(weight(s) * max(a[s], b[s]) for s in set(a) | set(b)))
            if best >= least:
                out[d, i] = round(best, 9)
    return out


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((15, 20, 30, 40, 57, 20, 6, 3))]
    items += [(90, None), (91, " .. "), (0, items[0][1]), (92, "Same same SAME same same same same")]
    docs = []
    for d in range(60):
        ws = [word() for _ in range(rng.randint(0, 80))]
        if d % 2:
            leak = items[d % 8][1].split()
            if d % 3 == 0 and len(leak) > 25:
                leak[0] = "changed"
            if d % 5 == 0:
                leak = [w.upper() + "," for w in leak]
            at = rng.randint(0, len(ws))
            ws = ws[:at] + leak + ws[at:]
        docs.append((d, " ".join(ws)))
    docs += [(100, None), (101, ""), (102, " ".join(items[4][1].split()[2:])), (103, "same " * 30), (104, ("x y z " * 20000) + items[3][1])]
    return docs, items


def test_leaks_equal_brute_force(spark, leaky, monkeypatch):
    docs, items = leaky
    distinct = list(dict.fromkeys(items))
    want = brute_leaks([d for d in docs if d[0] != 104], distinct)
    df = spark.createDataFrame([*docs, docs[1]], DOCS).withColumn("item_id", F.lit("clash")).withColumn("row", F.lit(0))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.leaks(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got if r.doc_id != 104} == want
    assert {r.item_id for r in got if r.doc_id == 104} == {3} and len(got) == len({(r.doc_id, r.item_id) for r in got})
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)  # more blocks, same result
    again = decontaminate.leaks(spark, df, bench).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    clean = decontaminate.decontaminated(spark, df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {r.doc_id for r in got}


def test_a_reordered_item_is_found(spark):
    """Halves and thirds of an item in another order, in the middle of other text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    run = lambda n: [word() for _ in range(n)]
    a, b = run(100), run(150)
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(run(30)))]
    docs = [(1, " ".join([*run(70), *a[50:], *a[:50], *run(90)])), (2, " ".join([*run(20), *b[100:], *b[50:100], *b[:50], *run(20)])),
            (3, " ".join(run(200))), (None, " ".join([*a[50:], *a[:50]]))]
    got = decontaminate.leaks(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (None, 1)}


def test_no_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b c d e f g")], DOCS)
    assert decontaminate.leaks(spark, docs, none).collect() == []
    assert decontaminate.leaks(spark, docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).collect() == []
    assert decontaminate.decontaminated(spark, docs, none).count() == 1


def test_blocks_guarantee_the_radius():
    rng = random.Random(6)
    share = decontaminate.RADIUS // decontaminate.BLOCKS
    assert decontaminate.BLOCKS * (share + 1) > decontaminate.RADIUS
    for _ in range(300):
        x = 0
        for b in rng.sample(range(64), decontaminate.RADIUS):
            x |= 1 << b
        assert min((x >> at & (1 << w) - 1).bit_count() for at, w in decontaminate.block_bounds()) <= share


# ---------------------------------------------------------------- fingerprints

def test_next_and_edited_texts(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 5, 5, *range(300)]), rng.choice([None, "", "dup", "é😀 text " * rng.randint(1, 9), f"t{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).withColumn("range", F.lit("clash")).repartition(7)
    got = fingerprint.with_next(spark, df).collect()
    assert len(got) == 400 and sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    key = {r.text: r.h for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]], r[1] is not None, r[1] or ""))
    pairs = Counter((a, t, order[(i + 1) % 400][1]) for i, (a, t) in enumerate(order))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == pairs
    cases = spark.createDataFrame([("abcde", "xyz"), ("ab😀d", "é"), ("a", "b"), ("", "q"), (None, "q"), ("abcd", None)], "t string, n string")
    assert [r.e for r in cases.select(fingerprint.edited("t", "n").alias("e")).collect()] == ["abcxy", "abé", "a", "", "", "ab"]


@pytest.mark.parametrize("ids", [[3], [1, 2], [], [9] * 50, [None] * 30, [1, 10**15], list(range(-20, 20))])
def test_next_of_odd_ids(spark, ids):
    rows = [(d, f"text {i}") for i, d in enumerate(ids)]
    got = {r.text: r.next_text for r in fingerprint.with_next(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert sorted(got) == sorted(got.values()) == sorted(t for _, t in rows)
    at, seen = next(iter(got), None), []
    while at is not None and at not in seen:  # one ring
        seen.append(at)
        at = got[at]
    assert len(seen) == len(rows)


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).withColumn("v", fingerprint.vector("text"))
    return [r.v for r in df.orderBy("doc_id").select("v").collect()]


def test_fingerprints_are_homomorphic(spark):
    paras = ["First one. And more!", "Second? Yes.", "Third", "Third", "Fourth. Fifth. Sixth."]
    shuffled = paras[::-1]
    a, b, c, d, empty, null = prints(spark, ["\n".join(paras), "\n\n".join(shuffled), "\n".join(paras[:3]), "\n".join(paras[3:]), "", None])
    assert a == b and len(a) == fingerprint.LANES and max(a) < 1 << 32
    assert a == [(x + y) % (1 << 32) for x, y in zip(c, d)] and c == [(x - y) % (1 << 32) for x, y in zip(a, d)]
    assert empty == null == [0] * fingerprint.LANES
    row = spark.createDataFrame([(a, d, c)], "a array<bigint>, d array<bigint>, c array<bigint>").select(
        fingerprint.combined("a", "d", -1).alias("minus"), fingerprint.combined("c", "d").alias("plus"), fingerprint.as_hex("a").alias("x")).first()
    assert row.minus == c and row.plus == a and row.x == "".join(f"{x:08x}" for x in a)


def test_likeness_follows_the_shared_pieces(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(7)) + "."
    for n in (8, 60, 3000):
        own = [sentence() for _ in range(n)]
        texts = [" ".join(own), " ".join(own[:n // 2] + [sentence() for _ in range(n - n // 2)]), " ".join(sentence() for _ in range(n))]
        vs = prints(spark, texts)
        df = spark.createDataFrame([(vs[0], v) for v in (vs[0], *vs[1:])], "a array<bigint>, b array<bigint>")
        same, half, other = (r.x for r in df.select(fingerprint.likeness("a", "b").alias("x")).collect())
        assert same == 1.0 and 0.2 < half < 0.8 and other < 0.2
    with_empty = spark.createDataFrame([(vs[0], [0] * fingerprint.LANES), ([0] * fingerprint.LANES,) * 2], "a array<bigint>, b array<bigint>")
    x, y = (r.x for r in with_empty.select(fingerprint.likeness("a", "b").alias("x")).collect())
    assert x < 0.2 and y == 1.0


# ---------------------------------------------------------------- licences

def brute_licences(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in license.BASE for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licences_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "MIT", "License.", "x", "é", "1", "CC-BY", "--"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "Licensed under CC BY-NC 4.0."), (503, "the GNU General\nPublic License, version 3."), (None, "mit license"),
             (503, "the GNU General\nPublic License, version 3."), (504, "mit license " * 3000), (505, "Permission is hereby granted, free of charge, to any person "
              "obtaining a copy of this software and associated documentation files"), (506, "permission is granted to any person")]
    df = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("pos", F.lit(0))
    got = license.scan(spark, df).collect()
    assert len(got) == len(rows)
    want = Counter((d, *brute_licences(t)) for d, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[505].labels == "mit" and by[505].n_base == 0 and by[505].score == 1.0 and by[506].labels == ""
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license.scan(spark, df.limit(0)).count() == 0


# ---------------------------------------------------------------- URL filters

def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest.split("/")[0])
    path = rest[len(host):]
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "nothing", "http://", "http://com", "http://COM/", "https://www.Example.com/en/x?y#z", "a://b://c/d", "http://example.com/en/",
        "http://example.com/en", "http://notexample.com/en/", "ftp://x.net/es/1", "http://x.net/fr/?q", "http://net/es/", "http://a.b.www.example.com/en/a/b",
        "http://example.com?x=/en/", "http://example.com#/en/", "http://.com/", "http://com./", "http://x.net:80/es/", "http://é.com/é", "http://x.org/\n/en/",
        "http://" + "a." * 300 + "com/en/", "http://example.com/en/" + "p" * 5000]


def test_urls_equal_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[:5])] + [(None, URLS[6])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("prefix", F.lit("clash"))
    got = urlfilter.judge(spark, df).collect()
    assert len(got) == len(rows)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *brute_url(u)) for i, u in rows)
    assert urlfilter.judge(spark, df.limit(0)).count() == 0


def test_whole_digest_decides_and_rules_may_be_shuffled(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "PREFIX", 0)  # every expression meets every rule
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark, df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS)}


def test_edited_digest_is_of_the_whole_text(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, "x" * 100_001)], DOCS)
    for r in fingerprint.with_next(spark, df).select("text", "next_text", F.sha2(fingerprint.edited("text", "next_text"), 256).alias("h")).collect():
        half = len(r.text) // 2
        assert r.h == hashlib.sha256((r.text[:len(r.text) - half] + r.next_text[:half]).encode()).hexdigest()
