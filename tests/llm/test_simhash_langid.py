"""SimHash classes and language ID against brute force and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from triageflow.llm import langid, simhash

DOCS = "doc_id bigint, text string"


def brute_fingerprint(text, words=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + words]) for i in range(len(ws) - words + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(rows, radius=2):
    """component per row by comparing all pairs."""
    fps = [brute_fingerprint(t) for _, t in rows]
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                own[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps)) if d is not None)


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "A b", "x\x0by\x0cz  q", "Ünï cödé ÄÖ text here", "w " * 40000,
                 *(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(40))]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def test_classes_equal_brute_force_with_ties_nulls_and_extra_columns(spark):
    rng = random.Random(2)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 400)) for _ in range(900))
    ws = base.split()
    rows = [(100, base), (7, base), (7, base), (None, base), (None, None), (3, None), (4, ""), (5, " \t"), (6, "one"), (8, "ONE")]
    for k in range(40):  # near copies: a word or two changed
        copy = list(ws)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 9999)}"
        rows.append((200 + k, " ".join(copy)))
    rows += [(300 + k, " ".join(rng.choice("abcdefghij") * 3 for _ in range(30))) for k in range(30)]
    df = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("x")).withColumn("text_key", F.lit(1)).withColumn("component", F.lit(2))
    got = simhash.near_duplicates(spark, df).select("doc_id", simhash.hex64("fp").alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.f, r.component_id) for r in got if r.doc_id is not None) == brute_classes(rows)
    kept = simhash.first_of_each(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_classes(rows)})


@pytest.mark.parametrize("radius,bucket", [(2, 64), (2, 2), (3, 64), (3, 2), (1, 2)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, radius, bucket):
    """Buckets over the bound go by half steps; both ways lose no link."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(radius * 10 + bucket)
    fps = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(15):
            x = center
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    got = simhash.components(spark, simhash.links(spark, spark.createDataFrame([(f,) for f in fps], "fp bigint"), radius))
    component = {r.node: r.component for r in got.collect()}
    own = {f: f for f in fps}

    def root(f):
        while own[f] != f:
            f = own[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                own[y] = x
    assert {f: component.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_a_crowded_part_loses_no_link(spark):
    """Skew makes the program flip bits of the other parts: a bucket of one counts there."""
    rng = random.Random(5)
    crowd, planted = rng.getrandbits(22), []
    fps = {(rng.getrandbits(42) << 22) | crowd for _ in range(700)} | {rng.getrandbits(64) for _ in range(1000)}
    for f in sorted(fps)[:400]:
        a, b = rng.sample(range(64), 2)
        planted.append((f, f ^ (1 << a) ^ (1 << b)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    fps = sorted({signed(f) for f in fps | {f for p in planted for f in p}})
    df = simhash.stored(spark, spark.createDataFrame([(f,) for f in fps], "fp bigint"), "crowded")
    _, thresholds = simhash.plan_parts(spark, df, len(fps), 2)
    assert max(thresholds) >= 1
    component = {r.node: r.component for r in simhash.components(spark, simhash.links(spark, df)).collect()}
    values = np.array(fps, np.int64).view(np.uint64)
    for k, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ f) <= 2):
            assert component.get(fps[k], fps[k]) == component.get(fps[j], fps[j])
    assert all(component[signed(a)] == component[signed(b)] for a, b in planted)


def test_thresholds_keep_the_pigeonhole():
    cost = [[0, 5, 9, 30], [0, 1, 2, 3], [0, 50, 60, 70]]
    total, ts = simhash.allocate(cost, 2)
    assert sum(t + 1 for t in ts) == 3 and total == 3 and ts == [-1, 2, -1]
    groups = simhash.bit_groups(np.eye(64), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_empty_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(spark, empty).count() == 0
    assert langid.fit(empty.withColumn("lang", F.lit("en"))) is None


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    rows = docs.where(langid.held_out()).select("lang", langid.language(spark, model)("text").alias("p")).select("lang", "p.*").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 200 and right / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_is_a_function_of_the_text_only(spark):
    train = [("en", f"the quick brown fox number {i} jumps over the lazy dog again and again") for i in range(20)]
    train += [("de", f"der schnelle braune fuchs nummer {i} springt über den faulen hund und wieder zurück") for i in range(20)]
    model = langid.train([(lang, langid.grams(t, np.zeros(langid.SPACE, np.uint8))) for lang, t in train])
    texts = [None, "", "12 34 !!", "the lazy fox", "der faule Hund", "the lazy fox", "日本語", "fox " * 600_000]
    got = list(langid.predict(model, texts))
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == "en" == got[7][0] and got[4][0] == "de" and got[3] == got[5]
    assert got[6][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, s in got)


def test_kernel_equals_its_definition():
    seen = np.zeros(langid.SPACE, np.uint8)
    texts = ["abc abd", "abcd", "xyz", "the cat sat"]
    sets = [langid.grams(t, seen) for t in texts]
    assert not seen.any()
    k = langid.Kernel(sets).to_landmarks(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want = 0.0
            for lo, hi in zip(langid.OFFSETS, (*langid.OFFSETS[1:], langid.SPACE)):
                x, y = ({g for g in s if lo <= g < hi} for s in (a, b))
                want += len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) / 3
            assert k[i, j] == pytest.approx(want, abs=1e-5)


def test_held_out_is_the_contract_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint")
    for r in df.select("doc_id", langid.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
