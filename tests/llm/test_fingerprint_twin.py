"""Lanes and likeness of document fingerprints recomputed in Python."""

import math
import random
import re
import struct

import xxhash

from triageflow.llm import fingerprint as fp

MASK = (1 << 32) - 1


def seeded(k, text):
    """Spark's xxhash64(k, text): the integer's hash is the text's seed."""
    return xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))


def lanes(text):
    paragraphs = [p for p in (text or "").split("\n") if p]
    pieces = [seeded(fp.DENSE, s) for p in paragraphs for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", p)]
    out = [len(pieces), *(sum(seeded(k, p) for p in paragraphs) & MASK for k in range(fp.DENSE))]
    levels = [[0] * fp.WIDTH for _ in range(fp.LEVELS)]
    for h in pieces:
        level, lane = min(fp.LEVELS - 1, 64 - h.bit_length()), h >> 32 & fp.WIDTH - 1
        levels[level][lane] = levels[level][lane] + (h & MASK) & MASK
    return out + [x for row in levels for x in row]


def likeness(a, b):
    if a == b:
        return 1.0
    first = 1 + fp.DENSE
    unequal = [sum(a[first + l * fp.WIDTH + w] != b[first + l * fp.WIDTH + w] for w in range(fp.WIDTH)) / fp.WIDTH for l in range(fp.LEVELS)]  # noqa: E741
    level = next((k for k, u in enumerate(unequal) if u <= fp.CROWDED), fp.LEVELS - 1)
    differ = 2 ** level * sum(-fp.WIDTH * math.log(1 - min(u, 1 - 0.5 / fp.WIDTH)) for u in unequal[level:])
    return max(0.0, 1 - differ / max(a[0] + b[0], 1))


def texts():
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "Gamma", "délta", "5", "x."]) for _ in range(rng.randint(1, 9))) + rng.choice([". ", "! ", "?\t", " "])
    out = [None, "", "\n\n", "One. Two! Three", "trailing. ", "a\n\nb\na"]
    for _ in range(40):
        out.append("\n".join("".join(sentence() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))))
    for t in out[6:16]:  # some edits
        out.append(t.replace("alpha", "omega", 3))
    return out


def test_lanes_and_likeness_equal_the_twin(spark):
    ts = texts()
    pairs = [(n, ts[n], ts[(n * 7 + 40) % len(ts)]) for n in range(len(ts))] + [(100 + n, ts[6 + n], ts[46 + n]) for n in range(10)]
    df = spark.createDataFrame(pairs, "n int, a string, b string").select("n", "a", "b", fp.vector("a").alias("va"), fp.vector("b").alias("vb"))
    for r in df.select("*", fp.as_hex("va").alias("h"), fp.likeness("va", "vb").alias("l")).collect():
        assert r.va == lanes(r.a) and r.vb == lanes(r.b), r.n
        assert r.h == "".join(f"{x:08x}" for x in lanes(r.a))
        assert abs(r.l - likeness(lanes(r.a), lanes(r.b))) < 1e-9


def test_paragraphs_go_in_and_out_in_any_order(spark):
    ts = ["One two. Three.\nFour", "Five!\nSix seven", "Six seven\nOne two. Three.\nFive!\nFour"]
    df = spark.createDataFrame([tuple(ts)], "a string, b string, c string").select(*[fp.vector(c).alias(c) for c in "abc"])
    df = df.withColumn("both", fp.combined("a", "b")).withColumn("less", fp.combined("both", "b", -1))
    r = df.first()
    assert r.both == r.c == lanes(ts[2]) and r.less == r.a
