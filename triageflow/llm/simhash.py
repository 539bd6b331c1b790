"""SimHash near-duplicate classes within a Hamming radius.

Fingerprint: ASCII letters lower-cased, words between ASCII white space, XXH64
(seed 42) of every shingle of ``words`` words joined by single spaces, repeats
included; a bit is 1 if set in over half the hashes. Fewer words: one shingle of
all of them; no word or null text: fingerprint zero, linked like any other.

Links (generalised pigeonhole): the 64 bits are grouped into parts so that bits
that agree often share a part; with thresholds t_i (-1: part not used) and
sum(t_i + 1) = radius + 1, two fingerprints within the radius are within t_i in
some part i. A dynamic program picks the thresholds, and the number of parts, by
estimated candidates: pairs that agree on a part, counted over all distinct
fingerprints, times the size of the threshold's ball. Every fingerprint is
indexed by its part values, probes the values within t_i, and each candidate
pair is verified on all 64 bits.

A bucket of more than ``BUCKET`` distinct fingerprints is not paired up. All
that are in or probe such a bucket are linked exactly by half steps instead:
two are within the radius if and only if some word is within half of it of both
(radius 2: within one bit), so each emits the words within half the radius, and
those that meet at a word, at most the size of that ball, hang on their smallest.

Copies collapse into one fingerprint first (a map-side combine), so a group of
copies of any size is one node. Documents of null id belong to their class but
never name it; a class of null ids only has a null component. Repeated rows stay
repeated. A text of any length is hashed in slices of ``HASHES_AT_ONCE`` shingles. An
empty table gives an empty result. ``near_duplicates`` reads only the named columns and
``first_of_each`` returns all columns as they are, so others may have any name.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from triageflow.llm.common import bound_batches, components, free_name, stored, struct_udf, text_key

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BUCKET = 64
HASHES_AT_ONCE = 1 << 15
_PLACE = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint as a signed integer."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[words - 1:] or [len(joined)]
    digest, n, ones = xxhash.xxh64_intdigest, len(ends), np.zeros(64, np.int64)
    for k in range(0, n, HASHES_AT_ONCE):
        some = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k:k + HASHES_AT_ONCE], ends[k:k + HASHES_AT_ONCE])], np.uint64)
        places = (some.astype(">u8").view(np.uint8).reshape(-1, 8) + _PLACE).ravel()
        ones += (np.bincount(places, minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint_udf(words: int = SHINGLE_WORDS):
    return struct_udf("fp bigint", lambda texts: ((fingerprint(t, words),) for t in texts))


def bit_groups(agree: np.ndarray, parts: int) -> list[list[int]]:
    """Split the 64 bits into ``parts`` groups of nearly equal size, each grown
    from an unused bit by the bits most correlated with it."""
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (agree[group, b].sum(), -b))
            left.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def bit_correlation(counts: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlation of bits from the counts of bits set together."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)


def allocate(cost: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i from -1 to the radius with sum(t_i + 1) = radius + 1 of the
    least total cost; ``cost[i][t + 1]`` is part i's cost at threshold t."""
    best = {0: (0.0, [])}
    for row in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for k in range(radius + 2 - used):
                new = (c + row[k], [*ts, k - 1])
                if used + k not in after or new < after[used + k]:
                    after[used + k] = new
        best = after
    return best[radius + 1]


def part_value(fp: Column, bits: list[int]) -> Column:
    """The given bits of a fingerprint, packed."""
    out = F.lit(0).cast("bigint")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("bigint")), k))
    return out


def ball(width: int, radius: int) -> list[int]:
    """All words of ``width`` bits with at most ``radius`` bits set, as signed 64-bit."""
    words = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return [w - (1 << 64) if w >= 1 << 63 else w for w in words]


def _together(batches):
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = ((fp[:, None] >> np.arange(64)) & 1).astype(np.float64)
        total += np.rint(bits.T @ bits).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "n"])


def plan_parts(spark: SparkSession, fps: DataFrame, n: int, radius: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, from statistics over all distinct
    fingerprints (``fps.fp``); only 64 x 64 counts and one row per part reach
    the driver."""
    rows = fps.select("fp").mapInArrow(_together, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((64, 64))
    for r in rows:
        counts[r.i, r.j] = r.n
    agree = bit_correlation(counts, n)
    splits = {m: bit_groups(agree, m) for m in range(max(1, radius), radius + 2)}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), part_value(F.col("fp"), g).alias("v"))
            for m, groups in splits.items() for i, g in enumerate(groups)]
    seen = (fps.select(F.explode(F.array(*keys)).alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("n"))
            .groupBy("k.m", "k.i").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect())
    pairs = {(r.m, r.i): r.pairs for r in seen}
    plans = []
    for m, groups in splits.items():
        cost = [[0.0, *((n + pairs.get((m, i), 0.0)) * sum(comb(len(g), r) for r in range(t + 1)) for t in range(radius + 1))]
                for i, g in enumerate(groups)]
        plans.append((*allocate(cost, radius), m))
    _, thresholds, m = min(plans)
    return splits[m], thresholds


def links(spark: SparkSession, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) whose
    components are those of all pairs within ``radius`` bits."""
    n = fps.count()
    groups, thresholds = plan_parts(spark, fps, n, radius)
    index, probes = [], []
    for i, (bits, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        value = part_value(F.col("fp"), bits)
        index.append(fps.select("fp", F.lit(i).alias("part"), value.alias("v")))
        # a lambda of one argument: transform() hands the position to a second one, default or not
        probes.append(fps.select("fp", F.lit(i).alias("part"), F.explode(F.transform(
            F.lit(ball(len(bits), t)).cast("array<bigint>"), value.bitwiseXOR)).alias("v")))
    index, probes = _union(index), _union(probes)
    # only a probe of threshold 0 finds nothing but itself in a bucket of one
    flipped = [i for i, t in enumerate(thresholds) if t > 0]
    size = index.groupBy("part", "v").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("part").isin(flipped))
    size = stored(spark, size, "buckets")
    wide = size.where(F.col("n") > BUCKET).select("part", "v")
    met = (stored(spark, index.join(size.where(F.col("n") <= BUCKET), ["part", "v"]).select("part", "v", F.col("fp").alias("b")), "index")
           .join(probes, ["part", "v"]).where(F.col("fp") != F.col("b"))
           .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius)
           .select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")))
    dense = probes.join(wide, ["part", "v"], "left_semi").select("fp").distinct()
    return met.unionByName(_half_steps(dense, radius)).distinct()


def _half_steps(fps: DataFrame, radius: int) -> DataFrame:
    """Star edges between fingerprints that reach a common word: one within
    radius // 2, the other within the rest of the radius."""
    near, far = ball(64, radius // 2), ball(64, radius - radius // 2)
    words = F.lit(far).cast("array<bigint>")
    step = fps.select("fp", F.posexplode(F.transform(words, lambda w: F.col("fp").bitwiseXOR(w))).alias("k", "word"))
    step = step.withColumn("near", F.col("k") < len(near))
    # the smallest that is near the word reaches all that meet there, and if the
    # two halves differ the smallest of all reaches those that are near
    low = step.groupBy("word").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("low"), F.min("fp").alias("any"),
                                   F.count("*").alias("n")).where("n > 1 and low is not null")
    met = step.join(low.select("word", "low", "any"), "word")
    pairs = [met.select(F.col("low").alias("x"), F.col("fp").alias("y"))]
    if len(near) != len(far):
        pairs.append(met.where("near").select(F.col("any").alias("x"), F.col("fp").alias("y")))
    return (_union(pairs).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, fp`` (signed 64-bit),
    ``component_id`` (smallest doc_id reachable over links, itself included) and
    ``is_first`` (the smallest doc_id and text key of its class)."""
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), fingerprint_udf(words)(F.col(text)).alias("f"))
    rows = stored(spark, rows.select("doc_id", "text_key", F.col("f.fp").alias("fp")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))
    fps = stored(spark, rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct-fingerprints")
    linked = components(spark, links(spark, fps, radius))
    member = stored(spark, fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")), "members")
    name = stored(spark, member.groupBy("component").agg(F.min("first").alias("first")), "names")
    named = stored(spark, member.select("fp", "component").join(name, "component").select("fp", "first"), "named")
    return rows.join(named, "fp").select(
        "doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"),
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))).alias("is_first"))


def first_of_each(spark: SparkSession, docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (ties:
    smallest text key; of equal rows one). The rows move at most once, to meet
    the narrow list of those that stay; only rows that share both id and text with
    another one are brought together a second time. All columns stay as they are."""
    first = near_duplicates(spark, docs, words, radius, doc_id, text).where("is_first")
    kept = stored(spark, first.groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).agg(F.count("*").alias("_n")), "kept")
    key = free_name(docs, "_text_key")
    keyed = docs.withColumn(key, text_key(text))
    on = lambda some: keyed[doc_id].eqNullSafe(some["_kept_id"]) & (keyed[key] == some["_kept_key"])
    once = kept.where("_n = 1")
    out = keyed.join(once, on(once), "left_semi")
    if not kept.where("_n > 1").isEmpty():
        more = kept.where("_n > 1")
        out = out.unionByName(keyed.join(more, on(more), "left_semi").dropDuplicates([doc_id, key]))
    return out.drop(key)


def hex64(fp: str = "fp") -> Column:
    """A signed 64-bit integer as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
