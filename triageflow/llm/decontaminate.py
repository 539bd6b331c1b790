"""Benchmark decontamination with DataFrame functions only.

Words are lower-cased runs of letters and digits; shingles are ``SHINGLE_WORDS``
words (a shorter item: its whole word sequence). The similarity of two texts is
that of their shingle multisets, weighted by ln(1 + items / items that hold the
shingle): the sum of the smaller over the sum of the larger weights. For an item of
L words the windows are runs of L words of a document (the whole document if it is
shorter).

Candidates, loss-free: a window of the similarity s shares weight s of the item, so
it holds one of any shingles that weigh more than 1 - s together; the rarest ones are
taken, so that a shingle which many items share is looked up for none that has rarer
ones. They are a constant of the plan that every document's shingles are looked up
in, in the row: only documents with such a shingle are written out and go on. Of
their windows those that begin at a shared shingle, or end with the document, are as
similar as any; a running count of shared weight over unshared places bounds the
similarity of each from above (exactly, if no shared shingle repeats in the
document: then only the best goes on, else all that reach s).

Every such window, and every item, gets a 64-bit SimHash: shingles vote with the root
of their weight, repeats as elements of their own, which makes the angle between
two vote vectors that of the weighted overlap: at the similarity 0.8 or more a bit
differs with a probability of at most 0.151, and more than ``RADIUS`` of 64 differ in
1 of 10^5 pairs at exactly 0.8, in fewer above. Fingerprints are cut into
``BLOCKS`` blocks; two within ``RADIUS`` bits are within ``RADIUS // BLOCKS`` bits in at
least one block (pigeonhole). Items are indexed by every block value within
``ITEM_BITS`` and window length, windows probe every value within the rest. Pairs within
the radius are verified by the exact similarity.

Items are taken in blocks of at most ``ITEMS_AT_ONCE``, which bounds the constant; the
documents are read once a block.

Null texts and items, and those without a word, match nothing. Null and repeated ids
stay; repeated documents (equal id and text) give one row per item; of several windows
the most similar, then the first, is reported. A very long text costs in
proportion to its words, and to its shared shingles times the item's length. Empty
tables give an empty result. ``leaks`` reads only the named columns, so others may have
any name; ``decontaminated`` returns all columns as they are.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from triageflow.functions.text import let
from triageflow.llm.common import free_name, stored, text_key

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCKS = 6
RADIUS = 23
ITEM_BITS = 1
ITEMS_AT_ONCE = 5000
TABLE_BUCKETS = 1 << 14


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingled(df: DataFrame, text: str, k: int) -> DataFrame:
    """Adds ``n_words`` and ``shingles`` (hashes of each run of k words; none if
    there are fewer). The word hashes are bound once, and no filter stands on
    them, as Catalyst would copy the tokenising into it."""
    def of(h: Column) -> Column:
        run = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        return F.struct(F.size(h).alias("n"), F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), run))
                        .otherwise(F.array().cast("array<bigint>")).alias("s"))

    df = df.withColumn("_s", let(F.transform(words(F.col(text)), lambda w: F.xxhash64(w)), of))
    return df.withColumn("n_words", F.col("_s.n")).withColumn("shingles", F.col("_s.s")).drop("_s")


def simhash(hashes: str, weights: str, other: float) -> Column:
    """Bits by the votes of an array of shingles: the root of each one's weight in the
    map ``weights``, or of ``other``; a repeat votes with a hash of its own."""
    votes = F.expr(f"""struct(
        if(size(array_distinct({hashes})) = size({hashes}), {hashes}, transform({hashes}, (h, i) ->
            if(array_contains(slice({hashes}, 1, i), h), xxhash64(h, size(filter(slice({hashes}, 1, i), x -> x = h))), h))) as h,
        transform({hashes}, h -> sqrt(coalesce(try_element_at({weights}, h), {other!r}D))) as w)""")

    def bits(v: Column) -> Column:
        def bit(b: Column) -> Column:
            side = F.zip_with(v["h"], v["w"], lambda h, w: F.when(F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("bigint")) == 1, w).otherwise(-w))
            total = F.aggregate(side, F.lit(0.0), lambda x, y: x + y)
            return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))
    return let(votes, bits)


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_values(fp: str, blocks: int = BLOCKS) -> list[Column]:
    return [F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")) for at, w in block_bounds(blocks)]


def near_values(value: Column, width: int, radius: int) -> Column:
    """All block values within ``radius`` bits."""
    flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda x: value.bitwiseXOR(x))


def bag(hashes: str) -> Column:
    """Multiset of an array as a map hash -> count."""
    return F.expr(f"map_from_entries(transform(array_distinct({hashes}), h -> struct(h, size(filter({hashes}, x -> x = h)))))")


def weighted_similarity(a: str, b: str, weight: str, other: float) -> Column:
    """Weighted Jaccard of two bags; ``weight`` maps the hashes of ``a`` to their
    weights, hashes of ``b`` only weigh ``other``."""
    both = f"transform(map_keys({a}), h -> {weight}[h] * least({a}[h], coalesce({b}[h], 0)))"
    most = f"transform(map_keys({a}), h -> {weight}[h] * greatest({a}[h], coalesce({b}[h], 0)))"
    only = f"transform(filter(map_keys({b}), h -> not map_contains_key({a}, h)), h -> {other!r}D * {b}[h])"
    total = lambda x: f"aggregate({x}, 0D, (s, w) -> s + w)"
    return F.expr(f"{total(both)} / ({total(most)} + {total(only)})")


def rare_shingles(items: DataFrame, similarity: float) -> DataFrame:
    """``row, s``: of each item the rarest shingles, until they weigh more than a
    window of the similarity may lack."""
    one = items.select("row", "total", F.explode("weights").alias("s", "w"), "item_bag")
    one = one.select("row", "total", "s", "w", (F.col("w") * F.try_element_at("item_bag", "s")).alias("mass"))
    before = Window.partitionBy("row").orderBy(F.desc("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    lacking = (1 - similarity) * F.col("total") + 1e-9
    return one.withColumn("before", F.coalesce(F.sum("mass").over(before), F.lit(0.0))).where(F.col("before") <= lacking).select("row", "s")


def lookup_table(rare: DataFrame) -> Column:
    """Items by shingle, in buckets by the shingle's lowest bits, as a constant."""
    table: list[list] = [[] for _ in range(TABLE_BUCKETS)]
    for r in rare.groupBy("s").agg(F.collect_set("row").alias("rows")).collect():  # of ITEMS_AT_ONCE items
        table[r.s % TABLE_BUCKETS].append({"s": r.s, "rows": r.rows})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<s:bigint,rows:array<bigint>>>>")


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_key, item_id, similarity, start_word, window_words``: one
    row per document and item that it holds with at least ``similarity``."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t"))
    items = items.withColumn("k", F.least(F.size(words(F.col("t"))), F.lit(SHINGLE_WORDS))).where("k > 0").distinct()
    items = stored(spark, items.withColumn("row", F.xxhash64("item_id", "t")), "items")
    found = []
    for k, n in sorted((r.k, r.n) for r in items.groupBy("k").agg(F.count("*").alias("n")).collect()):
        lot = stored(spark, shingled(items.where(F.col("k") == k), "t", k), "item-shingles")
        of = lot.select("row", F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count("*").alias("df"))
        weigh = lot.select("row", F.explode(F.array_distinct("shingles")).alias("s")).join(of, "s").groupBy("row").agg(
            F.map_from_entries(F.collect_list(F.struct("s", F.log(1 + n / F.col("df"))))).alias("weights"))
        lot = lot.join(weigh, "row").select(
            "item_id", "row", F.col("n_words").alias("len"), "weights", bag("shingles").alias("item_bag"), simhash("shingles", "weights", math.log(1 + n)).alias("item_fp"),
            F.expr("aggregate(shingles, 0D, (x, h) -> x + weights[h])").alias("total"))
        lot = stored(spark, lot, "item-prints")
        blocks = -(-n // ITEMS_AT_ONCE)
        for i in range(blocks):
            part = lot.where(F.pmod("row", F.lit(blocks)) == i) if blocks > 1 else lot
            base = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_t"))
            found.append(_matches(base, part, k, n, similarity))
    if not found:
        key = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key")).limit(0)
        return key.join(items.select("item_id").limit(0), F.lit(False)).select(
            "doc_id", "text_key", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("window_words"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_window"))
    return (reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_key", "item_id").agg(best.alias("b"))
            .select("doc_id", "text_key", "item_id", F.col("b.similarity").alias("similarity"),
                    (-F.col("b.start")).alias("start_word"), F.col("b.n_window").alias("window_words")))


def _matches(base: DataFrame, items: DataFrame, k: int, n_items: int, similarity: float) -> DataFrame:
    spark, other = base.sparkSession, math.log(1 + n_items)
    table = lookup_table(rare_shingles(items, similarity))
    # looked up in the row; explode_outer, as the filter inferred for explode would tokenise a second time
    bucket = lambda s: F.get(table, F.pmod(s, F.lit(TABLE_BUCKETS)).cast("int"))
    of = lambda s: F.transform(F.filter(bucket(s), lambda x: x["s"] == s), lambda x: x["rows"])
    known = F.array_distinct(F.flatten(F.flatten(F.transform("shingles", of))))
    held = shingled(base, "_t", k).select("doc_id", "text_key", "n_words", "shingles", F.explode_outer(known).alias("row")).where(F.col("row").isNotNull())
    held = stored(spark, held, "documents-of-items")
    pairs = held.join(items.select("row", "len", "weights", "total"), "row")
    pairs = pairs.withColumn("n_window", F.least("len", "n_words")).withColumn("n_shingles", F.col("n_window") - k + 1)
    pairs = pairs.withColumn("starts", _starts(other, similarity))
    windows = pairs.select("doc_id", "text_key", "row", "len", "weights", "n_window", "n_shingles", "shingles", F.explode_outer("starts").alias("start"))
    windows = windows.where(F.col("start").isNotNull()).select(
        "doc_id", "text_key", "len", "weights", "n_window", "start", F.slice("shingles", F.col("start") + 1, F.col("n_shingles")).alias("window"))
    # stored, or the fingerprint would be computed in the filter and in the projection
    windows = stored(spark, windows, "windows")
    prints = windows.withColumn("fp", simhash("window", "weights", other)).drop("weights")
    # multi-index: within the block's share of the radius, divided between items and windows
    spread = RADIUS // BLOCKS - ITEM_BITS
    values = lambda fp, bits: F.array(*[F.struct(F.lit(i).alias("block"), near_values(v, w, bits).alias("vs"))
                                        for i, (v, (_, w)) in enumerate(zip(block_values(fp), block_bounds()))])
    index = items.select("row", "len", "item_fp", F.explode(values("item_fp", ITEM_BITS)).alias("b"))
    index = index.select("row", "len", "item_fp", "b.block", F.explode("b.vs").alias("value"))
    prints = stored(spark, prints, "window-prints").withColumn("place", F.xxhash64("doc_id", "text_key", "start", "n_window"))
    probes = prints.select("place", "len", "fp", F.explode(values("fp", spread)).alias("b")).select("place", "len", "fp", "b.block", F.explode("b.vs").alias("value"))
    near = (probes.join(index, ["len", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
            .select("place", "fp", "row").distinct())
    pairs = prints.join(near, ["place", "fp"]).join(items.select("row", "len", "item_id", "item_bag", "weights"), ["row", "len"]).withColumn("bag", bag("window"))
    pairs = pairs.withColumn("similarity", weighted_similarity("item_bag", "bag", "weights", other))
    # sums of logarithms: exactly the similarity may come out a rounding below it
    return pairs.where(F.col("similarity") >= similarity - 1e-9).select("doc_id", "text_key", "item_id", "similarity", "start", "n_window")


def _starts(other: float, similarity: float) -> Column:
    """Where the windows of a document and item begin that go on: columns ``shingles,
    weights, total, len, n_words, n_shingles``. Windows between two shared shingles hold
    no more than the one that begins at the latter."""
    hits = F.expr("""filter(transform(shingles, (h, i) -> struct(i as at, h as h, try_element_at(weights, h) as w)), x -> x.w is not null)""")

    def windows(hit: Column) -> Column:
        def bound(x: Column, i: Column) -> Column:
            start = F.least(x["at"], F.greatest(F.lit(0), F.col("n_words") - F.col("len")))
            inside = F.filter(F.slice(hit, i + 1, F.col("n_shingles")), lambda y: y["at"] < start + F.col("n_shingles"))
            shared = F.aggregate(inside, F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("n")), lambda s, y: F.struct((s["w"] + y["w"]).alias("w"), (s["n"] + 1).alias("n")))
            return let(shared, lambda s: F.struct((F.least(s["w"], F.col("total")) / (F.col("total") + other * (F.col("n_shingles") - s["n"]))).alias("most"), (-start).alias("start")))
        enough = lambda found: F.filter(found, lambda x: x["most"] >= similarity - 1e-9)
        distinct = F.size(F.array_distinct(F.transform(hit, lambda x: x["h"]))) == F.size(hit)
        kept = lambda found: F.when(distinct, F.slice(F.array_sort(found), -1, 1)).otherwise(found)
        some = lambda found: F.when(F.size(found) > 0, F.array_distinct(F.transform(kept(found), lambda x: -x["start"])))
        return let(enough(F.transform(hit, bound)), some)
    return let(hits, windows)


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   **names) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    hit = leaks(spark, docs, benchmark, doc_id, text, **names)
    hit = stored(spark, hit.select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key")).distinct(), "leaks")
    key = free_name(docs, "_text_key")
    keyed = docs.withColumn(key, text_key(text))
    on = keyed[doc_id].eqNullSafe(hit["_hit_id"]) & (keyed[key] == hit["_hit_key"])
    return keyed.join(hit, on, "left_anti").drop(key)
