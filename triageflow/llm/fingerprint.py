"""Document fingerprints by a homomorphic multiset hash, DataFrame functions only.

A text is the multiset of its paragraphs (lines that are not empty). Each
paragraph hashes to a wide vector of 32-bit lanes, and the fingerprint is the sum
of the vectors modulo 2**32: equal multisets have equal fingerprints in any
order, and a paragraph is put in or taken out by adding or subtracting its
vector (``combined``).

Lane 0 counts the paragraph's pieces (its sentences); ``DENSE`` lanes hold seeded
hashes of the whole paragraph; the rest form ``LEVELS`` rows of ``WIDTH`` lanes. A
piece falls to a level by the leading zeros of its hash (each level gets half of
what is left) and adds its hash to one lane there. ``likeness`` compares the
levels of two fingerprints: from the first level that is not crowded on, the
share of unequal lanes estimates how many pieces differ, and likeness is 1 minus
that over the pieces of both (0 to 1; 1 for equal fingerprints).

Null text counts as empty: no paragraph, all lanes zero. A fingerprint is
lower-case hex, 8 digits a lane.

``with_next`` gives every row the text of the next one by (doc_id, hash of the
text, text), nulls first, and the last row that of the first. Rows are dealt to
ranges of that order: segments between quantiles of doc_id, each cut evenly by
doc_id, or by the hash where a segment is one id or null ids, so that a window
sees about ``RANGE_ROWS`` rows; only the first row of a range crosses to the range
before. Repeated rows follow each other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

DENSE = 8
LEVELS = 12
WIDTH = 16
LANES = 1 + DENSE + LEVELS * WIDTH
SEGMENTS = 64
RANGE_ROWS = 100
CROWDED = 0.75
_MASK = "4294967295L"


def vector(text: str) -> Column:
    """Lanes of the text in column ``text``: an array of LANES integers below 2**32."""
    dense = ", ".join(f"aggregate(ps, 0L, (a, p) -> (a + (xxhash64({k}, p) & {_MASK})) & {_MASK})" for k in range(DENSE))
    level = " ".join(f"when shiftrightunsigned(h, {63 - k}) <> 0 then {k}" for k in range(LEVELS - 1))
    pieces = rf"transform(flatten(transform(ps, p -> split(p, '(?<=[.!?])\\s+'))), s -> xxhash64({DENSE}, s))"
    lane = (f"aggregate(mine, 0L, (a, h) -> if((shiftrightunsigned(h, 32) & {WIDTH - 1}) = w, (a + (h & {_MASK})) & {_MASK}, a))")
    lanes = (f"flatten(transform(sequence(0, {LEVELS - 1}), l -> transform(array(filter(hs, h -> case {level} else {LEVELS - 1} end = l)), "
             f"mine -> transform(sequence(0, {WIDTH - 1}), w -> {lane}))[0]))")
    paragraphs = rf"array_remove(split(coalesce(`{text}`, ''), '\n'), '')"
    return F.expr(f"transform(array({paragraphs}), ps -> transform(array({pieces}), hs -> "
                  f"concat(array(cast(size(hs) as bigint)), array({dense}), {lanes}))[0])[0]")


def as_hex(lanes: str) -> Column:
    return F.expr(f"lower(array_join(transform(`{lanes}`, x -> lpad(hex(x), 8, '0')), ''))")


def combined(a: str, b: str, sign: int = 1) -> Column:
    """Fingerprint of the union of two multisets (sign 1) or of the first
    without the second (sign -1)."""
    return F.expr(f"zip_with(`{a}`, `{b}`, (x, y) -> pmod(x + ({sign}) * y, 4294967296L))")


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    first = 1 + DENSE
    unequal = (f"transform(sequence(0, {LEVELS - 1}), l -> size(filter(sequence(0, {WIDTH - 1}), "
               f"w -> `{a}`[{first} + l * {WIDTH} + w] <> `{b}`[{first} + l * {WIDTH} + w])) / {float(WIDTH)}D)")
    level = f"coalesce(nullif(cast(array_position(transform(us, u -> u <= {CROWDED}D), true) as int), 0), {LEVELS}) - 1"
    differ = (f"transform(array({level}), l -> pow(2D, l) * aggregate(slice(us, l + 1, {LEVELS} - l), 0D, "
              f"(s, u) -> s - {float(WIDTH)}D * ln(1D - least(u, {1 - 0.5 / WIDTH}D))))[0]")
    share = f"greatest(0D, 1D - {differ} / greatest(`{a}`[0] + `{b}`[0], 1L))"
    return F.expr(f"if(`{a}` = `{b}`, 1D, transform(array({unequal}), us -> {share})[0])")


def with_next(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, next_text``, one row per row of ``docs``."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shares = ", ".join(f"{i / SEGMENTS!r}D" for i in range(1, SEGMENTS))
    r = base.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                 F.expr(f"percentile_approx(doc_id, array({shares}), 10000)").alias("cuts")).first()
    cuts = sorted(r.cuts or [])
    twice = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    # starts of the segments; an id that is several quantiles gets a segment of its own
    starts = sorted({x for x in (r.low, *cuts, *(c + 1 for c in twice)) if x is not None}) or [0]
    ends = [*starts[1:], (r.high if r.high is not None else 0) + 1]
    parts = max(1, -(-r.n // (SEGMENTS * RANGE_ROWS)))
    at = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})"
    base = base.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(
        "seg", F.expr(f"if(doc_id is null, 0, size(filter({at(starts)}, s -> s <= doc_id)))"))
    by_hash = f"least({parts - 1}, floor((h / 18446744073709551616D + 0.5D) * {parts}))"
    low, wide = f"get({at(starts)}, seg - 1)", f"(get({at(ends)}, seg - 1) - get({at(starts)}, seg - 1))"
    by_id = f"least({parts - 1}, floor((doc_id - {low}) / cast({wide} as double) * {parts}))"
    base = base.withColumn("range", F.expr(f"cast(seg * {parts}L + if(seg = 0 or {wide} <= 1, {by_hash}, {by_id}) as bigint)")).drop("seg")

    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "h", F.col("text").asc_nulls_first())
    heads = base.withColumn("k", F.row_number().over(order)).where("k = 1").select("range", "text")
    # the range after each, over the few range numbers; within a segment by a
    # window, from a segment's last range to the next segment's first by a map
    ranges = heads.select("range", F.floor(F.col("range") / parts).alias("seg"))
    firsts = sorted(x.low for x in base.groupBy(F.floor(F.col("range") / parts).alias("seg")).agg(F.min("range").alias("low")).collect())
    turn = dict(zip(firsts, [*firsts[1:], *firsts[:1]]))
    after = F.create_map(*[F.lit(x).cast("bigint") for low, nxt in turn.items() for x in (low // parts, nxt)]) if turn else F.lit(None).cast("map<bigint,bigint>")
    ranges = ranges.withColumn("after", F.coalesce(F.lead("range").over(Window.partitionBy("seg").orderBy("range")),
                                                   F.element_at(after, F.col("seg"))))
    following = (ranges.select("range", "after").join(heads.select(F.col("range").alias("after"), F.struct("text").alias("head")), "after")
                 .select("range", "head"))
    rows = base.withColumn("follows", F.lead(F.struct("text")).over(order)).join(following, "range", "left")
    return rows.select("doc_id", "text", F.coalesce(F.col("follows"), F.col("head"))["text"].alias("next_text"))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the hex fingerprint of ``text``."""
    return docs.withColumn(out, vector(text)).withColumn(out, as_hex(out))


def edited(text: str, next_text: str) -> Column:
    """The text with the last half of its code points replaced by as many (or
    all) of the first of the next text."""
    own, nxt = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(next_text), F.lit(""))
    half = F.floor(F.length(own) / 2).cast("int")
    return F.concat(F.substring(own, F.lit(1), F.length(own) - half), F.substring(nxt, F.lit(1), half))
