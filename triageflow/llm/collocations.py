"""Phrase collocations by dynamic itemset counting.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and into
words at spaces and tabs; a phrase is a run of 1 to ``LONGEST`` words of a piece,
counted per language (null: ``und``), overlaps included.

Counting: the documents are dealt into ``SHARDS`` shards that are scanned in a
cycle. They are read into words once; a shard holds them as numbers of 31 bits of a
hash, language included, with zeros between pieces. Words are counted from the first
shard on. A longer phrase becomes active in the step after both of its subphrases
(without the last, without the first word) have reached the threshold, is counted for
exactly one full cycle from there, while other lengths are counted in the same scans,
and is then complete. Counts only grow, so every phrase that reaches the threshold
becomes active. The scans end one cycle after the last phrase that can be part of a
longer one reached it.

In these scans a phrase stands by a 64-bit hash. Phrases of one hash count together,
never below their own counts. The step at which a phrase reached the threshold is
looked up in a table of fixed size (``slots`` bytes, a power of two; two slots a phrase
by its hash): a slot keeps the first step that used it, the later of two slots counts.
A slot never changes once set, so all tasks and steps agree on when a phrase became
active. A clash can only make a phrase active earlier or in vain, never before its
subphrases and for a full cycle as well: at any size no phrase is missed, a table that
fills up only prunes less.

A task emits each active phrase of a block once with its count; in-progress counts
are a table of the shared folder that each step merges with the new ones. Words,
phrases and steps of any language are rows of the same table, so no language is a
hot key. Only the table's set slots reach the driver.

The phrases that reached the threshold by their hashes are then counted by their words
in one scan of the texts, and those below it by themselves go: counts are exact whatever
the hashes.

Scoring follows in exact decimal arithmetic: of the cuts of a phrase into two parts
the lowest floor(weight * f / (l + r)) counts, ties to the shortest first part.
Phrases inside a longer candidate that is nearly as frequent go. The best of each
language are ranked in two steps, first within ``SALTS`` parts of a language.

Null texts have no words. A very long text, or piece, is cut into runs that share
their last words; equal texts and rows count each time. Ties in the ranking break by
count, then by the phrase's UTF-8 bytes. Empty table: empty result. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from triageflow.llm.common import bound_batches, discard, stored, stored_at

LONGEST = 4
THRESHOLD = 30
TOP = 2000
SHARDS = 2
SLOTS = 1 << 24
SALTS = 64
WEIGHT = 2_000_000
COVER_PERCENT = 80
NEVER = 255
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 6 << 20
DEALT_BYTES = 2 << 20
BLOCK_WORDS = 1 << 20
CUT = b"\xff"  # never part of UTF-8: stands for the end of a piece
_LINES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", CUT * 10)
_BREAK, _AHEAD = re.compile(rb"[ \t\xff]"), re.compile(rb"(?:[ \t]+[^ \t\xff]+){0,%d}" % (LONGEST - 1))
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09, 0xFF]] = 1
#: Of 16 bytes the first n.
_FIRST = np.array([[0xFF] * n + [0] * (16 - n) for n in range(17)], np.uint8).view(np.uint64)
_ONES = (1 << 64) - 1
_LATER = np.uint32(1 << 31)  # set in a word's number where the chunk before counts the phrases that start there
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def chunks(text: bytes):
    """A text, lower-cased and with ``CUT`` for the ends of pieces, in chunks of about
    ``CHUNK_BYTES``, and the bytes of each within which a phrase may start: a chunk that is
    cut off holds the next words as well."""
    line, at = text.lower().translate(_LINES), 0
    while True:
        found = _BREAK.search(line, at + CHUNK_BYTES)
        end = found.start() if found else len(line)
        yield line[at:_AHEAD.match(line, end).end()], end - at
        at = end
        if at == len(line):
            return


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def longer(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but the last word and of the last."""
    return _mixed(prefix * _MIX[0] + last)


def slots_of(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(slots - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)


def numbers_of(h: np.ndarray) -> np.ndarray:
    """Numbers of 31 bits, not zero, of words by their hashes."""
    return np.maximum(h >> np.uint64(33), np.uint64(1)).astype("<u4")


def hashes_of(numbers: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by their numbers."""
    return _mixed(numbers.astype(np.uint64) * _MIX[0])


class Places:
    """The words of some chunks in their order: ``hash``, ``lang``, ``part`` (number of
    the chunk), ``piece`` (number of the piece), ``start`` and ``end`` in ``data``."""

    def __init__(self, parts: list[bytes], langs: list[int], lang_seeds: list[int]):
        self.data = CUT.join([*parts, b" " * 16])
        byte = np.frombuffer(self.data, np.uint8)
        edge = np.diff(_KIND[byte] == 0, prepend=False, append=False)
        at = np.flatnonzero(edge)
        self.start, self.end = at[::2], at[1::2]
        self.offset = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        bounds = np.searchsorted(self.start, [*self.offset.tolist(), len(self.data)])
        self.part = np.repeat(np.arange(len(parts)), np.diff(bounds))
        self.lang = np.array(langs, np.int64)[self.part]
        self.piece = np.cumsum(byte == 0xFF, dtype=np.int32)[self.start].astype(np.int64)
        # words of up to 16 bytes are two numbers; longer ones stand by a hash of 128 bits
        size = self.end - self.start
        raw = np.lib.stride_tricks.sliding_window_view(byte, 16)[self.start].view(np.uint64) & _FIRST[np.minimum(size, 16)]
        for i in np.flatnonzero(size > 16):
            wide = xxhash.xxh3_128_intdigest(self.data[self.start[i]:self.end[i]])
            raw[i] = wide & _ONES, wide >> 64
        seeds = np.array(lang_seeds, np.uint64)[self.lang]
        self.hash = _mixed(raw[:, 0] * _MIX[0] + raw[:, 1] * _MIX[2] + seeds * _MIX[1] + np.minimum(size, 17).astype(np.uint64))
        self.told = [raw[:, 0], raw[:, 1], self.lang.astype(np.uint64), size.astype(np.uint64)]

    def laid_out(self, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words in a row with one place between pieces, and whether
        a phrase may start there."""
        return np.arange(len(self.start)) + self.piece, self.start - self.offset[self.part] < np.array(limits or [0])[self.part]


class Words(Places):
    """``code`` (number among the distinct words); of the distinct ones ``hashes`` and
    ``first`` (a word that is it)."""

    def __init__(self, parts: list[bytes], langs: list[int], lang_seeds: list[int]):
        super().__init__(parts, langs, lang_seeds)
        h, self.first, self.code = np.unique(self.hash, return_index=True, return_inverse=True)
        same = self.first[self.code]
        if any((x != x[same]).any() for x in self.told):  # two words of one hash: told apart by all of their numbers
            _, self.first, self.code = np.unique(np.column_stack(self.told), axis=0, return_index=True, return_inverse=True)
            h = self.hash[self.first]
        self.hashes = hashes_of(numbers_of(h))

    def texts(self) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(self.start[self.first].tolist(), self.end[self.first].tolist())]


def active(flat: np.ndarray, step: int, shards: int, reached: np.ndarray) -> pa.RecordBatch:
    """``hash, tag, n`` of the phrases that are counted in this step, in words given by
    their numbers (see :meth:`Block.numbers`); tag: 8 x the first step of its count + length."""
    number = flat & (_LATER - np.uint32(1))
    start = np.flatnonzero(number)
    own = (flat < _LATER)
    words = np.zeros(len(flat), np.uint64)
    words[start] = hashes_of(number[start])
    out: list[tuple] = []

    def emit(h: np.ndarray, since: int, length: int) -> None:
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        out.append((h[first].view(np.int64), np.full(len(first), 8 * since + length, np.int32), np.diff(first, append=len(h))))

    if step < shards:
        emit(words[start[own[start]]], 0, 1)
    h, known, since = words, words[start], np.zeros(len(start), np.uint8)
    for length in range(2, LONGEST + 1):
        a, b = slots_of(known, len(reached))
        when = np.full(len(flat), NEVER, np.uint8)
        # never before the step from which it is counted itself, whatever phrases share its slots
        when[start] = np.maximum(np.maximum(reached[a], reached[b]), since)
        # active once the later of the two subphrases, here and a word on, has reached it
        since = np.maximum(when[start], when[start + 1])
        start, since = start[since < NEVER], since[since < NEVER]
        known = longer(h[start], words[start + length - 1])
        for first in range(max(0, step - shards + 1), step + 1):
            emit(known[own[start] & (since == first)], first, length)
        if length < LONGEST:
            h = np.zeros(len(flat), np.uint64)
            h[start] = known
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["hash", "tag", "n"])


class Block:
    """Texts, and the phrases that a step counts in them."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.part_langs: list[int] = []
        self.limits: list[int] = []
        self.langs: dict[str, int] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        for part, limit in chunks(text):
            self.add_part(lang, part, limit)

    def add_part(self, lang: str, part: bytes, limit: int) -> None:
        self.parts.append(part)
        self.part_langs.append(self.langs.setdefault(lang, len(self.langs)))
        self.limits.append(limit)
        self.size += len(part) + 1

    def _chunks(self) -> tuple[list, list, list]:
        return self.parts or [b""], self.part_langs or [0], [xxhash.xxh32_intdigest(lang) for lang in self.langs] or [0]

    def numbers(self) -> bytes:
        """The words' numbers in their order, zeros between pieces and at the end."""
        w = Places(*self._chunks())
        place, startable = w.laid_out(self.limits)
        flat = np.zeros((int(place[-1]) if len(place) else 0) + 1 + LONGEST, "<u4")
        flat[place] = numbers_of(w.hash) | np.where(startable, np.uint32(0), _LATER)
        return flat.tobytes()

    def counted(self, step: int, shards: int, reached: np.ndarray, own: bool = False) -> pa.RecordBatch:
        """``key, since, n`` of the phrases that are counted in this step; with ``own``
        of those that have set slots themselves, and of each language's words
        together (key: tab, language)."""
        w = Words(*self._chunks())
        names = len(w.hashes) + 1
        texts = pa.array([b"", *w.texts()], pa.binary()).cast(pa.string())
        langs = pa.array([*self.langs, ""], pa.string()).take(pa.array(np.concatenate([[len(self.langs)], w.lang[w.first]])))
        hashes = np.concatenate([np.zeros(1, np.uint64), w.hashes])
        # words by number from 1, zeros between pieces
        place, may = w.laid_out(self.limits)
        flat = np.zeros((int(place[-1]) if len(place) else 0) + 1 + LONGEST, np.int64)
        flat[place] = w.code + 1
        startable = np.zeros(len(flat), bool)
        startable[place] = may
        out: list[tuple] = []

        def emit(length: int, start: np.ndarray, ids: np.ndarray, since: np.ndarray) -> None:
            """One row per distinct phrase: equal ids at the places ``start``."""
            _, at, n = np.unique(ids, return_index=True, return_counts=True)
            first = start[at]
            own = [texts.take(pa.array(flat[first + j])) for j in range(length)]
            key = pc.binary_join_element_wise(pc.binary_join_element_wise(*own, " "), langs.take(pa.array(flat[first])), "\t")
            out.append((key, since[at], n))

        in_window = lambda when: (when <= step) & (step < when + shards)
        start = np.flatnonzero(flat)
        # the step from which a word, then a phrase at a place, counts as having reached the threshold
        a, b = slots_of(hashes, len(reached))
        known = np.maximum(reached[a], reached[b])
        known[0] = NEVER
        when, h = known[flat], hashes[flat]
        if step < shards:
            use = start[startable[start] & (when[start] < NEVER)] if own else start[startable[start]]
            emit(1, use, flat[use], np.zeros(len(use), np.int32))
        for length in range(2, LONGEST + 1):
            # active once the later of the two subphrases, here and a word on, has reached it
            since = np.maximum(when[start], when[start + 1])
            start, since = start[since < NEVER], since[since < NEVER]
            if length == 2:
                ids = flat[start] * names + flat[start + 1]
            elif length == 3:
                pairs = flat[start] * names + flat[start + 1]
                if names >= 1 << 21:  # three numbers pass 63 bits
                    pairs = np.unique(pairs, return_inverse=True)[1]
                ids = pairs * names + flat[start + 2]
            else:
                pairs = np.concatenate([flat[start] * names + flat[start + 1], flat[start + 2] * names + flat[start + 3]])
                dense = np.unique(pairs, return_inverse=True)[1]
                ids = dense[:len(start)] * max(1, len(pairs)) + dense[len(start):]
            nxt = longer(h[start], hashes[flat[start + length - 1]])
            a, b = slots_of(nxt, len(reached))
            when, h = np.full(len(flat), NEVER, np.uint8), h.copy()
            # never before the step from which it is counted itself, whatever phrases share its slots
            when[start] = np.maximum(np.maximum(reached[a], reached[b]), since)
            h[start] = nxt
            use = startable[start] & in_window(since.astype(np.int64))
            if own:
                use &= when[start] < NEVER
            emit(length, start[use], ids[use], since[use].astype(np.int32))
        if own:
            n = np.bincount(w.lang[may], minlength=len(self.langs))
            out.append((pa.array(["\t" + lang for lang in self.langs], pa.string()), np.zeros(len(self.langs), np.int32), n[:len(self.langs)]))
        keys = pa.concat_arrays([k for k, _, _ in out])
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([w for _, w, _ in out])), pa.array(np.concatenate([n for _, _, n in out]))],
                                          names=["key", "since", "n"])


def _each(batch: pa.RecordBatch):
    """``shard, language, chunk, limit`` of the rows of a batch."""
    for shard, lang, text in zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        for part, limit in chunks(text or b""):
            yield shard, lang, part, limit


def _dealt(shards: int):
    def row(shard: int, block: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block.numbers()], pa.binary())], names=["shard", "words"])

    def run(batches):
        blocks = [Block() for _ in range(shards)]
        for batch in batches:
            for shard, lang, part, limit in _each(batch):
                blocks[shard].add_part(lang, part, limit)
                if blocks[shard].size >= DEALT_BYTES:
                    yield row(shard, blocks[shard])
                    blocks[shard] = Block()
        for shard, block in enumerate(blocks):
            if block.parts:
                yield row(shard, block)
    return run


def _scan(step: int, shards: int, reached):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for words in batch.column("words").to_pylist():
                held.append(np.frombuffer(words, "<u4"))
                size += len(held[-1])
                if size >= BLOCK_WORDS:
                    yield active(np.concatenate(held), step, shards, reached.value)
                    held, size = [], 0
        if held:
            yield active(np.concatenate(held), step, shards, reached.value)
    return run


def _count_words(reached):
    def run(batches):
        block = Block()
        for batch in batches:
            for _, lang, part, limit in _each(batch):
                block.add_part(lang, part, limit)
                if block.size >= BLOCK_BYTES:
                    yield block.counted(0, 1, reached.value, own=True)
                    block = Block()
        yield block.counted(0, 1, reached.value, own=True)
    return run


def _phrase() -> Column:
    return F.substring_index("key", "\t", 1)


def _lang() -> Column:
    return F.expr("substr(key, instr(key, '\t') + 1)")


def _length() -> Column:
    return F.size(F.split(_phrase(), " "))


def counts(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS,
           lang: str = "lang", text: str = "text", slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``key, n`` of all phrases found at least ``threshold`` times (key: phrase,
    tab, language), and ``lang, n`` with all words of each language."""
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    dealt, dealt_path = stored_at(spark, rows.mapInArrow(_dealt(shards), "shard int, words binary"), "shards", ("shard",))
    reached, last, step = np.full(slots, NEVER, np.uint8), 0, 0
    progress = path = None
    since, length = F.shiftright("tag", 3), F.col("tag").bitwiseAND(7)
    slot = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(slots - 1))))
    while step < max(shards, last + shards):
        if step >= NEVER:
            raise RuntimeError("more steps than a slot can tell")
        known = spark.sparkContext.broadcast(reached)
        new = (dealt.where(F.col("shard") == step % shards).select("words").mapInArrow(_scan(step, shards, known), "hash bigint, tag int, n bigint")
               .withColumn("had", F.lit(0).cast("bigint")))
        if progress is not None:
            new = new.unionByName(progress.where(since > step - shards).select("hash", "tag", "n", F.col("n").alias("had")))
        new = new.groupBy("hash", "tag").agg(F.sum("n").alias("n"), F.sum("had").alias("had"))
        before, (progress, path) = path, stored_at(spark, new, "phrases-in-progress")
        known.unpersist()
        if before:
            discard(spark, before)
        fresh = progress.where((F.col("n") >= threshold) & (F.col("had") < threshold)).select(slot.alias("slot"), (length < LONGEST).alias("grows"))
        bits = (fresh.groupBy(F.shiftright("slot", 6).alias("at"))
                .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"), F.max("grows").alias("grows")).toArrow())
        if len(bits):  # at most slots / 64 rows
            taken = bits["bits"].to_numpy()
            at, bit = np.nonzero((taken[:, None] >> np.arange(64)) & 1)
            fresh_slot = bits["at"].to_numpy()[at] * 64 + bit
            fresh_slot = fresh_slot[reached[fresh_slot] == NEVER]
            reached[fresh_slot] = step + 1
            if pc.any(bits["grows"]).as_py():
                last = step + 1
        step += 1
    discard(spark, path)
    discard(spark, dealt_path)
    known = spark.sparkContext.broadcast(np.where(reached < NEVER, 0, NEVER).astype(np.uint8))
    found = rows.mapInArrow(_count_words(known), "key string, since int, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    together = F.col("key").startswith("\t")
    found = stored(spark, found.where((F.col("n") >= threshold) | together), "phrases-complete")
    known.unpersist()
    totals = found.where(together & (F.col("n") > 0)).select(_lang().alias("lang"), "n")
    return found.where(~together), totals


def part(phrase: str, first: Column, length: Column) -> Column:
    """Words ``first`` (from 1) on of a phrase."""
    return F.array_join(F.slice(F.split(F.col(phrase), " "), first, length), " ")


def collocations(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, shards: int = SHARDS,
                 cover_percent: int = COVER_PERCENT, weight: int = WEIGHT, lang: str = "lang", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases."""
    found, totals = counts(spark, docs, threshold, shards, lang, text, slots)
    f = stored(spark, found.select(_phrase().alias("phrase"), _lang().alias("lang"), "n", _length().alias("words")), "frequent-phrases")
    of = lambda name, n: f.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    long = f.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cuts = long.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("head", part("phrase", F.lit(1), F.col("k"))).withColumn("tail", part("phrase", F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = stored(spark, cuts.join(of("head", "l"), ["lang", "head"]).select("lang", "phrase", "words", "a", "k", "tail", "l"), "cuts").join(of("tail", "r"), ["lang", "tail"])
    wide = "cast({} as decimal(20,0))".format
    score = F.expr(f"cast(({wide(weight)} * {wide('a')}) div ({wide('l')} + {wide('r')}) as bigint)")
    best = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    scored = stored(spark, best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score"), "scored")
    inner = scored.where("words > 2").select("lang", "phrase", "words", F.col("a").alias("f"), F.explode(F.expr("sequence(2, words - 1)")).alias("k"))
    inner = inner.select("*", F.explode(F.expr("sequence(1, words - k + 1)")).alias("at"))
    inner = inner.select("lang", part("phrase", F.col("at"), F.col("k")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("f") >= cover_percent * F.col("a"), F.lit(False)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
