"""Language identification by a blended-spectrum string kernel.

A text is folded to 64 symbols (0: not a letter; 1 to 26: a to z; the rest: other
letters by code point modulo 37) and reduced to the sets of its n-grams for n =
1, 2, 3. The kernel of two texts is the mean over n of the shared n-grams over
the geometric mean of the two set sizes. Landmarks drawn from the training rows
give a Nystroem map (kernel to the landmarks times the inverse square root of
their kernel matrix), on which one ridge regression per language is solved, the
language against the rest; the highest output names the language and, clipped to
0..1, is the score. A batch of texts is scored by two matrix products.

Training uses at most ``TRAIN_ROWS`` rows, spread evenly over the languages and
taken in the order of a hash of the text; only their n-gram sets reach the
driver. Copies of a text count once. With more languages than ``TRAIN_ROWS`` the ones
of the most texts are learned. A text that is null or has no letter gets ``und`` and
score 0, as does every text if there is nothing to learn from. A very long text is read
in slices; of equally high outputs the first language in order wins; repeated rows get
equal results, an empty table an empty one. The column function adds one column, so
others may have any name.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from triageflow.llm.common import bound_batches, struct_udf

UNKNOWN = "und"
TRAIN_ROWS = 1200
LANDMARKS = 160
RIDGE = 1e-2
SLICE_CHARS = 1 << 20
BATCH_TEXTS = 512
SYMBOLS = 64
OFFSETS = (0, SYMBOLS, SYMBOLS + SYMBOLS ** 2)
SPACE = SYMBOLS + SYMBOLS ** 2 + SYMBOLS ** 3


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.int32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37
    return table


def grams(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted n-grams of a text that hold a letter; ``seen`` is a zeroed scratch
    array of SPACE flags, left zeroed."""
    table = symbol_table()
    text = text or ""
    for at in range(0, len(text), SLICE_CHARS):
        codes = np.frombuffer(text[max(0, at - 2):at + SLICE_CHARS].encode("utf-32-le", "replace"), np.uint32)
        one = table[codes]
        two = one[:-1] * SYMBOLS + one[1:]
        three = two[:-1] * SYMBOLS + one[2:]
        seen[one] = 1
        seen[two + OFFSETS[1]] = 1
        seen[three + OFFSETS[2]] = 1
    seen[[0, *OFFSETS[1:]]] = 0  # n-grams without a letter
    out = np.flatnonzero(seen)
    seen[out] = 0
    return out


class Kernel:
    """Kernel between texts and a fixed list of landmark texts (n-gram sets)."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.cols = np.unique(np.concatenate(landmarks))
        self.edge = np.searchsorted(self.cols, OFFSETS[1:])
        self.marks = self.scaled(landmarks)

    def scaled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Presence rows over the landmarks' n-grams, each n scaled by the root
        of the text's number of n-grams of that length."""
        out = np.zeros((len(texts), len(self.cols)), np.float32)
        for row, g in zip(out, texts):
            at = np.searchsorted(self.cols, g)
            at[at == len(self.cols)] = 0
            cut = np.searchsorted(g, OFFSETS[1:])
            size = np.diff([0, *cut, len(g)])
            weight = np.repeat(1 / np.sqrt(3 * np.maximum(size, 1)), size)
            hit = self.cols[at] == g
            row[at[hit]] = weight[hit]
        return out

    def to_landmarks(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.scaled(texts) @ self.marks.T


def train(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict | None:
    """Fit on (language, n-gram set) rows given in a fixed random order."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    order = sorted(range(len(rows)), key=lambda i: (sum(r[0] == rows[i][0] for r in rows[:i]), i))  # languages in turn
    kernel = Kernel([rows[i][1] for i in order[:landmarks]])
    value, vector = np.linalg.eigh((kernel.marks @ kernel.marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = np.concatenate([kernel.to_landmarks([g for _, g in rows[k:k + BATCH_TEXTS]]) for k in range(0, len(rows), BATCH_TEXTS)]) @ root
    target = np.array([[lang == x for x in langs] for lang, _ in rows], np.float64)
    weight = np.sqrt(len(rows) / (len(langs) * target.sum(0)))[target.argmax(1)][:, None]  # languages count alike
    a = phi * weight
    beta = np.linalg.solve(a.T @ a + ridge * len(rows) / len(langs) * np.eye(a.shape[1]), a.T @ (target * weight))
    return {"langs": langs, "kernel": kernel, "beta": (root @ beta).astype(np.float32)}


def predict(model: dict | None, texts: list[str | None]):
    """(language, score) per text, in batches of matrix products."""
    seen = np.zeros(SPACE, np.uint8)
    for k in range(0, len(texts), BATCH_TEXTS):
        sets = [grams(t, seen) for t in texts[k:k + BATCH_TEXTS]]
        if model is None:
            yield from ((UNKNOWN, 0.0) for _ in sets)
            continue
        out = model["kernel"].to_landmarks(sets) @ model["beta"]
        best = out.argmax(1)
        for g, b, s in zip(sets, best.tolist(), out.max(1).tolist()):
            yield (model["langs"][b], min(1.0, max(0.0, s))) if len(g) else (UNKNOWN, 0.0)


def training_rows(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> list[tuple[str, np.ndarray]]:
    """N-gram sets of a bounded, evenly spread sample of rows with a text and a language."""
    spark = labelled.sparkSession
    base = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"))
    # different texts, as copies count once below: a language of mostly copies keeps its quota
    counts = {r.lang: r.n for r in base.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    # a hash threshold leaves about four times the quota of each language to be ranked
    share = spark.createDataFrame([(k, min(1.0, (4 * each + 20) / n)) for k, n in counts.items()], "lang string, share double")
    near = base.join(F.broadcast(share), "lang").where(F.expr("(h / 18446744073709551616D + 0.5D) <= share"))

    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies count once

    def sets(texts):
        seen = np.zeros(SPACE, np.uint8)
        return ((grams(t, seen).tolist(),) for t in texts)

    picked = near.select("lang", "h", struct_udf("grams array<int>", sets)("text").alias("g")).select("lang", "h", "g.grams")
    picked = picked.withColumn("r", F.expr("row_number() over (partition by lang order by h)")).where(F.col("r") <= each)
    got = sorted(picked.collect(), key=lambda r: (r.h, r.lang))
    return [(r.lang, np.array(r.grams, np.int64)) for r in got]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> dict | None:
    bound_batches(labelled.sparkSession)
    return train(training_rows(labelled, text, lang, rows))


def language(spark: SparkSession, model: dict | None):
    """Column function text -> struct(lang_pred, score)."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # LANDMARKS n-gram sets
    return struct_udf("lang_pred string, score double", lambda texts: predict(shared.value, texts))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 modulo 4
    (null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
