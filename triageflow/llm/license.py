"""License scan by a positional rare-token index, DataFrame functions only.

Words: ASCII letters lower-cased, runs of ASCII letters, digits and all other
characters beyond ASCII. Templates are word sequences with a label and a
mandatory key phrase. The corpus gives each licence word its document frequency
(all documents); a template is posted under its ``RARE`` words of the highest
IDF, with their place in it. A file looks its own licence words up in the
postings, every hit names a template and where it would start (position minus
place), hits that agree on template and start are intersected, and a start that
all of the template's rare words agree on is verified word by word.

``key`` templates are the base phrases: a verified start is a place. ``text``
templates are longer passages: a start that at least half of the rare words
agree on is scored by the share of the template's words that stand at their
place, and gives its label if its key phrase stands verbatim where the template
has it and the score reaches ``TEXT_SCORE``. Files are scored by their best
template (1 for a base place, 0 without any).

Null text counts as empty. Repeated rows (equal id and text) each get the same
result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from triageflow.llm.common import stored, text_key

RARE = 4
TEXT_SCORE = 0.8

# Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Opening passages of licence texts, their label and key phrase.
TEXTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "mit", "permission is hereby granted free of charge"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "bsd", "redistribution and use in source and binary forms"),
    ("this program is free software you can redistribute it and or modify it under the terms of the",
     "gpl", "this program is free software"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "isc", "permission to use copy modify and or distribute this software"),
    ("this source code form is subject to the terms of the mozilla public license",
     "mpl", "mozilla public license"),
]


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates() -> list[dict]:
    rows = [{"id": i, "kind": "key", "label": label, "words": p.split(), "key_at": 0, "key": p.split()} for i, (p, label) in enumerate(BASE)]
    for t, label, key in TEXTS:
        w, k = t.split(), key.split()
        at = next(i for i in range(len(w)) if w[i:i + len(k)] == k)
        rows.append({"id": len(rows), "kind": "text", "label": label, "words": w, "key_at": at, "key": k})
    return rows


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = RARE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``, one row per row of ``docs``."""
    temps = templates()
    quoted = lambda ws: ", ".join(f"'{w}'" for w in sorted(ws))
    reach = max(len(t["words"]) for t in temps)

    # document frequency of every licence word over all documents
    known = F.array(*[F.lit(w) for w in sorted({w for t in temps for w in t["words"]})])
    frequency = {r.word: r.df for r in docs.select(F.explode_outer(F.array_intersect(words(F.col(text)), known)).alias("word"))
                 .groupBy("word").agg(F.count("*").alias("df")).collect()}  # no more rows than the templates have words
    index = []
    for t in temps:
        places = sorted(range(len(t["words"])), key=lambda i: (frequency.get(t["words"][i], 0), t["words"][i], i))
        places = places[:max(1, min(rare, len(places) // 2))]
        index += [(t["words"][i], t["id"], i, len(places)) for i in places]
    posted = {w for w, *_ in index}
    index = spark.createDataFrame(index, "word string, template int, place int, rares int")
    temps = spark.createDataFrame([(t["id"], t["kind"], t["label"], t["words"], t["key_at"], t["key"]) for t in temps],
                                  "template int, kind string, label string, words array<string>, key_at int, key array<string>")

    # one pass over the texts: word count, and every rare word with what stands around it
    of = F.expr(f"""transform(array(ws), ws -> struct(cast(size(ws) as bigint) as n_words, transform(
        filter(transform(ws, (w, i) -> if(w in ({quoted(posted)}), i, -1)), i -> i >= 0), i -> struct(i as pos, ws[i] as word,
        greatest(0, i - {reach - 1}) as near, slice(ws, greatest(0, i - {reach - 1}) + 1, {2 * reach}) as context)) as hits))[0]""")
    base = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), words(F.col(text)).alias("ws"))
    base = stored(spark, base.select("doc_id", "text_key", of.alias("f")).select("doc_id", "text_key", "f.n_words", "f.hits"), "licence-words")

    # the files' postings met with the templates', intersected by start
    one = base.where(F.size("hits") > 0).dropDuplicates(["doc_id", "text_key"])
    starts = (one.select("doc_id", "text_key", F.explode("hits").alias("x")).select("doc_id", "text_key", "x.*")
              .join(F.broadcast(index), "word").where(F.col("pos") >= F.col("place"))
              .groupBy("doc_id", "text_key", "template", (F.col("pos") - F.col("place")).alias("start"), "rares")
              .agg(F.count("*").alias("agree"), F.first(F.struct("near", "context")).alias("at"))
              .join(F.broadcast(temps), "template")
              .where(F.when(F.col("kind") == "key", F.col("agree") == F.col("rares")).otherwise(2 * F.col("agree") >= F.col("rares"))))

    # verified word by word
    stands = lambda seq, off: f"size(filter(transform({seq}, (w, i) -> get(at.context, start - at.near + {off} + i) <=> w), ok -> ok))"
    checked = starts.select("doc_id", "text_key", "kind", "label", "start", F.expr(f"{stands('words', 0)} / cast(size(words) as double)").alias("share"),
                            F.expr(f"{stands('key', 'key_at')} = size(key)").alias("key_ok"))
    place = (F.col("kind") == "key") & F.col("key_ok")
    passage = (F.col("kind") == "text") & F.col("key_ok") & (F.col("share") >= TEXT_SCORE)
    sorted_labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = checked.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.count(F.when(place, 1)).alias("n_base"), F.min(F.when(place, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("bigint").alias("last_word"), sorted_labels(F.when(place, F.col("label"))).alias("base_labels"),
        sorted_labels(F.when(place | passage, F.col("label"))).alias("labels"),
        F.max(F.when(place, F.lit(1.0)).when(F.col("kind") == "text", F.col("share")).otherwise(F.lit(0.0))).alias("score"))
    found = stored(spark, found, "licence-places")
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"))
