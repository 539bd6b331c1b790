"""Near-duplicate rows kept, recall of the decontamination, found spans of fresh
layouts, pages that are malformed or whose names say nothing, languages of copies."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_MID
from triageflow.llm import decontaminate, htmlextract, langid, pii, simhash, urlfilter
from triageflow.llm.common import free_name

DOCS = "doc_id bigint, text string"


# ------------------------------------------------------------ near duplicates
def test_one_row_of_each_class_stays(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(12)]
    rows = [(i, base[i % 12]) for i in range(40)] + [(3, base[3]), (3, base[3]), (3, "another text of the same id entirely"), (None, base[0]), (None, "x y z q"), (None, "x y z q"),
                                                     (50, None), (51, ""), (50, None)]
    df = spark.createDataFrame([(i, t, "k", n, None) for n, (i, t) in enumerate(rows)], DOCS + ", _text_key string, n int, fp string")
    got = simhash.first_of_each(spark, df)
    assert got.columns == df.columns and {r._text_key for r in got.collect()} == {"k"}
    fps = [simhash.fingerprint(t) for _, t in rows]
    classes = {}
    for (i, t), f in zip(rows, fps):  # the fingerprints of these texts are far apart
        classes.setdefault(f, []).append((i is None, i or 0, t or ""))
    assert all((a ^ b).bit_count() > 2 for a in classes for b in classes if a != b)
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()))
    assert kept == sorted(min(c, key=lambda x: (x[0], x[1], key_of(x[2]))) for c in classes.values())


def key_of(text):
    return hashlib.md5(text.encode()).hexdigest()


# ------------------------------------------------------------ decontamination
def test_recall_at_the_least_similarity(spark):
    """Items with words replaced until just above the similarity, in other text: all are found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items, docs = [], []
    for i in range(150):
        ws = [word() for _ in range(rng.randint(40, 160))]
        items.append((i, " ".join(ws)))
        leak, n = list(ws), len(ws) - 4
        while True:  # one word changed at an end or in the middle breaks 1 to 5 shingles
            at = rng.choice([0, len(leak) - 1, rng.randrange(len(leak))])
            more = [*leak[:at], "changed" + str(at), *leak[at + 1:]]
            shared = sum(more[k:k + 5] == ws[k:k + 5] for k in range(n))
            if shared / (2 * n - shared) < 0.8:
                break
            leak = more
        docs.append((i, " ".join([*(word() for _ in range(rng.randint(0, 90))), *leak, *(word() for _ in range(rng.randint(0, 90)))])))
    got = decontaminate.leaks(spark, spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(150)}
    assert min(r.similarity for r in got) >= 0.8 - 1e-9 and sum(r.similarity < 0.85 for r in got) > 60


def test_items_of_a_common_template(spark):
    """Shingles that all items and all documents share are looked up for none of them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    head = "answer the following question with one of the given choices and explain why it is right".split()
    items = [(i, " ".join([*head, *(word() for _ in range(30))])) for i in range(40)]
    docs = [(i, " ".join([*head, *(word() for _ in range(60))])) for i in range(60)] + [(100 + i, "so " + items[i][1] + " and on") for i in range(0, 40, 3)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.leaks(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + i, i) for i in range(0, 40, 3)} and all(r.start_word == 1 for r in got)
    shingles = decontaminate.shingled(bench, "text", 5)
    lot = shingles.withColumn("row", F.col("item_id")).withColumn("item_bag", decontaminate.bag("shingles"))
    lot = lot.withColumn("weights", F.expr("map_from_entries(transform(map_keys(item_bag), (h, i) -> struct(h, if(i < 12, ln(2D), ln(41D)))))"))
    lot = lot.withColumn("total", F.expr("aggregate(map_values(weights), 0D, (a, x) -> a + x)"))
    rare = decontaminate.rare_shingles(lot, 0.8)
    common = lot.select(F.col("item_id").alias("row"), F.explode(F.slice(F.map_keys("item_bag"), 1, 12)).alias("s"))
    assert rare.join(common, ["row", "s"]).count() == 0 and 0 < rare.count() < 40 * 12


# ----------------------------------------------------------------- personal data
@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet(f"{SF_MID}/documents.parquet"))


@pytest.fixture(scope="module")
def plain_texts(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").where("length(text) > 300").select("text").distinct().orderBy("text").collect()
    return [r.text for r in docs if not pii._TRIGGER.search(r.text)]


def test_every_made_up_span_can_be_returned():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        piece, kind = pii.layouts(rng)
        assert kind is None or pii.valid(kind, piece) or (kind, 0, len(piece)) in pii.base_spans(piece), piece


def test_spans_of_fresh_layouts_are_found(tagger, plain_texts):
    rng, pick = np.random.default_rng(99), random.Random(3)
    texts, want = [], []
    while len(texts) < 500:
        piece, kind = pii.layouts(rng)
        base = plain_texts[pick.randrange(len(plain_texts))]
        at = base.find(" ", pick.randrange(len(base) - 50))
        text = f"{base[:at]} {piece}{base[at:]}"
        if at > 0 and not (kind and pii.base_spans(text)):
            texts.append(text)
            want.append(kind and (kind, at + 1, at + 1 + len(piece)))
    found = list(pii.find(tagger, texts))
    for kind in pii.KINDS:
        own = [w in spans for w, (_, spans) in zip(want, found) if w and w[0] == kind]
        assert len(own) >= 10 and sum(own) >= 0.9 * len(own), (kind, sum(own), len(own))
    wrong = sum(len(spans) > len(base) for w, (base, spans) in zip(want, found) if w is None)
    assert wrong <= 0.02 * sum(w is None for w in want)


def test_long_spans_are_found_at_every_place(tagger):
    for long in ("ab.cd_42 @ example.com", "jonathan.smithson.the_third-of-name42 @ rather-long.example.com"):
        texts = [f"{('lorem ipsum dolor sit amet ' * 20)[:200 + k]} {long} {'consectetur adipiscing elit ' * 10}" for k in range(pii.STRIDE)]
        hits = [("email", 201 + k, 201 + k + len(long)) in spans for k, (_, spans) in enumerate(pii.find(tagger, texts))]
        assert sum(hits) >= 0.9 * len(hits), (len(long), sum(hits), len(hits))


def test_viterbi_equals_enumeration():
    """Best tag sequence of short windows against all sequences."""
    from itertools import product
    rng = np.random.default_rng(2)
    e, t = rng.standard_normal((4, 3, pii.TAGS)).astype(np.float32), rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    got = pii.viterbi(e, np.ones((4, 3), np.float32), t)
    for b in range(3):
        score = lambda s: pii.START[s[0]] + sum(e[k, b, x] for k, x in enumerate(s)) + sum((t + pii.ALLOWED)[x, y] for x, y in zip(s, s[1:]))  # noqa: E731,B023
        assert tuple(got[:, b]) == max(product(range(pii.TAGS), repeat=4), key=score)


# -------------------------------------------------------------------------- pages
@pytest.fixture(scope="module")
def labeller(spark):
    return htmlextract.fit(spark.read.parquet(f"{SF_MID}/pages.parquet"))


PROSE = [f"Sentence {k} of this page tells in plain words how the matter went on that day." for k in range(8)]


@pytest.mark.parametrize("around", [
    '<article class="sidebar-article">%s</article>', '<article class="post"><div class="related-work">%s</div></article>',
    '<div class="post"><div class="related-work">%s</div></div>', '<article><section id="notice-period">%s</section></article>',
    '<div id="page"><main class="site-main menu-open">%s</main></div>'])
def test_names_of_an_article_and_its_topics_keep_its_text(labeller, around):
    body = "".join(f"<p>{s}</p>" for s in PROSE)
    page = f"<html><body><nav><a href='/'>Home</a><a href='/x'>More</a></nav>{around % body}<footer><p>© someone</p></footer></body></html>"
    assert list(htmlextract.extract(labeller, [page])) == [" ".join(PROSE)]


def test_raw_elements_by_the_rules_of_html():
    texts = lambda page: [t for t, _, _ in htmlextract.blocks(page)]
    assert texts("<article><p>a <math><mi>x</mi></math> b <object>c</object></p><noscript>d<p>e</p></article>f") == ["a x b c", "d", "e", "f"]
    assert texts("<p>a<svg><text>no</text></svg>b<template><p>no</p></template>c</p><div><template>never closed</div>d") == ["ab", "c", "d"]
    assert texts("a<script>if (x < y) '</p>'</script>b<style>p {}</STYLE >c<textarea>no<p></textarea>d<xmp>no") == ["abcd"]
    assert texts("<p title='a > b'>c</p> 1 < 2 <b class=\"x\">d</b> <!-- <p>no --> e <!doctype x> f") == ["c", "1 < 2 d e f"]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\"", "<div>x", "<!", "<", "<p>x", "<ul><li>x", "</b>", "<a href='x\">", "<script>", "<!-- ", "&#x", "<b"])
def test_malformed_pages_of_a_megabyte_take_seconds(labeller, piece):
    page = piece * ((1 << 20) // len(piece))
    t0 = time.time()
    found = htmlextract.blocks(page)
    assert time.time() - t0 < 30
    if len(found) < 1000:
        assert len(list(htmlextract.extract(labeller, [page]))) == 1


def test_pages_whose_names_say_nothing(labeller):
    """Only text, links and order tell the article from the rest."""
    rng = random.Random(7)
    right = wrong = 0
    for _ in range(60):
        div = lambda inner: f'<div class="q{rng.randint(100, 999)}">{inner}</div>'  # noqa: E731,B023
        links = lambda n: "".join(f'<div><a href="/{k}">{rng.choice(["Home", "About us", "News", "Contact", "Sports", "More"])}</a></div>' for k in range(n))  # noqa: E731,B023
        body = rng.sample(PROSE, rng.randint(3, 8))
        page = f"<html><body>{div(links(rng.randint(3, 8)))}{div('<h1>On that day</h1>' + ''.join(f'<p>{s}</p>' for s in body))}{div(links(rng.randint(2, 6)))}</body></html>"
        blocks = htmlextract.blocks(page)
        (keep,) = htmlextract.labelled(labeller, [blocks])
        for (text, path, _), yes in zip(blocks, keep):
            assert not htmlextract.outside(path)  # no name has a say
            right, wrong = right + (yes == (text in body or text == "On that day")), wrong + (yes != (text in body or text == "On that day"))
    assert right >= 0.95 * (right + wrong), (right, wrong)


# ------------------------------------------------------------ languages and names
def test_a_language_of_mostly_copies_is_learned(spark):
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(200)] for lang, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(60))
    copies = text("bb")
    rows = [("aa", text("aa")) for _ in range(300)] + [("bb", text("bb")) for _ in range(60)] + [("bb", copies)] * 20_000
    got = langid.training_rows(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    n = {lang: sum(x == lang for x, _ in got) for lang in words}
    assert n["bb"] == 61 and n["aa"] == 300


def test_rules_of_none_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/x"), (2, None)], "page_id bigint, url string")
    got = urlfilter.judge(spark, pages, urlfilter.rule_table(spark, [])).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, None, "allow"), (2, None, "allow")}
    assert free_name(pages.withColumn("_x", F.lit(1)).withColumn("_X_", F.lit(1)), "_x") == "_x__"


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.withColumns({c: F.lit(c) for c in ("_text_key", "_language", "_pii", "_bpe", "row", "s", "fp", "shingles", "_t")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns
        assert {tuple(r[c] for c in odd.columns[5:]) for r in out.collect()} <= {tuple(odd.columns[5:])}
    assert "_bpe" not in corpus_pipeline.tokenised(spark, odd, "/root/testdata/sf0.001").columns
