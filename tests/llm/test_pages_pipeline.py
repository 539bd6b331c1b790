"""WARC round trips, HTML extraction and the corpus pipeline."""

import glob
import gzip
import hashlib
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triageflow.llm import bpe, decontaminate, htmlextract, langid, pii, simhash, warc
from triageflow.session import checkpoint_root

PAGES = "page_id bigint, url string, html string"


def folder(spark):
    return f"{checkpoint_root(spark)}/test-warc-{uuid.uuid4().hex}"


def brute_records(rows):
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        least = min((j for j, _, h in rows if j is not None and (h or "").encode() == data), default=None)
        again = i is not None and len(data) >= 100 and least < i
        out.append((i, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None))
    return out


ROWS = [(1, "http://a", "x" * 99), (2, "http://b", "x" * 99), (3, None, "y" * 100), (7, "u", "y" * 100), (5, "u\r\nv", "y" * 100), (None, "n", "y" * 100),
        (8, "", None), (9, "e", ""), (10, "w", "WARC/1.1\r\n" * 40), (11, "w", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
        (12, "z", "é😀\r\n" * 90), (13, "z", "\r\n" * 60), (3, None, "y" * 100), (14, "q", "W" * 500 + "\r\nWARC/1.1\r\n" + "A" * 500)]


@pytest.mark.parametrize("size,compression,splits", [(64, "none", ("1511", "128m")), (7, "none", ("16k",)), (1000, "gzip", ("128m",))])
def test_archives_round_trip(spark, size, compression, splits):
    rng = random.Random(size)
    rows = ROWS + [(100 + i, f"u{i}", "".join(rng.choice(["\r\n", "WARC/1.1", "a", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(rows, PAGES).withColumn("data", F.lit("clash")).withColumn("chunk", F.lit(0)).repartition(3)
    path = folder(spark)
    warc.write_archives(spark, df, path, size=size, compression=compression)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in splits:  # a file read in many splits gives the same records
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = sorted(map(tuple, warc.read_archives(spark, path).collect()), key=str)
            want = [(i, u and u.replace("\r", "%0A").replace("\n", "%0A"), *rest) for i, u, *rest in brute_records(rows)]
            assert got == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_segments_carry_the_payload_and_running_digests(spark):
    html = "0123456789" * 100
    path = folder(spark)
    df = spark.createDataFrame([(1, "u", html)], PAGES)
    warc.write_archives(spark, df, path, size=300)
    rows = sorted(warc.read_segments(spark, path).collect(), key=lambda r: r.segment)
    assert [r.record_type for r in rows] == ["response"] + ["continuation"] * 3 and b"".join(r.data for r in rows).decode() == html
    table = sorted(warc.chunk_rows(spark, df, "page_id", "url", "html", 300).collect(), key=lambda r: r.chunk)
    assert [r.running_digest for r in table] == [hashlib.sha256(html[:n].encode()).hexdigest() for n in (300, 600, 900, 1000)]
    assert {r.payload_digest for r in table} == {hashlib.sha256(html.encode()).hexdigest()}
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/*.gz"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"Content-Length: ") == 4


def test_damaged_archives_are_refused(spark):
    path = folder(spark)
    warc.write_archives(spark, spark.createDataFrame([(1, "u", "payload " * 50)], PAGES), path, compression="none")
    text = spark.read.text(path, wholetext=True).where("value <> ''").first().value
    for bad in (text.replace("payload", "damaged", 1), text[:-40]):
        other = folder(spark)
        spark.createDataFrame([(bad,)], "value string").coalesce(1).write.text(other, lineSep="\n")
        with pytest.raises(Exception, match="digest|announced"):
            warc.read_archives(spark, other).collect()


def test_archives_of_an_empty_table(spark):
    path = folder(spark)
    warc.write_archives(spark, spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


# ---------------------------------------------------------------- HTML

def test_blocks_of_a_page():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body><!-- <p>no</p> --><nav><ul>"
            "<li><a href='/x>y'>One</a></li><li>Two</ul></nav><article class=\"post\"><h1>Head&amp;line</h1><p>a <b>b\n&eacute;</b>c<br>d<p>e&nbsp;f"
            "<p>unclosed <b>bold<p>next</article><p>x < y & z <img src=a> i<i>n</i>line</body>")
    got = htmlextract.blocks(page)
    assert [t for t, _, _ in got] == ["One", "Two", "Head&line", "a b éc", "d", "e f", "unclosed bold", "next", "x < y & z inline"]
    assert got[2][1] == (("<html",), ("<body",), ("<article", "post"), ("<h1",)) and got[0][2] == 1.0 and got[1][2] == 0.0
    assert got[7][1][-1] == ("<p",)
    for odd in (None, "", "   ", "<", "<p", "<script>never closed", "<!-- never closed", "</p></div>", "<a" * 500):
        assert isinstance(htmlextract.blocks(odd), list)
    assert htmlextract.blocks("plain words")[0][0] == "plain words"


def article(page):
    """Brute force for the test tables: what stands between the article tags."""
    import html
    import re
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside[1])).split()) if inside else ""


@pytest.fixture(scope="module")
def labeller(spark):
    return htmlextract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_extraction_equals_the_articles(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("text", F.lit("clash"))
    rows = pages.select("html", htmlextract.main_text(spark, labeller)("html").alias("m")).collect()
    assert [r.m.text for r in rows] == [article(r.html) for r in rows]
    assert all(r.m.n_chars == len(r.m.text) for r in rows)


def test_extraction_of_other_layouts(labeller):
    body = "<p>" + "</p><p>".join(f"Paragraph {i} tells a story about many plain things." for i in range(6)) + "</p>"
    other = ("<div class='navbar'><a href='/'>Home</a><a href='/a'>About</a></div>", "<div class='sidebar'><p>Popular posts</p></div>",
             "<div id='comments'><p>Nice one, thanks!</p></div>", "<div class='cookie-notice'><p>We use cookies.</p></div>",
             "<form><p>Subscribe</p><input></form>", "<footer><p>© someone</p></footer>")
    want = " ".join(f"Paragraph {i} tells a story about many plain things." for i in range(6))
    got = list(htmlextract.extract(labeller, [f"<html><body>{other[0]}<main>{body}</main>{''.join(other[1:])}</body></html>",
                                              f"<html><body>{other[0]}{other[1]}<div class='content'>{body}</div>{''.join(other[2:])}</body></html>",
                                              None, "", "<script>x</script>"]))
    assert got == [want, want, "", "", ""]
    assert got[:1] * 2 == list(htmlextract.extract(labeller, [f"<html><body>{other[0]}<main>{body}</main>{''.join(other[1:])}</body></html>"] * 2))


@pytest.mark.parametrize("head,inner", [
    ("<html><body class='no-sidebar'><article>", "<p>x</p>"), ("<html class='cookies'><body><main>", "<p>x</p>"),
    ("<html><body><div class='header-fixed'><article>", "<p>x</p>"), ("<html><body><article>", "<h2 id='related-work'>x</h2>"),
    ("<html><body><article>", "<h3 id='social-impact'>x</h3>"), ("<html><body><article>", "<p id='notice-period'>x</p>")])
def test_names_of_layouts_and_topics_veto_nothing(head, inner):
    ((_, path, _),) = htmlextract.blocks(head + inner)
    assert not htmlextract.outside(path) and htmlextract.semantic_label(path)
    ((_, path, _),) = htmlextract.blocks(f"{head}<div class='ad'>{inner}")
    assert htmlextract.outside(path) and not htmlextract.semantic_label(path)


def test_long_page(labeller):
    page = "<html><body><nav><a>x</a></nav><article>" + "<p>A line of the text.</p>" * 5000 + "</article></body></html>"
    (text,) = htmlextract.extract(labeller, [page])
    assert text == " ".join(["A line of the text."] * 5000)


# ---------------------------------------------------------------- pipeline

def test_stages_call_the_dealt_operators_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "tokenised"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", None), (10_002, "12 34 --", "en", "s", 8), (None, "the same text of a row without an id", None, None, None)],
                                docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    seen = np.zeros(langid.SPACE, np.uint8)
    kept = corpus_pipeline.language_id(spark, docs, sf)
    lettered = [(d, t) for d, t in rows if len(langid.grams(t, seen))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, lettered))
    assert kept.columns == docs.columns

    once = corpus_pipeline.near_dedup(spark, kept, sf)
    first = {}
    for d, t in lettered:
        fp = simhash.fingerprint(t)
        first[fp] = min(first.get(fp, (True, 0, "")), (d is None, d or 0, t)) if fp in first else (d is None, d or 0, t)
    got = [(r.doc_id, r.text) for r in once.collect()]
    assert len(got) <= len(first) and {t for _, t in got} <= {t for _, _, t in first.values()} and once.columns == docs.columns

    clean = corpus_pipeline.decontamination(spark, once, sf)
    bench = [tuple(decontaminate_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = [t for _, t in got if any(has(decontaminate_words(t), b) for b in bench)]
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert len(left) == len(got) - len(holds) and not set(holds) & {t for _, t in left}

    safe = corpus_pipeline.personal_data(spark, clean, sf)
    redacted = {r.doc_id: r for r in safe.collect()}
    assert safe.columns == docs.columns and len(redacted) == len(left)
    for d, t in left:
        assert not pii.base_spans(redacted[d].text) and redacted[d].n_chars == len(redacted[d].text)
        if not pii._TRIGGER.search(t):
            assert redacted[d].text == t

    coder = bpe.Coder(bpe.load_vocabulary(bpe.default_path()))
    for r in corpus_pipeline.tokenised(spark, safe, sf).collect():
        text = redacted[r.doc_id].text
        assert r.ids == coder.encode(text) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_short_documents_have_a_language(spark):
    """With many languages and long rows to learn from, short texts score next to nothing."""
    rng = random.Random(3)
    rows = [(-k, None, t) for k, t in enumerate(["A.", "Re.", "De.", "Avec.", "12 !", ""], 1)]
    for k in range(20):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
        rows += [(100 * k + j, f"l{k:02}", " ".join(rng.choice(words) for _ in range(300))) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {d for d, _, t in rows if any(c.isalpha() for c in t)}
    short = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy(F.length("text"), "doc_id").limit(200)
    seen = np.zeros(langid.SPACE, np.uint8)
    want = {r.doc_id for r in short.collect() if len(langid.grams(r.text, seen))}
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, short, "").collect()} == want


def decontaminate_words(text):
    import re
    return re.findall(r"[^\W_]+", (text or "").lower())


def has(ws, item):
    return any(tuple(ws[i:i + len(item)]) == item for i in range(len(ws) - len(item) + 1))


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.SIMILARITY == 0.8 and simhash.RADIUS == 2
