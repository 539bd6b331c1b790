"""Registered queries of the training-data operators: each applies one operator,
with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from triageflow.llm import bisector, bpe, collocations, decontaminate, fingerprint, htmlextract, langid, license, multiindex, pii, simhash, urlfilter, warc
from triageflow.llm.common import bound_batches
from triageflow.session import checkpoint_root
from triageflow.sources.tables import table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/llm-warc-{uuid.uuid4().hex}"
    warc.write_archives(spark, _table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.pii_digest(spark, pii.fit(docs))("text").alias("p")).select("doc_id", "p.*")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return docs.select("doc_id", langid.held_out().alias("held_out"), langid.language(spark, model)("text").alias("p")).select("doc_id", "held_out", "p.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return _table(spark, sf_dir, "documents").select("doc_id", bpe.bpe_digest(spark)("text").alias("p")).select("doc_id", "p.*")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprint.with_next(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), "text",
                       fingerprint.edited("text", "next_text").alias("edited"), "next_text")
    docs = docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint.vector("text").alias("own"),
                       fingerprint.vector("edited").alias("other"), fingerprint.vector("next_text").alias("next"))
    return docs.select("doc_id", "n_chars", "edited_sha256", fingerprint.as_hex("own").alias("fingerprint"), fingerprint.as_hex("other").alias("edited_fingerprint"),
                       fingerprint.likeness("own", "other").alias("near_edited"), fingerprint.likeness("own", "next").alias("near_next"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark, _table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", htmlextract.main_text(spark, htmlextract.fit(pages))("html").alias("m")).select("page_id", "url", "m.*")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(spark, _table(spark, sf_dir, "documents"))


def op11_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.with_inertia(spark, *bisector.clustered(spark, _table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontaminate, op3_pii, op4_langid, op5_bpe, op6_fingerprint, op7_simhash, op8_urlfilter,
                                   op9_html, op10_license, op11_embedding, op12_collocations, op13_centroids, pipeline)}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license.BASE)



def _centroids_sql(k: int = bisector.CLUSTERS, rounds: int = bisector.ROUNDS, dims: int = bisector.DIMS, scale: int = bisector.SCALE) -> str:
    """Distances to every centroid and their minimum, round by round."""
    def nearest(i: int) -> str:
        return f"""a{i} AS (SELECT vec_id, r, any_value(q) AS q, min(struct_pack(d := d, c := c)) AS b FROM (
  SELECT v.vec_id, v.r, v.q, m.c, CAST(list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
  FROM v CROSS JOIN c{i} AS m) GROUP BY vec_id, r)"""

    def move(i: int) -> str:
        return f"""c{i + 1} AS (SELECT c.c, coalesce(n.q, c.q) AS q FROM c{i} AS c LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
    SELECT b.c AS c, u.i AS i, CAST(sum(q[u.i]) AS HUGEINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {dims + 1})) AS i) AS u GROUP BY b.c, u.i)
  GROUP BY c) AS n USING (c))"""

    steps = ",\n".join(x for i in range(rounds) for x in (nearest(i), move(i)))
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INTEGER) AS c, q FROM (
  SELECT sha256('{bisector.SEED}:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k})),
{steps},
{nearest(rounds)}
SELECT vec_id, b.c AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS m ON m.c = b.c"""


def _collocations_sql(threshold: int = collocations.THRESHOLD, top: int = collocations.TOP, weight: int = collocations.WEIGHT,
                      cover: int = collocations.COVER_PERCENT, longest: int = collocations.LONGEST) -> str:
    """Every phrase of every length counted."""
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT lang, k, unnest(list_transform(range(1, CAST(len(ws) AS BIGINT) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, {longest + 1})) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= {threshold}),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, u.j, array_to_string(c.ws[1:u.j], ' ') AS head, array_to_string(c.ws[u.j + 1:], ' ') AS tail
  FROM c, (SELECT unnest(range(1, {longest})) AS j) AS u WHERE u.j < c.k),
scored AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, min(struct_pack(
    score := CAST((CAST({weight} AS HUGEINT) * cuts.a) // (h.n + e.n) AS BIGINT), j := cuts.j, l := h.n, r := e.n)) AS b
  FROM cuts JOIN f AS h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f AS e ON e.lang = cuts.lang AND e.phrase = cuts.tail GROUP BY ALL),
inner_of AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT c.lang, c.ws, c.a, c.k, x.m, y.s FROM c, (SELECT unnest(range(2, {longest})) AS m) AS x, (SELECT unnest(range(1, {longest})) AS s) AS y
    WHERE x.m < c.k AND y.s + x.m - 1 <= c.k) GROUP BY 1, 2),
kept AS (SELECT scored.* FROM scored LEFT JOIN inner_of USING (lang, phrase) WHERE NOT coalesce(100 * longer >= {cover} * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, totals.n AS n, b.score AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""


#: DuckDB twins of what SQL can express. Records, digests and verdicts need no
#: model; the other operators are tested against brute force in tests/llm/.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first_id FROM d WHERE n >= 100 AND page_id IS NOT NULL GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, x AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (x)""",
    "op8_urlfilter": f"""
WITH rules(rule_host, rule_path, v) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0, 's') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, v, row_number() OVER (
    PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
    "op12_collocations": _collocations_sql(),
    "op13_centroids": _centroids_sql(),
}
