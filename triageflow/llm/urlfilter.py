"""URL filters by host-suffix and path-prefix expressions.

A rule is (host, path, verdict); it fits its host and all subdomains if the URL's
path starts with the rule's. Each URL is expanded into ``host suffix + path
prefix`` expressions, for every suffix of the host at a label boundary and every
path length that some rule has. Expressions and rules carry a SHA-256 digest;
they are joined on its first ``PREFIX`` hex digits and confirmed by the whole
digest. Of the rules that fit, the longest wins (ties: the longer host, then
block before allow).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A null URL, or one
without ``://``, has an empty host and path. URLs that no rule fits get
``default``. Distinct URLs are judged once, so copies of a URL collapse before the
join; rows of null URL stay. Rules are broadcast below ``BROADCAST_RULES``, else
joined by a shuffle. A very long URL makes as many expressions as its host has labels
times the rules' path lengths. Empty tables give an empty result; without a rule every
URL gets ``default``. Columns named ``host``, ``path``, ``rule`` or ``verdict`` are replaced;
all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from triageflow.llm.common import stored

PREFIX = 8
BROADCAST_RULES = 100_000

# The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "rule_host string, rule_path string, verdict string")


def parts(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    host = F.substring_index(rest, "/", 1)
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                           "path": F.substring(rest, F.length(host) + 1, F.length(rest))})


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added."""
    rules = rules if rules is not None else rule_table(spark)
    rules = rules.select(F.lower("rule_host").alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict")
    rules = rules.where("rule_host is not null").withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
    rules = stored(spark, rules.withColumn("prefix", F.substring("digest", 1, PREFIX)), "url-rules")
    sizes = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    if sizes.n <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    urls = parts(pages.select(F.col(url).alias("_url")).where(F.col(url).isNotNull()).distinct(), "_url")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    lengths = F.array(*[F.lit(n) for n in sorted(sizes.lengths)]).cast("array<int>")
    said = urls.select("_url", "path", F.explode(suffixes).alias("suffix"))
    said = said.select("_url", "suffix", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"), "path")
    said = said.select("_url", "suffix", F.expr("substring(path, 1, n)").alias("start"))
    said = said.withColumn("digest", F.sha2(F.concat("suffix", "start"), 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    fits = said.join(rules.withColumnRenamed("digest", "rule_digest"), "prefix").where(
        (F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & (F.col("start") == F.col("rule_path")))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"),
                    (F.col("verdict") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = fits.groupBy("_url").agg(F.max(rank).alias("_best"))
    best = stored(spark, best, "url-verdicts")
    out = parts(pages, url).join(best, F.col(url) == F.col("_url"), "left")
    return out.withColumn("rule", F.col("_best.rule")).withColumn(
        "verdict", F.coalesce(F.col("_best.verdict"), F.lit(default))).drop("_url", "_best")
