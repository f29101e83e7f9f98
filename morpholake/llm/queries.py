"""One query per operator, each over the whole of its table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, gru_lm, importance, langid, lexical, packing, quality, secrets, simhash, toxicity, url_filter, warc
from .common import fold, table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
WORD_FILE = "word_bpe_49k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_FILE)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"], made=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def page_is_bad() -> Column:
    """The labelled outcome of a page: over 2 % of its characters are junk symbols; none where there is no html."""
    n = F.length("html")
    return F.when(n > 0, (n - F.length(F.translate("html", "#*$%", ""))) / n > 0.02)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), page_is_bad())
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_share", 6).alias("bad_share"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter("toxic is not null").select(F.col("doc_id").alias("labelled"), "toxic")
    known = docs.filter(fold("doc_id", 5) != 0)
    model = toxicity.train(known.join(labels, known["doc_id"] == labels["labelled"]))
    return toxicity.score(docs.withColumn("held_out", fold("doc_id", 5) == 0), model, ["doc_id", "held_out"])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold("doc_id", 4) != 2))
    return langid.predict(docs.withColumn("held_out", fold("doc_id", 4) == 2), model, ["doc_id", "held_out"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = gru_lm.train(docs.filter(fold("doc_id", 10) != 0))
    return gru_lm.score(docs.withColumn("held_out", fold("doc_id", 10) == 0), model, counts, ["doc_id", "held_out"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontaminate, op2_bpe, op3_simhash, op4_url_filter, op5_toxicity, op6_secrets, op7_langid, op8_warc, op9_gru_lm, op10_quality, op11_lexical, op12_importance, op13_packing)
    return {f.__name__: f for f in found}


def _level_sql(name: str, sums: str, key: str, up: str, parent: str) -> str:
    low, high = url_filter.WEIGHTS
    return f"""
{name}_in AS (SELECT s.*, p.a / (p.a + p.b) AS m FROM {sums} s JOIN {parent} p USING ({up})),
{name}_w AS (SELECT CASE WHEN c IS NULL OR v - e <= 0 OR c <= 0 THEN {high} ELSE least({high}, greatest({low}, c / (v - e) - 1)) END AS w
  FROM (SELECT sum(m * (1 - m) * n) AS c, sum((bad * 1.0 / n - m) ** 2 * n) AS v, sum(m * (1 - m)) AS e FROM {name}_in WHERE n > 1)),
{name} AS (SELECT {key}, bad + w * m AS a, n - bad + w * (1 - m) AS b FROM {name}_in, {name}_w),"""


def oracle_sql() -> dict[str, str]:
    shares = "sum(bad)::DOUBLE AS bad, sum(n)::DOUBLE AS n"
    whens = {"rule": "", "verdict": ""}
    for host, path, said in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"
        whens["rule"] += f" WHEN {fits} THEN '{host}{path}'"
        whens["verdict"] += f" WHEN {fits} THEN '{said}'"
    url = rf"""
WITH urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  CASE WHEN length(html) > 0 THEN ((length(html) - length(translate(html, '#*$%', ''))) * 1.0 / length(html) > 0.02)::INT END AS bad FROM pages),
hosts0 AS (SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n, string_split(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM urls GROUP BY host),
hosts AS (SELECT host, bad, n, array_to_string(l[-2:], '.') AS domain, l[-1] AS suffix, 'all' AS root FROM hosts0),
domains AS (SELECT domain, suffix, root, {shares} FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, root, {shares} FROM domains GROUP BY ALL),
base AS (SELECT root, sum(bad) + 1 AS a, sum(n) - sum(bad) + 1 AS b FROM suffixes GROUP BY root),
{_level_sql("top", "suffixes", "suffix", "root", "base")}{_level_sql("mid", "domains", "domain", "suffix", "top")}{_level_sql("low", "hosts", "host", "domain", "mid")}
known AS (SELECT host, a / (a + b) AS mean, a / (a + b) - {url_filter.Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS bound FROM low)
SELECT page_id, host, path, CASE{whens["rule"]} END AS rule, coalesce(CASE{whens["verdict"]} END, CASE WHEN bound > {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_share
FROM urls JOIN known USING (host)"""
    archive = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.LEAST_SHARED} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_SHARED} AND page_id <> first THEN first END AS refers_to FROM f"""
    return {"op4_url_filter": url, "op8_warc": archive}
