"""The registered queries of this package, and DuckDB SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, fingerprint, host_rules, html_text, minhash, mixing, rule_ensemble, suffix_tree, token_files, toxicity
from larkspur.llm.common import table

BYTE_BPE, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"
#: The id that ends a document in token files.
END_ID = 2


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.source_rates(docs))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.fit_and_score(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))
    return byte_bpe.decode(digests, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents")).select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_html_text, op3_suffix_tree, op4_byte_bpe, op5_token_files, op6_minhash, op7_fingerprint, op8_toxicity, op9_host_rules, op10_rule_ensemble)
}

ORACLES = {
    "op1_mix_sources": r"""
WITH n AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT src, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT src, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 400) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
c AS (SELECT src, list(c ORDER BY k) AS cdf FROM (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM p) GROUP BY src),
u AS (SELECT *, CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.*, CAST(len(list_filter(cdf, lambda x: x <= u)) AS INTEGER) AS n_copies FROM u JOIN c ON src = coalesce(source, ''))
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(copy AS INTEGER) AS copy,
       md5('mix-1|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy) AS order_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM d WHERE n_copies > 0)
""",
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op9_host_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
g AS (
  SELECT *, base_failed OR n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed FROM f),
h AS (SELECT host, count(*) AS n, sum(CAST(failed AS BIGINT)) AS k FROM g GROUP BY host),
m AS (SELECT sum(n) AS n, sum(k) / sum(n) AS mean, count(*) AS hosts, sum(n * (k / n) * (k / n)) / sum(n) AS sq FROM h),
b AS (SELECT mean, mean * (1 - mean) AS within, sq - mean * mean - mean * (1 - mean) * hosts / n AS between_ FROM m),
p AS (SELECT mean, CASE WHEN between_ > 0 THEN least(greatest(within / between_ - 1, 1.0), 1000000.0) ELSE 1000000.0 END AS strength FROM b),
v AS (SELECT host, (k + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM g JOIN v USING (host)
""",
}
