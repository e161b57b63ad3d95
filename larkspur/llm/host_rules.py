"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior, joined back to documents.

DataFrame operations only. Shuffles carry a few numbers a document and never its text: failures are pre-aggregated by
host before they move, so a host with a third of all rows sends one partial row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import written
from larkspur.llm.textstats import COUNTS, with_counts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols per word and mean word length beyond which a text counts against its host.
MAX_SYMBOLS_PER_WORD = 1
WORD_LENGTH = (2, 20)
#: A host whose shrunk failure rate exceeds this is rejected.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR_STRENGTH = (1.0, 1_000_000.0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule: the base rules, too many symbols, odd word lengths."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return base_failed() | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n) | (chars < WORD_LENGTH[0] * n) | (chars > WORD_LENGTH[1] * n)


def host_rates(stats: DataFrame) -> DataFrame:
    """One row per host: n_docs, n_failed, rate (shrunk). The prior is fitted over all hosts by the method of moments."""
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    n, p = F.col("n_docs"), F.col("n_failed") / F.col("n_docs")
    fit = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(n * p * p).alias("sq"), F.count(F.lit(1)).alias("hosts")).first()
    total, mean = fit["n"] or 0, (fit["f"] or 0) / (fit["n"] or 1)
    within = mean * (1 - mean)
    between = (fit["sq"] or 0.0) / (total or 1) - mean * mean - within * fit["hosts"] / (total or 1)
    strength = min(max(within / between - 1, PRIOR_STRENGTH[0]), PRIOR_STRENGTH[1]) if between > 0 else PRIOR_STRENGTH[1]
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (n + strength))


def host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of docs: key, the counts of textstats, base_failed, host_rate, kept.

    kept: false where the base rules fail, else whether the host's shrunk failure rate is at most MAX_HOST_RATE.
    A null text has no words and so fails; a null host is a host of its own, named by the empty string. Repeated rows
    each count and each come back. An empty table gives an empty result. Other columns of docs don't matter.
    """
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    stats = with_counts(plain).select("key", "host", *COUNTS)
    stats = written(stats.withColumn("base_failed", base_failed()).withColumn("failed", rule_failed()), "host-stats")
    verdicts = host_rates(stats).select("host", F.col("rate").alias("host_rate"))
    # a hot host is split by the adaptive skew join; a small verdict table is broadcast by Spark's own size check
    return stats.join(verdicts, "host").select(F.col("key").alias(key), *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE)).alias("kept"))
