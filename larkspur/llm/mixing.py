"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target over its share of the corpus. Each document draws its number
of copies from a Poisson distribution of that mean, by inverting the distribution at a hash of the document's key, so a
rerun draws the same. Copies are dealt out over all partitions by another hash and sorted by it there, which is a global
shuffle: neither a source with a third of all rows nor a document with many copies meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, written

#: Without given weights, a source counts as its number of documents to this power.
FLATTEN = 0.5
#: Copies that are wanted in all, as a multiple of the corpus.
EPOCHS = 1.0
SEED = "mix-1"


def name_of(source: str | Column) -> Column:
    """A source's name; a null source is one of its own, named by the empty string."""
    return F.coalesce((F.col(source) if isinstance(source, str) else source).cast("string"), F.lit(""))


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: source, n_docs, rate. Counts are summed in each task before they move.

    weights: relative target shares; a source that they don't name gets none. Without weights, n_docs ** FLATTEN.
    """
    counts = docs.groupBy(name_of(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(FLATTEN)))
    else:
        if any(w < 0 for w in weights.values()) or not any(weights.values()):
            raise ValueError("weights must not be negative, and one at least must be positive")
        named = docs.sparkSession.createDataFrame([(str(k), float(w)) for k, w in weights.items()], "source string, weight double")
        weighed = counts.join(named, "source", "left").fillna(0.0, ["weight"])
    whole = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n_docs").alias("all_docs"))  # one row
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(whole)).select("source", "n_docs", (share * F.col("all_docs") * F.lit(float(epochs)) / F.col("n_docs")).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is lost in rounding; built in logarithms, so a large mean works too."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def further(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), (s["sum"] + F.exp(log_p)).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + F.exp(log_p))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, further, lambda s: s["cdf"])).otherwise(F.array(F.lit(1.0)))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by "|"; a null part is empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies_of(key: Column, cdf: Column, seed: str = SEED) -> Column:
    """The number of copies: how many steps of the distribution lie at or below the key's number."""
    return F.transform(F.array(uniform(F.lit(seed), key)), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))[0]


def mix(docs: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """The columns of docs, and n_copies int, copy int (from 1), order_key string; rows in a random order.

    rates: source and rate, as from source_rates; documents of a source that it lacks have no copies. Rows of equal
    keys draw alike, and so do rows of null keys; each such row is replicated by itself. Null and empty texts are
    documents like any other. An empty table stays empty. Columns n_copies, copy and order_key of docs are replaced.
    """
    made = ["n_copies", "copy", "order_key"]
    kept = [c for c in docs.columns if c not in made]
    own, cdf = free_name(docs, "mix_source"), free_name(docs, "mix_cdf")
    # written: its size is then known, and Spark broadcasts it where it is small; else the join is dealt by source, skew split
    steps = written(rates.select(F.col("source").alias(own), poisson_cdf(F.col("rate")).alias(cdf)), "mix-rates")
    drawn = docs.select(*kept, name_of(source).alias(own)).join(steps, own)
    drawn = drawn.withColumn("n_copies", copies_of(F.col(key), F.col(cdf), seed)).filter("n_copies > 0").drop(own, cdf)
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("order_key", order).repartition("order_key").sortWithinPartitions("order_key")
