"""Statistics of a text as Spark columns: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WORD_SPACE, text_of, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found at least twice; windows are compared by a 64-bit hash.

    Sorted hashes show whether any window repeats; only texts with repeats pay for the sort by position.
    """
    n = F.size(words)
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))

    def covered(all_hashes: Column) -> Column:
        placed = F.sort_array(F.transform(all_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(
            F.array(placed),
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, j: (x["h"] == F.get(p, j + 1)["h"]) | (x["h"] == F.get(p, j - 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )[0]

    def width(at: Column) -> Column:
        """Positions come in order, so each window adds at most what lies before the next one."""
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)

    # transform over a one-element array names an expression once, so it is computed once
    return F.transform(
        F.array(hashes),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.transform(F.array(covered(h)), width)[0]),
    )[0]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS (long) and the working columns `_words` and `_lines`.

    word_chars: code points in words. n_symbols: characters of `[#*$%&|<>]`. n_dup_lines: \\n-split lines with a word
    that equal an earlier line. n_repeat_words: words in 3-word windows found twice or more, the first included.
    A null or empty text has no words and zeros throughout.
    """
    whole = text_of(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{WORD_SPACE[1:-1]}]"))
    df = docs.withColumn("_words", words_of(whole)).withColumn("_lines", lines)
    return df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        (F.length(whole) - F.regexp_count(whole, F.lit(WORD_SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )
