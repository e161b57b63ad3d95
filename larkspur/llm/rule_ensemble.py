"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees over text statistics give conjunctive rules (one for each path), a lasso logistic regression weighs them,
and the rules that keep a weight become one Column. Fitting sees a bounded sample of the labelled rows (MAX_TRAIN),
scoring every row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold, text_of
from larkspur.llm.textstats import with_counts

#: Labelled rows that trees and weights are fitted on, at most: those first by a hash of their key.
MAX_TRAIN = 20_000
#: Rows with this remainder of crc32(key as text) are held out.
FOLDS, HELD = 5, 0
TREES, DEPTH, SEED = 12, 3, 11
#: Partitions of the rows to learn from.
PARTS = 8
LASSO = 0.0005
#: A document is accepted from this score on.
ACCEPT = 0.3

FEATURES = ["log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "bang_rate", "pipe_rate", "mark_rate", "distinct_rate", "stutter_rate", "words_a_line", "stop_rate"]


@dataclass(frozen=True)
class Rule:
    """A conjunction: each (feature, threshold, above) says whether the feature exceeds the threshold."""

    tests: tuple[tuple[str, float, bool], ...]

    def column(self, of=F.col) -> Column:
        return reduce(lambda a, b: a & b, [of(f) > t if above else of(f) <= t for f, t, above in self.tests])


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def scores(self) -> Column:
        """An array of one: the probability of label 1, over columns named as in FEATURES.

        The features are bound to one variable, so that no optimiser rule repeats their expressions in every rule.
        """

        def probability(x: Column) -> Column:
            margin = reduce(lambda a, b: a + b, [F.when(r.column(x.getField), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

        return F.transform(F.array(F.struct(*FEATURES)), probability)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row` (a struct of docs' columns) and FEATURES; all zero for an empty or null text."""
    df = with_counts(docs.select(F.struct(*docs.columns).alias("row"), text_of(text).alias("text")))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.length("text"), F.lit(1))
    lines = F.greatest(F.size("_lines"), F.lit(1))
    stutters = F.size(F.filter(F.col("_words"), lambda w, i: w == F.get(F.col("_words"), i - 1)))
    made = {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / lines,
        "repeat_rate": F.col("n_repeat_words") / words,
        "upper_rate": F.regexp_count("text", F.lit(r"\p{Lu}")) / chars,
        "digit_rate": F.regexp_count("text", F.lit("[0-9]")) / words,
        "bang_rate": F.regexp_count("text", F.lit("!")) / words,
        "pipe_rate": F.regexp_count("text", F.lit(r"\|")) / words,
        "mark_rate": F.regexp_count("text", F.lit("[#*$%&]")) / words,
        "distinct_rate": F.size(F.array_distinct("_words")) / words,
        "stutter_rate": stutters / words,
        "words_a_line": F.log1p(F.col("n_words") / lines),
        "stop_rate": F.regexp_count("text", F.lit(r"\.")) / words,
    }
    return df.select("row", *[made[f].cast("double").alias(f) for f in FEATURES])


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAIN) -> DataFrame:
    """FEATURES and y of the labelled rows outside the held-out fold, at most `most`.

    A key with several labels has the largest, one with several texts the least; null labels and null keys teach nothing.
    Rows are dealt and sorted by key, so that a rerun sees them in the same order and fits the same model. The sample is chosen from the
    labels alone; its bound lets its keys be broadcast, so the texts of other rows don't move and aren't analysed.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).dropna()
    known = known.filter(fold("key", FOLDS) != HELD).groupBy("key").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(most)
    plain = docs.select(F.col(key).alias("key"), text_of(text).alias("text")).join(F.broadcast(known), "key")
    learned = plain.groupBy("key").agg(F.min("text").alias("text"), F.max("y").alias("y")).repartition(PARTS, "key").sortWithinPartitions("key")
    return with_statistics(learned, "text").select(F.col("row.y").alias("y"), *FEATURES)


def _paths(node, tests: tuple = ()) -> list[tuple]:
    """Every path from the root of a fitted tree to a node below it."""
    found = [tests] if tests else []
    if hasattr_java(node, "InternalNode"):
        split = node.split()
        name, at = FEATURES[split.featureIndex()], float(split.threshold())
        found += _paths(node.leftChild(), (*tests, (name, at, False)))
        found += _paths(node.rightChild(), (*tests, (name, at, True)))
    return found


def hasattr_java(node, kind: str) -> bool:
    return node.getClass().getSimpleName() == kind


def fit(train: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Trees for the rules, then a lasso over rule indicators. Without both labels the score is the labels' mean, 0.5 if none."""
    train = train.cache()
    try:
        n, ones = train.agg(F.count(F.lit(1)), F.sum("y")).first()
        if not n or not 0 < ones < n:
            mean = 0.5 if not n else min(max(ones / n, 1e-6), 1 - 1e-6)
            return RuleModel((), math.log(mean / (1 - mean)))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train)
        forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=SEED, bootstrap=False, featureSubsetStrategy="onethird").fit(vectors)
        rules = sorted({Rule(tuple(p)) for tree in forest.trees for p in _paths(tree._java_obj.rootNode())}, key=lambda r: r.tests)
        if not rules:
            return RuleModel((), math.log(ones / (n - ones)))
        seen = train.select("y", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
        lasso_fit = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=40, standardization=True).fit(seen)
        weights = [float(w) for w in lasso_fit.coefficients.toArray()]
        return RuleModel(tuple((r, w) for r, w in zip(rules, weights, strict=True) if w), float(lasso_fit.intercept))
    finally:
        train.unpersist()


def scored(docs: DataFrame, model: RuleModel, text: str = "text", into: str = "score") -> DataFrame:
    """The columns of docs and `into`, 0 to 1, by column expressions alone. A column named `into` is replaced."""
    names = [c for c in docs.columns if c != into]
    # exploded, so that a filter on the score isn't pushed below the statistics, whose expressions it would repeat
    made = with_statistics(docs, text).select("row", F.explode_outer(model.scores()).alias("_made"))
    return made.select(*[F.col("row")[c].alias(c) for c in names], F.col("_made").alias(into))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of docs: key, held_out, score (0 to 1), predicted (1 where score >= ACCEPT).

    Empty and null texts have statistics of zero and a score like any other. Repeated rows each come back; a null key is
    scored and never learned from. Columns of docs other than key and text aren't read. An empty table gives no rows.
    """
    model = fit(training_rows(docs, labels, key, text, label))
    rows = scored(docs.select(key, text), model, text, "score")
    return rows.select(key, (fold(key, FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
