"""Toxicity: Levenshtein automata over a lexicon trie, and windows of context around what they find.

The lexicon is learned: words and word beginnings that labelled toxic texts have and others lack. Its trie is
intersected with the Levenshtein automata of its terms; the product is made deterministic as words ask for it, so a word costs a
table look-up a character until the automaton dies. Hits count less the more edits they need, less in quotation, and more
near an address. A logistic regression on a document's hits gives its score; every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.blocks import text_blocks
from larkspur.llm.common import fold, for_python

#: Labelled rows to learn from, at most: those first by a hash of their key.
MAX_TRAIN = 20_000
#: Toxic texts that a term must stand in, whatever their number and language; its least precision among labelled texts.
MIN_TEXTS, MIN_PRECISION = 3, 0.9
#: Characters of word beginnings that can be terms.
PREFIXES = (4, 5, 6)
#: Ends a term that is a word beginning; no word has white space, while one may well end in a star.
OPEN = " "
#: Edits allowed for a term of at least so many characters.
EDITS = ((6, 1), (10, 2))
#: What a hit with 0, 1 and 2 edits counts.
WORTH = (1.0, 0.8, 0.6)
#: Words on each side of a hit that count as its context.
WINDOW = 6
QUOTED, ADDRESSED = 0.25, 1.5
FOLDS, HELD = 4, 2
#: A document is rejected from this score on.
REJECT = 0.3
#: Words that a task remembers, states that an automaton does, and characters of text that are taken apart at once.
MEMORY, STATES, BLOCK = 200_000, 30_000, 2_000_000

#: Words that report speech, and words that address someone, in the languages of the corpus.
REPORTS = frozenset("said says say wrote writes called calls quoted quote quotes quoting claimed reported according term word slur dit disait écrit selon mot cité sagte sagt schrieb nannte laut wort zitat dijo dice escribió llamó según palabra cita".split())
ADDRESSES = frozenset("you your you're youre yourself u ur tu toi vous votre du dich dir dein deine ihr sie tú usted ustedes vosotros eres es".split())
MARKS = "\"“”„«»‘’"
#: Around a word: everything but letters, digits and signs that stand in for letters.
EDGES = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
FEATURES = ["plain_mass", "quoted_mass", "density"]


class LexiconAutomaton:
    """The trie of the terms times their Levenshtein automata, made deterministic step by step.

    A state is a set of (trie node, edits so far); the steps taken are remembered. A term that ends in OPEN is a word
    beginning: once it is reached, any further characters are accepted.
    """

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.most: list[int] = [0]  # edits allowed by the longest term below a node
        self.ends: list[tuple[int, bool]] = [(-1, False)]  # edits allowed at a node that ends a term (-1: none), and whether it is a beginning
        for term in terms:
            open_ended, letters = term.endswith(OPEN), term.removesuffix(OPEN)
            edits = max((k for n, k in EDITS if len(letters) >= n), default=0)
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in letters:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                    self.ends.append((-1, False))
                node = self.next[node][c]
                self.most[node] = max(self.most[node], edits)
            had, was = self.ends[node]
            self.ends[node] = (max(had, edits), was or open_ended)
        self.forget()

    def forget(self) -> None:
        """Drops the steps taken so far; they are found again as words ask for them."""
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[int] = []  # the fewest edits with which a state accepts, -1 for none
        self.best_open: list[int] = []  # the fewest edits with which a word beginning has been reached here
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, found: set[tuple[int, int]]) -> frozenset:
        """With the characters of terms that a word may leave out."""
        todo = list(found)
        while todo:
            node, e = todo.pop()
            for below in self.next[node].values():
                if e + 1 <= self.most[below] and (below, e + 1) not in found:
                    found.add((below, e + 1))
                    todo.append((below, e + 1))
        least: dict[int, int] = {}
        for node, e in found:
            least[node] = min(e, least.get(node, 99))
        return frozenset(least.items())

    def _state(self, found: frozenset) -> int:
        if found not in self.states:
            self.states[found] = len(self.sets)
            self.sets.append(found)
            self.steps.append({})
            ends = [(e, self.ends[node]) for node, e in found if self.ends[node][0] >= e]
            self.accepts.append(min((e for e, _ in ends), default=-1))
            self.best_open.append(min((e for e, (_, is_open) in ends if is_open), default=-1))
        return self.states[found]

    def _step(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node]:
                found[node] = min(e + 1, found.get(node, 99))  # a character too many
            for letter, below in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.most[below]:
                    found[below] = min(cost, found.get(below, 99))
        to = self.steps[state][c] = self._state(self._closed(set(found.items())))
        return to

    def edits(self, word: str) -> int:
        """The fewest edits between the word and a term, -1 if none is near enough."""
        state, best = self.start, -1
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                return best
            reached = self.best_open[state]
            if reached >= 0 and (best < 0 or reached < best):
                best = reached
        last = self.accepts[state]
        return last if best < 0 or 0 <= last < best else best


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float


def core_of(word: str) -> str:
    return EDGES.sub("", word)


class HitFinder:
    """Hits of a lexicon in texts; remembers words from block to block."""

    def __init__(self, terms: tuple[str, ...]):
        self.automaton = LexiconAutomaton(list(terms))
        self.known: dict[str, int] = {}
        self.hits: set[str] = set()

    def prepared(self, texts: list[str]) -> list[list[str]]:
        """The lower-cased words of each text; new words are run through the automaton."""
        cut = [x.lower().split() for x in texts]
        fresh = set()
        for words in cut:
            fresh.update(words)
        if len(self.known) > MEMORY:
            self.known.clear()
            self.hits.clear()
        if len(self.automaton.sets) > STATES:
            self.automaton.forget()
        known, edits = self.known, self.automaton.edits
        for w in fresh:
            if w not in known:
                e = known[w] = edits(core_of(w))
                if e >= 0:
                    self.hits.add(w)
        return cut

    def masses(self, words: list[str]) -> tuple[float, float]:
        """What the hits of a text count, outside and inside quotation."""
        if self.hits.isdisjoint(words):
            return 0.0, 0.0
        plain = quoted = 0.0
        inside = self.quotation(words)
        for i, w in enumerate(words):
            if w in self.hits:
                worth = WORTH[min(self.known[w], len(WORTH) - 1)]
                near = {core_of(x) for x in words[max(0, i - WINDOW) : i + WINDOW + 1]}
                if inside[i]:
                    quoted += worth * QUOTED if not near.isdisjoint(REPORTS) else worth * 0.5
                else:
                    plain += worth * (ADDRESSED if not near.isdisjoint(ADDRESSES) else 1.0)
        return plain, quoted

    @staticmethod
    def quotation(words: list[str]) -> list[bool]:
        """Whether each word stands between quotation marks that close within the text."""
        out, since = [False] * len(words), -1
        for i, w in enumerate(words):
            opens, closes = w[:1] in MARKS and w[:1] != "", w.rstrip(".,;:!?)")[-1:] in MARKS and len(w) > 1
            if since < 0 and opens:
                since = i
            if since >= 0 and closes:
                out[since : i + 1] = [True] * (i + 1 - since)
                since = -1
        return out


def with_hits(docs: DataFrame, terms: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns of docs and FEATURES."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        finder = HitFinder(shared.value)
        for rows, texts in text_blocks(batches, text, BLOCK):
            found = [(*finder.masses(words), len(words)) for words in finder.prepared(texts)]
            columns = [[math.log1p(p) for p, _, _ in found], [math.log1p(q) for _, q, _ in found], [math.log1p(100 * (p + q) / max(n, 20)) for p, q, n in found]]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, pa.float64()) for c in columns)], names=[*rows.schema.names, *FEATURES])

    kept = docs.drop(*FEATURES)
    return for_python(kept).mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES)]))


def training_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_TRAIN) -> DataFrame:
    """text and y of distinct labelled texts outside the held-out fold, from at most `most` rows.

    A key with several labels has the largest, one with several texts the least; null labels and null keys teach nothing.
    The bound on the labelled keys is what lets them be broadcast.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).dropna()
    known = known.filter(fold("key", FOLDS) != HELD).groupBy("key").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(most)
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learned = plain.join(F.broadcast(known), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return learned.groupBy("text").agg(F.max("y").alias("y"))


def candidates(train: DataFrame) -> DataFrame:
    """term, n_toxic, n_other: in how many texts of each kind a word or a word beginning (OPEN at its end) stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, "text", BLOCK):
            counts: dict[str, list[int]] = {}
            for x, y in zip(texts, rows.column("y").to_pylist(), strict=True):
                words = {core_of(w) for w in x.lower().split()}
                terms = {w for w in words if 3 <= len(w) <= 40}
                for w in words:
                    terms.update(w[:n] + OPEN for n in PREFIXES if len(w) > n)
                for t in terms:
                    counts.setdefault(t, [0, 0])[0 if y else 1] += 1
            yield pa.RecordBatch.from_pydict({"term": list(counts), "t": [c[0] for c in counts.values()], "o": [c[1] for c in counts.values()]}, schema=pa.schema([("term", pa.string()), ("t", pa.int64()), ("o", pa.int64())]))

    return for_python(train).mapInArrow(run, "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("n_toxic"), F.sum("o").alias("n_other"))


def lexicon(train: DataFrame) -> tuple[str, ...]:
    """The terms; the bound on labelled rows is what bounds them. A term that a shorter beginning covers isn't needed."""
    good = candidates(train).filter((F.col("n_toxic") >= MIN_TEXTS) & (F.col("n_toxic") >= MIN_PRECISION * (F.col("n_toxic") + F.col("n_other"))))
    counts = {r["term"]: r["n_toxic"] for r in good.select("term", "n_toxic").toLocalIterator()}
    most: dict[str, int] = {}  # texts of the most frequent whole word with a beginning
    for t, n in counts.items():
        if not t.endswith(OPEN):
            for k in PREFIXES:
                if len(t) >= k:
                    most[t[:k]] = max(n, most.get(t[:k], 0))
    chosen: dict[str, None] = {}
    for t, n in sorted(counts.items(), key=lambda x: (len(x[0].removesuffix(OPEN)), x[0])):
        letters = t.removesuffix(OPEN)
        if any(letters[:k] + OPEN in chosen for k in PREFIXES if k < len(letters) or (k == len(letters) and not t.endswith(OPEN))):
            continue
        # a beginning that one whole word accounts for is left to the word, which may have misspellings
        if t.endswith(OPEN) and most.get(letters, 0) >= 0.8 * n:
            continue
        chosen[t] = None
    return tuple(chosen)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Lexicon and weights. Without both labels the score is the labels' mean, 0 if there are none."""
    train = training_texts(docs, labels, key, text, label).cache()
    try:
        n, toxic = train.agg(F.count(F.lit(1)), F.sum("y")).first()
        if not n or not 0 < toxic < n:
            return ToxicityModel((), (0.0,) * len(FEATURES), 30.0 if n and toxic == n else -30.0)
        terms = lexicon(train)
        seen = with_hits(train.select("text", "y"), terms).select("y", array_to_vector(F.array(*FEATURES)).alias("features"))
        # coefficients aren't negative: a hit never speaks for a text
        found = LogisticRegression(labelCol="y", regParam=0.0005, maxIter=100, lowerBoundsOnCoefficients=_zeros()).fit(seen)
        return ToxicityModel(terms, tuple(map(float, found.coefficients.toArray())), float(found.intercept))
    finally:
        train.unpersist()


def _zeros():
    from pyspark.ml.linalg import Matrices

    return Matrices.dense(1, len(FEATURES), [0.0] * len(FEATURES))


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """The columns of docs and `into`, 0 to 1. A null or empty text has no hits. A column named `into` is replaced."""
    margin = F.lit(model.intercept)
    for f, w in zip(FEATURES, model.weights, strict=True):
        margin = margin + F.lit(w) * F.col(f)
    names = [c for c in docs.columns if c not in (into, *FEATURES)]
    return with_hits(docs, model.terms, text).select(*names, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias(into))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of docs: key, held_out, score, predicted (1 where score >= REJECT).

    Repeated rows each come back; a null key is scored and never learned from; an empty table gives no rows. Columns
    other than key and text aren't read.
    """
    model = fit(docs, labels, key, text, label)
    rows = scored(docs.select(key, text), model, text, "score").select(key, "score")
    return rows.select(key, (fold(key, FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
