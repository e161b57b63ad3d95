"""Language-model scoring by a probabilistic suffix tree over words.

A state is a context of up to DEPTH words that occurs at least MIN_STATE times and whose next-symbol distribution diverges
from that of its suffix: the likelihood gained on the corpus by keeping it must reach MIN_GAIN. A state's distribution lists
the next symbols seen at least MIN_COUNT times, discounted; the mass that is left goes to the distribution of its suffix,
down to the smoothed counts of single words. A token is scored by the longest suffix of the words before it that is a state.

These are counts, not shares: the tree grows with the corpus. It is built by joins and kept in tables. A token's log10 share is a
sum over the grams (runs of words) around it: a gram adds what it changes as an entry of its context and, where it is a state,
what it leaves to its suffix for the token after it. So a document's score is a sum over its grams, looked up in one table.
The most frequent grams (1/MIN_ENTRY a length at most) and words (1/MIN_WORD) are also broadcast as the head, and aren't looked
up there: that table has no hot keys.

In tables a gram is a 64-bit code of the hashes of its words. A bitmap of BITMAP bits keeps most grams that cannot matter
out of the shuffles; where it fills up, only time is lost. Codes are dealt out by their first bits, and those of many texts move
in one row: sorted, as differences. Of a gram's context a tag of 32 bits moves along. Codes are made so that a gram's code and
its context's give its suffix's, and a suffix that is in the tree shows that a context of that tag is the gram's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.blocks import byte_blocks
from larkspur.llm.common import LOWER_BYTES, discarded, fold, written
from larkspur.llm.lookup import Lookup

DEPTH = 3
#: Occurrences that a context must have to become a state, and a symbol to be listed in it.
MIN_STATE, MIN_COUNT = 32, 4
#: Shares of the corpus from which a word and a gram belong to the head.
MIN_WORD, MIN_ENTRY = 5e-7, 1e-6
#: Nats that a state must gain over its suffix, and what each listed symbol's count is lowered by.
MIN_GAIN, DISCOUNT = 20.0, 0.75
ADD = 0.1
#: Rows with this remainder of crc32(key as text) are held out.
FOLDS, HELD = 10, 0
#: Bits of a bitmap, and of the pieces it is put together from.
BITMAP, PIECE = 1 << 27, 1 << 15
#: Bytes of text that are coded at once: a token takes about a hundred bytes meanwhile.
BLOCK = 4_000_000
#: Words that are hashed at once.
WORDS = 1 << 14
#: Grams and documents whose codes move together, and tokens of the corpus for each part that codes are dealt to.
ENTRIES, UNIT_DOCS, PART_TOKENS = 1_500_000, 50_000, 4_000_000
#: Bits by which a gram's code is turned before the next word is added: the last two make it depend on pairs of bits, so that no
#: context stands for another one.
TURNS = 17, 7, 29
#: Bits of a context's code that move along with its grams.
TAG = 0xFFFFFFFF
#: What is added to a code for its gram's length.
LENGTHS = np.array([0, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    """64-bit integers (unsigned) with their bits spread: a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What stands for the end of a text, a number for each byte, and where the numbers of the bytes' places begin.
END, BYTES, PLACES = np.uint64(0x2545F4914F6CDD1D), stirred(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0xD1B54A32D192ED03)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass
class Tree:
    words: Lookup  # hashes of the head's words and of the end
    logs: np.ndarray  # log10 of their smoothed shares
    least_word: float  # occurrences from which a word is in the head
    train_tokens: int
    distinct: int
    grams: Lookup  # codes of the head's grams
    shifts: np.ndarray  # what they add to the log10 share
    least_gram: float
    table: DataFrame  # g, shift, n: the whole tree


def training(docs: DataFrame, key: str) -> DataFrame:
    return docs.filter(fold(key, FOLDS) != HELD)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), n over all rows, and the end of text as a null word. Each block is counted by itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in byte_blocks(batches, "text", BLOCK):
            found = Coded(texts).all_words().value_counts()
            words, n = found.field("values"), found.field("counts")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(1, pa.binary())]), pa.concat_arrays([n, pa.array([len(texts)], pa.int64())])], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Coded:
    """Tokens of several texts, ends included, and the codes of the grams that end at each.

    A word's hash is the sum over its bytes of the byte's number times the place's, stirred.
    """

    def __init__(self, texts: list[bytes]):
        self.bytes = b" ".join(texts).translate(LOWER_BYTES)
        self.raw = np.frombuffer(self.bytes, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(~BLANK[self.raw], prepend=False, append=False))
        #: Where each word begins and ends.
        self.begin, self.end = edges[::2], edges[1::2]
        cut = np.searchsorted(self.begin, np.cumsum([0, *(len(x) + 1 for x in texts)]))
        self.sizes = np.diff(cut) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.is_end = np.zeros(len(self.text), dtype=bool)
        self.is_end[self.starts + self.sizes - 1] = True
        #: How many tokens of its text stand before each token.
        self.place = np.arange(len(self.text)) - np.repeat(self.starts, self.sizes)

    @cached_property
    def hashes(self) -> np.ndarray:
        found = np.full(len(self.text), END)
        found[~self.is_end] = self._hashed()
        return found

    @cached_property
    def sums(self) -> list[np.ndarray]:
        return [self.hashes]

    def _hashed(self) -> np.ndarray:
        sizes, found = self.end - self.begin, np.zeros(len(self.begin), dtype=np.uint64)
        places = stirred(np.arange(sizes.max(initial=0), dtype=np.uint64) + PLACES)
        for i in range(0, len(sizes), WORDS):
            size = sizes[i : i + WORDS]
            part = self.raw[self.begin[i] : self.end[i : i + WORDS][-1]]
            part, first = part[~BLANK[part]], np.cumsum(size) - size
            found[i : i + WORDS] = np.add.reduceat(BYTES[part] * places[np.arange(len(part)) - np.repeat(first, size)], first)
        return stirred(found + sizes.astype(np.uint64))

    def all_words(self) -> pa.Array:
        """All words in order, without the ends."""
        offsets = np.cumsum([0, *(self.end - self.begin)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.begin), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw[~BLANK[self.raw]])])

    def words(self, at: np.ndarray) -> list[bytes | None]:
        """The words of some tokens, an end as None."""
        ends = self.is_end[at]
        # before a token stand as many ends as texts
        word = np.where(ends, 0, at - self.text[at])
        return [None if e else self.bytes[i:j] for e, i, j in zip(ends.tolist(), self.begin[word].tolist(), self.end[word].tolist())] if len(self.begin) else [None] * len(at)

    def codes(self, n: int) -> np.ndarray:
        """The code of the n words that end at each token; without meaning where its text has fewer."""
        while len(self.sums) < n:
            before = np.zeros_like(self.hashes)
            before[1:] = self.sums[-1][:-1]
            self.sums.append(carried(before) ^ self.hashes)
        return (self.sums[n - 1] ^ LENGTHS[n]).view(np.int64)


def carried(x: np.ndarray) -> np.ndarray:
    """What a code without its length becomes when a word follows; that word's hash is added by exclusive or."""
    a, b, c = (x << np.uint64(n) | x >> np.uint64(64 - n) for n in TURNS)
    return a ^ (b & c)


def carried_column(x: Column) -> Column:
    a, b, c = (F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) for n in TURNS)
    return a.bitwiseXOR(b.bitwiseAND(c))


def of_length(n: int) -> Column:
    return F.lit(int(LENGTHS[n].view(np.int64)))


def parts_bits(tokens: int) -> int:
    """First bits of a code by which codes are dealt out, so that a part has about PART_TOKENS of the corpus."""
    return max(1, (tokens // PART_TOKENS).bit_length())


def dealt(codes: np.ndarray, bits: int, *values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(part, number of codes, these packed) for sorted unsigned codes and what belongs to them."""
    parts = (codes >> np.uint64(64 - bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(codes)] if len(codes) else [0]
    for a, b in zip(edges, edges[1:]):
        yield int(parts[a]), b - a, packed(np.diff(codes[a:b], prepend=np.uint64(0)), *(x[a:b] for x in values))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of the same length, first bytes of all numbers first, compressed."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    return pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def unpacked(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [n * np.dtype(x).itemsize for x in kinds]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=sum(sizes)), dtype=np.uint8)
    return [np.ascontiguousarray(x.reshape(-1, n).T).view(kind).reshape(-1) for x, kind in zip(np.split(raw, np.cumsum(sizes)[:-1]), kinds, strict=True)]


def at_bit(codes: np.ndarray) -> np.ndarray:
    return (codes.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (BITMAP - 1)


def has_bit(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = at_bit(codes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(codes: DataFrame) -> np.ndarray:
    """BITMAP bits with those of the column `g` (long) set, packed by the executors."""

    def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(at_bit(np.asarray(batch.column("g"))))
            edges = np.flatnonzero(np.diff(at // PIECE, prepend=-1))
            places = (at % PIECE).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(at[edges] // PIECE), pa.array([x.tobytes() for x in np.split(places, edges[1:])] if len(at) else [], pa.binary())], names=["piece", "places"])

    def united(group: pa.Table) -> pa.Table:
        bits = np.zeros(PIECE, dtype=np.uint8)
        bits[np.frombuffer(b"".join(group["places"].to_pylist()), dtype=np.uint16)] = 1
        return pa.table({"piece": group["piece"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    bits = np.zeros((BITMAP // PIECE, PIECE // 8), dtype=np.uint8)
    pieces = written(codes.select("g").mapInArrow(bit, "piece long, places binary").groupBy("piece").applyInArrow(united, "piece long, bits binary"), "bitmap")
    for r in pieces.toLocalIterator():
        bits[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    discarded(pieces)
    return bits.reshape(-1)


def gram_counts(docs: DataFrame, depth: int, wanted: np.ndarray, bits: int, text: str = "text") -> DataFrame:
    """g, n over all rows, and the context's tag of the grams listed whose context has `depth` words and a bit. bits: parts_bits."""
    shared, mask = docs.sparkSession.sparkContext.broadcast(wanted), np.uint64(TAG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for _, texts in byte_blocks(batches, "text", BLOCK):
            coded = Coded(texts)
            shorter = coded.codes(depth)
            use = np.flatnonzero(coded.place >= depth)
            use = use[has_bit(shared.value, shorter[use - 1])]
            codes = coded.codes(depth + 1)[use].view(np.uint64)
            first, n = distinct(codes)
            held.append((codes[first], n.astype(np.uint32), (shorter[use[first] - 1].view(np.uint64) & mask).astype(np.uint32)))
            if sum(len(x[0]) for x in held) >= ENTRIES:
                yield moved(held)
                held = []
        if held:
            yield moved(held)

    def moved(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        codes, n, of = summed(*(np.concatenate(x) for x in zip(*held))) if len(held) > 1 else held[0]
        rows = list(dealt(codes, bits, n.astype(np.uint32), of))
        return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("part", pa.int32()), ("size", pa.int32()), ("data", pa.binary())))})

    def listed(group: pa.Table) -> pa.Table:
        found = [unpacked(x, n, np.uint64, np.uint32, np.uint32) for x, n in zip(group["data"].to_pylist(), group["size"].to_pylist(), strict=True)]
        codes, n, of = summed(np.concatenate([x[0].cumsum() for x in found]), *(np.concatenate([x[i] for x in found]) for i in (1, 2)))
        some = n >= MIN_COUNT
        return pa.table({"g": codes[some].view(np.int64), "n": n[some], "tag": of[some].astype(np.int64)})

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "part int, size int, data binary")
    return found.groupBy("part").applyInArrow(listed, "g long, n long, tag long")


def summed(codes: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes in order, the sum of their n, and what one of each is of."""
    order = codes.argsort()
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    return codes[first], np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64), of[order[first]]


def words_coded(counts: DataFrame) -> DataFrame:
    """g, n of the words of a table of word counts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            hashes = Coded([b" ".join(words.drop_null().to_pylist())]).hashes
            codes = np.full(len(words), END)
            codes[words.is_valid().to_numpy(zero_copy_only=False)] = hashes[:-1]
            codes ^= LENGTHS[1]
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), batch.column("n")], names=["g", "n"])

    return counts.select("word", "n").mapInArrow(hashed, "g long, n long")


def fit(docs: DataFrame, counts: DataFrame, text: str = "text") -> Tree:
    """The tree of all rows of docs; counts: their word_counts. One pass over the texts for each depth."""
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    n = sums["n"] or 0
    distinct = sums["v"] if sums["ends"] else 0
    whole_mass = n + ADD * (distinct + 1)
    share = F.log10((F.col("n") + F.lit(ADD)) / F.lit(whole_mass))
    words = words_coded(counts.filter((F.col("n") >= MIN_COUNT) | F.col("word").isNull()))
    # rest: the code of what follows the first word, without its length
    lower = written(words.select("g", "n", share.alias("s"), F.lit(0).cast("long").alias("rest")), "grams-1")
    # thresholds bound what comes to the driver
    least_word, least_gram = max(MIN_COUNT, MIN_WORD * n), max(MIN_COUNT, MIN_ENTRY * n)
    head = lower.filter(F.col("n") >= least_word).select("g", "s").toPandas()
    bits, shifts, used = parts_bits(n), [], []
    of_context = Window.partitionBy("ctx")
    for depth in range(1, DEPTH + 1):
        own = lower.filter(F.col("n") >= MIN_STATE)
        listed = written(gram_counts(docs, depth, bitmap(own), bits, text), f"listed-{depth + 1}")
        contexts = own.select(F.col("g").alias("ctx"), F.col("n").alias("whole"), F.col("rest").alias("ctx_rest"), F.col("g").bitwiseAND(F.lit(TAG)).alias("tag"))
        last = F.col("g").bitwiseXOR(of_length(depth + 1)).bitwiseXOR(carried_column(F.col("ctx").bitwiseXOR(of_length(depth))))
        seen = listed.join(contexts, "tag").select("ctx", "whole", "g", "n", carried_column(F.col("ctx_rest")).bitwiseXOR(last).alias("rest"))
        suffixes = lower.select(F.col("g").bitwiseXOR(of_length(depth)).alias("rest"), F.col("s").alias("lower"))
        seen = seen.join(suffixes, "rest")
        taken = F.sum(F.col("n") - DISCOUNT).over(of_context)
        seen = seen.withColumns({"mass": F.least(F.lit(1.0), F.greatest(F.lit(1e-9), 1 - taken / F.col("whole"))), "listed": F.sum("n").over(of_context), "one": F.min("g").over(of_context)})
        seen = seen.withColumn("share", F.log10((F.col("n") - DISCOUNT) / F.col("whole") + F.col("mass") * F.pow(F.lit(10.0), F.col("lower"))))
        gain = F.sum(F.col("n") * (F.col("share") - F.col("lower"))).over(of_context) * float(np.log(10)) + (F.col("whole") - F.col("listed")) * F.log("mass")
        seen = seen.withColumn("left", F.when(gain >= MIN_GAIN, F.log10("mass")))
        inside = F.col("left").isNotNull()
        now = seen.select(
            "g",
            "n",
            "rest",
            F.when(inside, F.col("share")).otherwise(F.col("lower")).alias("s"),
            F.when(inside, F.col("share") - F.col("left") - F.col("lower")).otherwise(0.0).alias("shift"),
            # a state once, beside one of its grams
            F.when(inside & (F.col("g") == F.col("one")), F.struct(F.col("ctx").alias("g"), F.col("left").alias("shift"), F.col("whole").alias("n"))).alias("state"),
        )
        now = written(now, f"grams-{depth + 1}")
        discarded(listed)
        used.append(lower)
        shifts += [now.filter(F.col("state").isNotNull()).select("state.*"), now.filter(F.col("shift") != 0).select("g", "shift", "n")]
        lower = now.select("g", "n", "s", "rest")
    table = written(reduce(DataFrame.unionAll, shifts).groupBy("g").agg(F.sum("shift").alias("shift"), F.max("n").alias("n")), "shifts")
    discarded(*used, lower)
    frequent = table.filter(F.col("n") >= least_gram).select("g", "shift").toPandas()
    return Tree(Lookup(head["g"].to_numpy()), head["s"].to_numpy(dtype=float), least_word, n, distinct, Lookup(frequent["g"].to_numpy()), frequent["shift"].to_numpy(dtype=float), least_gram, table)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct codes: where one stands, and how often."""
    order = codes.argsort()
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    return order[first], np.diff(np.append(first, len(codes)))


def counted(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of each place, sorted, their places, and how often each stands there. Equal codes come with rising places."""
    order = codes.argsort(kind="stable")
    codes, places = codes[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (places[1:] != places[:-1])])[: len(codes)])
    return codes[first], places[first], np.diff(np.append(first, len(codes)))


#: A document's row, or codes that several documents (a unit) ask for, or what these codes add to them.
MOVED = "unit long, place int, key string, n_tokens long, n_known long, base double, shifted double, size int, data binary"
DOCUMENT = ["place", "key", "n_tokens", "n_known", "base", "shifted"]


def rows_of(kind: str, n: int, **columns: object) -> pa.RecordBatch:
    """n rows of that Arrow schema, other columns null."""
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(k, types[t]) for k, t in map(str.split, kind.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=pa.schema(fields))


def score(docs: DataFrame, tree: Tree, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    context = docs.sparkSession.sparkContext
    shared, bits_ = context.broadcast((tree.words, tree.logs, tree.grams, tree.shifts)), context.broadcast(bitmap(tree.table))
    bits, asked = parts_bits(tree.train_tokens), f"part int, {MOVED}"
    whole_mass = tree.train_tokens + ADD * (tree.distinct + 1)
    unknown = float(np.log10(ADD / whole_mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, logs, grams, shifts), some_bits = shared.value, bits_.value
        unit, n_docs, held = TaskContext.get().partitionId() << 32, 0, []
        for rows, texts in byte_blocks(batches, "text", BLOCK):
            coded = Coded(texts)
            at = words(coded.codes(1))
            base = np.where(at >= 0, logs[at], unknown) if len(logs) else np.full(len(at), unknown)
            shifted = np.zeros(len(at))
            # a word by its hash, a gram by its code; both with the number of their text
            rare = np.flatnonzero(at < 0)
            held.append((coded.hashes[rare], (coded.text[rare] + n_docs).astype(np.uint32)))
            for length in range(1, DEPTH + 2):
                use = np.flatnonzero(coded.place >= length - 1)
                codes = coded.codes(length)[use]
                some = has_bit(some_bits, codes)
                use, codes = use[some], codes[some]
                found = grams(codes)
                shifted[use[found >= 0]] += shifts[found[found >= 0]]
                held.append((codes[found < 0].view(np.uint64), (coded.text[use[found < 0]] + n_docs).astype(np.uint32)))
            sums = lambda x: np.add.reduceat(x, coded.starts)
            n, places = len(texts), np.arange(n_docs, n_docs + len(texts))
            part = np.full(n, ((unit >> 32) + unit) % (1 << bits))
            yield rows_of(asked, n, part=part, unit=np.full(n, unit), place=places, key=rows.column("key"), n_tokens=coded.sizes, n_known=sums((at >= 0).astype(np.int64)), base=sums(base), shifted=sums(shifted))
            n_docs += n
            if n_docs >= UNIT_DOCS or sum(len(x[0]) for x in held) >= ENTRIES:
                yield moved(unit, held)
                unit, n_docs, held = unit + 1, 0, []
        if held:
            yield moved(unit, held)

    def moved(unit: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codes, places, k = counted(*(np.concatenate(x) for x in zip(*held)))
        rows = list(dealt(codes, bits, places, k.astype(np.uint32)))
        return rows_of(asked, len(rows), part=[r[0] for r in rows], unit=[unit] * len(rows), size=[r[1] for r in rows], data=[r[2] for r in rows])

    def answered(asking: pa.Table, table: pa.Table) -> pa.Table:
        asks = asking.filter(pa.compute.is_valid(asking["data"]))
        order = (g := np.asarray(table["g"]).view(np.uint64)).argsort()
        g, value, word = g[order], np.asarray(table["value"])[order], table["word"].to_numpy()[order].astype(bool)
        units, sizes, found = [], [], []
        for unit, size, data in zip(asks["unit"].to_pylist(), asks["size"].to_pylist(), asks["data"].to_pylist(), strict=True):
            codes, places, k = unpacked(data, size, np.uint64, np.uint32, np.uint32)
            codes = codes.cumsum()
            at = np.minimum(np.searchsorted(g, codes), len(g) - 1)
            hit = g[at] == codes if len(g) else np.zeros(len(at), dtype=bool)
            if not hit.any():
                continue
            at, k = at[hit], k[hit].astype(float)
            of, place = np.unique(places[hit], return_inverse=True)
            is_word, added = word[at], k * value[at]
            base, known, shift = (np.bincount(place, x, len(of)) for x in (added * is_word, k * is_word, added * ~is_word))
            units.append(unit)
            sizes.append(len(of))
            found.append(packed(of, known.astype(np.uint32), base, shift))
        documents = asking.filter(pa.compute.is_null(asking["data"])).drop_columns("part")
        return pa.concat_tables([documents, pa.Table.from_batches([rows_of(MOVED, len(units), unit=units, size=sizes, data=found)])])

    def together(group: pa.Table) -> pa.Table:
        rows = group.filter(pa.compute.is_null(group["data"])).select(DOCUMENT).sort_by("place")
        n_known, base, shifted = (rows[c].to_numpy().copy() for c in ("n_known", "base", "shifted"))
        answers = group.filter(pa.compute.is_valid(group["data"]))
        for size, data in zip(answers["size"].to_pylist(), answers["data"].to_pylist(), strict=True):
            of, known, more, shift = unpacked(data, size, np.uint32, np.uint32, np.float64, np.float64)
            n_known[of] += known
            base[of] += more
            shifted[of] += shift
        return pa.table({"key": rows["key"], "n_tokens": rows["n_tokens"], "n_known": n_known, "base": base, "shifted": shifted})

    kind = docs.schema[key].dataType
    asking = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, asked)
    share = F.log10((F.col("n") + F.lit(ADD)) / F.lit(whole_mass)) - F.lit(unknown)
    # what isn't in the head: words by their hashes, then grams
    rare = words_coded(counts.filter(F.col("n") < tree.least_word)).select(F.col("g").bitwiseXOR(of_length(1)).alias("g"), share.alias("value"), F.lit(True).alias("word"))
    table = rare.unionAll(tree.table.filter(F.col("n") < tree.least_gram).select("g", F.col("shift").alias("value"), F.lit(False).alias("word")))
    table = table.withColumn("part", F.shiftrightunsigned("g", 64 - bits).cast("int"))
    answers = written(asking.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(answered, MOVED), "answers")
    rows = answers.groupBy("unit").applyInArrow(together, "key string, n_tokens long, n_known long, base double, shifted double")
    return rows.select(
        F.col("key").cast(kind).alias(key),
        (fold("key", FOLDS) == HELD).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tree.train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("base") + F.col("shifted")).alias("score"),
    )


def fit_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all rows of docs.

    Tokens: words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and an end. A null or empty text is an end alone. base_score is the
    text's log10 probability by single words, score that by the tree. A null key counts as empty text for the fold.
    Repeated rows each count and come back; other columns aren't read. An empty table gives no rows; where all rows are held
    out, every token has the probability 1 / 1 of an empty vocabulary.
    """
    learned = training(docs, key)
    counts = written(word_counts(learned, text), "word-counts")
    tree = fit(learned, counts, text)
    found = score(docs, tree, counts, key, text)
    discarded(counts, tree.table)
    return found
