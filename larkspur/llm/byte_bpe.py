"""Byte-level BPE by corpus-level merge replay.

Texts are cut into units (a word with what clings to it), and the units of the whole corpus are counted once. The merges are
replayed over the table of frequent units: an inverted index leads from a token pair to the positions where it stands, by
ranges of ranks from the lowest on, and a merge touches its two neighbours only. That table is broadcast; its size is bounded
by SHARE. Units beyond it, most of which stand in one text, are replayed in the same way by the task that meets them, a block
of texts at a time: joining a table of all units back would shuffle every unit of every text. No token depends on which
way its unit took. Documents are then put together from their units' ids.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.blocks import text_blocks, with_column
from larkspur.llm.common import for_python, free_name, written
from larkspur.llm.lookup import Lookup

#: Units of at least this share of all units of the corpus are frequent: 1 / SHARE of them at most.
SHARE = 2e-6
#: Bytes of the longest piece that is replayed together with others, and characters of the longest frequent unit.
LONGEST = 64
#: Characters of text, or of units of the corpus, that are encoded at once.
BLOCK = 2_000_000
#: Bits of a token's id in a pair's key, and of a position.
BITS, POSITION = 20, 24
#: Pieces that are replayed at once, and ranks in one range of the index.
AT_ONCE, RANGE = 40_000, 1_024
#: A blank between two other characters always starts a piece, whatever surrounds the two.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Blanks for which that doesn't hold.
ODD_BLANK = re.compile(r" (?:(?!\S)|(?<!\S ))")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Replays the merges of a vocabulary over many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens = {rank: token for token, rank in ranks.items()}
        pairs = [(ranks[t[:i]] << BITS | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        #: From a pair of tokens, as left << BITS | right, to the rank of their union.
        self.lookup, self.values = Lookup(keys), values.astype(np.int32)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, -1 for those that don't merge."""
        at = self.lookup((left.astype(np.int64) << BITS) | right)
        return np.where(at >= 0, self.values[at], -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as packed 32-bit integers. A piece that is a token as a whole keeps its own id."""
        whole = [self.ranks.get(x) for x in pieces]
        merged = iter(self.merged([x for x, w in zip(pieces, whole, strict=True) if w is None]))
        return [next(merged) if w is None else w.to_bytes(4, "little") for w in whole]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids that are left of each piece after all merges; pieces aren't empty."""
        out: list[bytes] = [b""] * len(pieces)
        short = [i for i, x in enumerate(pieces) if len(x) <= LONGEST]
        for at in range(0, len(short), AT_ONCE):
            some = short[at : at + AT_ONCE]
            for i, ids in zip(some, self.replayed([pieces[i] for i in some]), strict=True):
                out[i] = ids
        for i, x in enumerate(pieces):
            if len(x) > LONGEST:
                out[i] = self.replayed_alone(x)
        return out

    def replayed(self, pieces: list[bytes]) -> list[bytes]:
        """The merges over many pieces: the index from pairs to positions goes by ranges of ranks, lowest first.

        In a range every piece merges its lowest pair, the leftmost of equals, until it has none there; what a merge makes
        of its two neighbours' pairs goes into this range or a later one. So each piece sees its merges in the order of ranks.
        """
        sizes = np.array([len(x) for x in pieces], dtype=np.int64)
        ends, text = np.cumsum(sizes), np.frombuffer(b"".join(pieces), dtype=np.uint8)
        piece, n = np.repeat(np.arange(len(pieces)), sizes), len(text)
        # for each position: its token (-1 where it has gone into its left neighbour), the live neighbours (-1 at a piece's
        # ends), and the rank of the pair that starts here
        ids, after, before, ranks = self.byte_ids[text], np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        after[ends - 1] = before[ends - sizes] = -1
        ranks[:-1] = self.byte_pairs[text[:-1], text[1:]]
        ranks[ends - 1] = -1
        index: list[list[np.ndarray]] = [[] for _ in range((len(self.byte_ids) + max(self.ranks.values())) // RANGE + 1)]

        def stand(at: np.ndarray) -> None:
            of = ranks[at] // RANGE
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for r, places in zip(of[np.concatenate([[0], cuts])].tolist() if len(of) else (), np.split(at, cuts), strict=False):
                index[r].append(places)

        stand(np.flatnonzero(ranks >= 0))
        for k in range(len(index)):
            if not index[k]:
                continue
            work, below = np.concatenate(index[k]), (k + 1) * RANGE
            index[k] = []
            while True:
                now = ranks[work]
                use = (now >= 0) & (now < below)  # a neighbour of the others has changed since
                work, now = work[use], now[use]
                if not len(work):
                    break
                keys = np.sort(((piece[work] << BITS | now) << POSITION) | work)
                work = keys & ((1 << POSITION) - 1)
                first = np.diff(piece[work], prepend=-1) > 0
                at, rest = work[first], work[~first]
                rank, then = ranks[at], after[at]
                beyond, back = after[then], before[at]
                ids[at], ids[then], ranks[then], ranks[at], after[at] = rank, -1, -1, -1, beyond
                has = beyond >= 0
                right, later = at[has], beyond[has]
                before[later] = right
                ranks[right] = self.ranks_of(rank[has], ids[later])
                has = back >= 0
                left = back[has]
                ranks[left] = self.ranks_of(ids[left], rank[has])
                touched = np.concatenate([right, left])
                made = ranks[touched]
                here = (made >= 0) & (made < below)
                stand(touched[made >= below])
                work = np.concatenate([rest, touched[here]])
        live = ids >= 0
        bounds = np.concatenate([[0], np.cumsum(live)])[np.concatenate([[0], ends])] * 4
        packed, bounds = ids[live].tobytes(), bounds.tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def replayed_alone(self, piece: bytes) -> bytes:
        """The same over one long piece, position by position, in time in proportion to its length (and a logarithm)."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, tokens, get = len(ids), self.tokens, self.ranks.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        ranks = [get(tokens[a] + tokens[b], -1) for a, b in zip(ids, ids[1:], strict=False)] + [-1]
        heap = [(r, at) for at, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            if ranks[at] != rank:
                continue  # a neighbour has changed since
            then = after[at]
            beyond, back = after[then], before[at]
            ids[at], ids[then], ranks[then], ranks[at], after[at] = rank, -1, -1, -1, beyond
            if beyond >= 0:
                before[beyond] = at
                ranks[at] = get(tokens[rank] + tokens[ids[beyond]], -1)
                if ranks[at] >= 0:
                    heapq.heappush(heap, (ranks[at], at))
            if back >= 0:
                ranks[back] = get(tokens[ids[back]] + tokens[rank], -1)
                if ranks[back] >= 0:
                    heapq.heappush(heap, (ranks[back], back))
        return np.array([x for x in ids if x >= 0], dtype=np.int32).tobytes()


class Numbers(dict):
    """Numbers what it is asked for, in the order of asking."""

    def __missing__(self, key) -> int:
        found = self[key] = len(self)
        return found


class BlockEncoder:
    """Encodes blocks of texts; has the ids of the frequent units, and replays the merges over all others of a block."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.replay = MergeReplay(read_ranks(path))
        self.pattern = regex.compile(pattern)
        #: From a unit, with the blank before it, to its packed ids.
        self.frequent: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """The text, cut only where a piece is sure to start; each unit but the first has lost the blank before it."""
        return text.split(" ") if not ODD_BLANK.search(text) else CUT.split(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's start and the last one's end."""
        numbers, rows, sizes = Numbers(), [], []
        for x in texts:
            units = self.units(x)
            units[0] = (units[0],)  # it has no blank before it
            sizes.append(len(units))
            rows.append(np.fromiter(map(numbers.__getitem__, units), dtype=np.int32, count=len(units)))
        which = np.concatenate(rows)
        packed = self.learned([x[0] if type(x) is tuple else f" {x}" for x in numbers])
        table, lengths = np.frombuffer(b"".join(packed), dtype=np.int32), np.array([len(x) // 4 for x in packed])
        starts, counts = np.cumsum(lengths) - lengths, lengths[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(starts[which] - ends[:-1], counts) + np.arange(ends[-1])
        return table[at], ends[np.concatenate([[0], np.cumsum(sizes)])]

    def learned(self, units: Collection[str]) -> list[bytes]:
        """The packed ids of each unit, given with the blank before it."""
        find = self.frequent.get
        out = list(map(find, units))
        new = [i for i, x in enumerate(out) if x is None]
        pieces = Numbers()
        cut = []
        for i in new:
            x = units[i]
            # ASCII letters, and a blank before them, are one piece
            one = x.isascii() and x[x[:1] == " " :].isalpha()
            cut.append(pieces[x] if one else [pieces[w] for w in self.pattern.findall(x)])
        ids = self.replay.encode([w.encode() for w in pieces])
        for i, c in zip(new, cut, strict=True):
            out[i] = ids[c] if type(c) is int else b"".join([ids[k] for k in c])
        return out


_ENCODERS: dict[tuple[str, str], BlockEncoder] = {}
_TOKENS: dict[str, list[bytes]] = {}


def _encoder(path: str, pattern: str) -> BlockEncoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = BlockEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def _tokens(path: str) -> list[bytes]:
    """The bytes of each id, read once for each worker process."""
    if path not in _TOKENS:
        ranks = read_ranks(path)
        found = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            found[rank] = token
        _TOKENS[path] = found
    return _TOKENS[path]


def frequent_units(docs: DataFrame, path: str, pattern: str, text: str = "text", share: float = SHARE) -> dict[str, bytes]:
    """The ids of the corpus's frequent units, replayed over their table by the executors: 1 / share units at most.

    All units of all texts are counted, by column functions alone; each task sends a row for each unit that it has met.
    """
    units = docs.select(F.explode(F.split(F.col(text), " ")).alias("unit"))
    counts = written(units.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    table = counts.filter((F.col("n") >= max(2.0, share * total)) & (F.length("unit") <= LONGEST) & (F.col("unit") != "")).select("unit")

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder(path, pattern)
        for rows, texts in text_blocks(batches, "unit", BLOCK):
            yield with_column(rows, "ids", pa.array(encoder.learned([f" {x}" for x in texts]), pa.binary()))

    return {f" {r['unit']}": bytes(r["ids"]) for r in table.mapInArrow(replayed, "unit string, ids binary").toLocalIterator()}


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds `into`, array<int>: the ids of the whole text, special tokens read as plain text.

    A null or empty text has no ids. Rows, repeats and other columns stay as they are; a column named like `into` is
    replaced. An empty table stays empty. `path` is a rank file that every executor can open, `pattern` its split.
    """
    column = text if into != text else free_name(docs, text)
    kept = docs.drop(into) if into != text else docs.withColumnRenamed(text, column)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, path, pattern, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        encoder.frequent = shared.value
        for rows, texts in text_blocks(batches, column, BLOCK):
            ids, ends = encoder.encode(texts)
            yield with_column(rows, into, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)))

    return for_python(kept).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Replaces `ids` by `into`, binary: the bytes of the tokens, one after the other. Null or no ids give no bytes."""
    kept = encoded.drop(into) if into != ids else encoded
    rest = [f for f in kept.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = [b"".join(map(tokens.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else ())) for x in batch.column(at)]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=[*names, into])

    return for_python(kept).mapInArrow(run, T.StructType([*rest, T.StructField(into, T.BinaryType())]))
