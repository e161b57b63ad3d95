"""Token-ID output: flat files of unsigned integers, 64-bit document offsets, and a manifest; read back memory-mapped.

Format: for each part, `part-N.ids` (little-endian unsigned integers of the manifest's width), `part-N.keys` (int64, the
documents' keys; those of null keys come first and are 0) and `part-N.offsets` (uint64, one more than documents: where each
document starts among the ids of all parts). `manifest.json` has the width and each part's base, documents, tokens and null
keys. Documents are in ascending order of key over all parts; the parts' bases are prefix sums of their token counts.

Texts are encoded before they move, so the shuffle carries two bytes a token. A part is written as a stream and renamed at
its end: a retried or doubled task writes the same file again.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.blocks import byte_blocks
from larkspur.llm.common import key_bounds, range_of, shared_dir, shuffle_partitions

#: Units of text between white space whose ids a task remembers, and the longest such unit in bytes.
MEMORY, LONGEST = 600_000, 64
#: Marks at the end of a word.
MARKS = b".,;:!?"
#: Bytes of ids that the reader hands on at once.
READ_BYTES = 4_000_000

_TOKENIZERS: dict[str, list] = {}


class Memory(dict):
    """Packed ids of units. Looking up a unit without any gives a place among `open`, to be filled when those are encoded together."""

    def __init__(self):
        super().__init__()
        self.open: dict[bytes, bytearray] = {}

    def __missing__(self, unit: bytes) -> bytearray:
        place = self.open.get(unit)
        if place is None:
            place = self.open[unit] = bytearray()
        return place


def _tokenizer(path: str):
    """One tokenizer, and a younger and an older memory of units, for each worker process."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = [Tokenizer.from_file(path), Memory(), Memory()]
    return _TOKENIZERS[path]


def parted(unit: bytes) -> tuple[bytes, bytes]:
    """What a unit is encoded as: letters and the marks after them, which the tokenizer parts as well; else it stays whole.

    A-Z are lower-cased where nothing else is in the unit that upper and lower case could treat differently. The tokenizer
    composes and lower-cases first, which turns some letters into a letter and a combining mark; that one is no letter and
    forms a piece with the marks after it, so such a unit stays whole.
    """
    lower = unit.lower() if unit.isascii() and b"<|" not in unit else unit
    core = lower.rstrip(MARKS)
    return (core, lower[len(core) :]) if len(core) < len(lower) and core and all_letters(core) else (lower, b"")


def all_letters(core: bytes) -> bool:
    """Whether a word is letters alone before and after what the tokenizer does to it."""
    if core.isascii():
        return core.isalpha()
    word = core.decode()
    return word.isalpha() and not parting_letters().search(word)


@cache
def parting_letters() -> re.Pattern:
    """The letters that come apart, each by itself, when they are composed and lower-cased."""
    letters = (c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalpha())
    return re.compile(f"[{''.join(c for c in letters if not unicodedata.normalize('NFC', c).lower().isalpha())}]")


def learned(tokenizer, known: dict[bytes, bytes], units: list[bytes], kind: str) -> None:
    """Adds the packed ids of each unit to what is known."""
    halves = [parted(x) for x in units]
    fresh = list({x for pair in halves for x in pair if x and x not in known})
    for at in range(0, len(fresh), 20_000):
        some = fresh[at : at + 20_000]
        for piece, found in zip(some, tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
            known[piece] = array(kind, found.ids).tobytes()
    for unit, (core, tail) in zip(units, halves, strict=True):
        if unit not in known:
            known[unit] = known[core] + known[tail] if tail else known[core]


def width_of(path: str) -> int:
    """Bytes of an id: 2 where the vocabulary fits, else 4."""
    return 2 if _tokenizer(path)[0].get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def encode_block(path: str, texts: list[bytes], end: int, width: int) -> list[bytes]:
    """The packed ids of each text and the end id. White space is no token and parts all others, so units are encoded once each."""
    tools = _tokenizer(path)
    if len(tools[1]) > MEMORY:  # what is used again comes back from the older memory, the rest is forgotten
        tools[1:] = Memory(), tools[1]
    tokenizer, known, older = tools
    # one look-up a unit: the places of new ones are filled below
    found = [list(map(known.__getitem__, x.split())) for x in texts]
    new, known.open = known.open, {}
    kind = "H" if width == 2 else "I"
    known.update((x, older[x]) for x in new if x in older)
    learned(tokenizer, known, [x for x in new if x not in older], kind)
    for unit, place in new.items():
        place += known[unit]
        if len(unit) > LONGEST:
            del known[unit]
    last = array(kind, [end]).tobytes()
    return [b"".join(units) + last for units in found]


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _replace(store: pafs.FileSystem, made: str, name: str) -> None:
    """Renames over what another attempt may have left."""
    if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(name).type != pafs.FileType.NotFound:
        store.delete_file(name)
    store.move(made, name)


def _write(store: pafs.FileSystem, name: str, data: bytes) -> None:
    made = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(made) as out:
        out.write(data)
    _replace(store, made, name)


def write(docs: DataFrame, folder: str, path: str, end: int = 2, key: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Encodes every row's text by the tokenizer at `path` and writes the files of the format above into `folder`.

    `folder` is one that the driver and all executors see. A null or empty text gives the end id alone. Null keys come
    first; rows of equal keys follow each other in the order of their ids. An empty table gives a manifest without parts.
    Columns other than key (an integer) and text aren't read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounds = key_bounds(plain, "key", parts or shuffle_partitions(spark))
    width = width_of(path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(encode_block(path, texts, end, width), pa.binary())], names=["key", "ids"])

    def saved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        now, out, made, keys, ends, total, nulls = None, None, "", [], [], 0, 0

        def finish() -> pa.RecordBatch:
            out.close()
            _replace(store, made, f"{root}/part-{now:06d}.ids")
            _write(store, f"{root}/part-{now:06d}.keys", np.concatenate(keys).astype("<i8").tobytes())
            # lengths until the bases are known
            _write(store, f"{root}/part-{now:06d}.lengths", np.concatenate(ends).astype("<u8").tobytes())
            n = sum(map(len, keys))
            return pa.RecordBatch.from_pydict({"part": [now], "docs": [n], "tokens": [total], "nulls": [nulls]})

        for batch in batches:
            at = np.asarray(batch.column("part"))
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at[a] != now:
                    if out is not None:
                        yield finish()
                    now, keys, ends, total, nulls = int(at[a]), [], [], 0, 0
                    made = f"{root}/part-{now:06d}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(made)
                some = batch.slice(a, b - a)
                ids = some.column("ids").to_pylist()
                out.write(b"".join(ids))
                sizes = np.fromiter((len(x) // width for x in ids), dtype=np.int64, count=len(ids))
                keys.append(np.asarray(some.column("key").fill_null(0)))
                ends.append(sizes)
                total += int(sizes.sum())
                nulls += some.column("key").null_count
        if out is not None:
            yield finish()

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    ids = plain.mapInArrow(encoded, "key long, ids binary").withColumn("part", range_of("key", bounds))
    dealt = ids.repartition(max(1, len(bounds)), "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "ids")
    found = sorted(dealt.mapInArrow(saved, "part long, docs long, tokens long, nulls long").collect())  # a row for each part
    bases, base = [], 0
    for x in found:
        bases.append((x["part"], base, x["docs"], x["tokens"], x["nulls"]))
        base += x["tokens"]

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/part-{part:06d}.lengths") as f:
                    sizes = np.frombuffer(f.read(), dtype="<u8")
                _write(store, f"{root}/part-{part:06d}.offsets", (np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(base)).tobytes())
            yield pa.RecordBatch.from_pydict({"part": batch.column("part")})

    if bases:
        table = spark.createDataFrame(bases, "part long, base long, docs long, tokens long, nulls long")
        table.repartition(min(len(bases), shuffle_partitions(spark)), "part").mapInArrow(offsets, "part long").count()
    names = ("part", "base", "docs", "tokens", "nulls")
    manifest = {"width": width, "end": end, "parts": [dict(zip(names, x, strict=True)) for x in bases]}
    _write(store, f"{root}/manifest.json", json.dumps(manifest).encode())


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """One row per document of the files: key, start, n_tokens, ids (binary: little-endian unsigned 32-bit integers)."""
    store, root = _store(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = f"<u{manifest['width']}"
    schema = "key long, start long, n_tokens long, ids binary"
    parts = [(x["part"], x["base"], x["nulls"]) for x in manifest["parts"]]
    if not parts:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)

    def mapped(store: pafs.FileSystem, name: str, dtype: str) -> np.ndarray:
        """A local file is memory-mapped; from another store it is read."""
        if isinstance(store, pafs.LocalFileSystem):
            return np.memmap(name, dtype=dtype, mode="r") if store.get_file_info(name).size else np.empty(0, dtype)
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read(), dtype=dtype)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for part, base, nulls in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "nulls")), strict=True):
                name = f"{root}/part-{part:06d}"
                ids, keys, offsets = mapped(store, f"{name}.ids", kind), mapped(store, f"{name}.keys", "<i8"), mapped(store, f"{name}.offsets", "<u8").astype(np.int64)
                local, at, n = offsets - base, 0, len(keys)
                while at < n:
                    to = max(at + 1, min(n, int(np.searchsorted(local, local[at] + READ_BYTES // 4, "right")) - 1, at + 10_000))
                    values = [ids[a:b].astype("<u4").tobytes() for a, b in zip(local[at:to].tolist(), local[at + 1 : to + 1].tolist(), strict=True)]
                    mask = np.arange(at, to) < nulls
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at:to], mask=mask), pa.array(offsets[at:to]), pa.array(np.diff(offsets[at : to + 1])), pa.array(values, pa.binary())], names=["key", "start", "n_tokens", "ids"])
                    at = to

    table = spark.createDataFrame(parts, "part long, base long, nulls long").repartition(len(parts), "part")
    return table.mapInArrow(rows, schema).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs into a new folder of the shared store and reads the files back."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path, end, key, text)
    return read(docs.sparkSession, folder, key)
