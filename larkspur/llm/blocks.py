"""Arrow batches cut into blocks of bounded text, for the operators that work a block at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters of text that are unpacked at once; one longer text is a block of its own.
BLOCK_CHARS = 8_000_000


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts) in order; a null text comes as an empty one."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        for i, n in enumerate(lengths(texts)):
            if size and size + n > most:
                yield batch.slice(start, i - start), unpacked(texts, start, i)
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), unpacked(texts, start, len(texts))


def byte_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The same with UTF-8 bytes, which need no decoding."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start, size = 0, 0
        for i, n in enumerate(lengths(texts)):
            if size and size + n > most:
                yield batch.slice(start, i - start), [x or b"" for x in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), [x or b"" for x in texts.slice(start).to_pylist()]


def lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def unpacked(texts: pa.Array, start: int, end: int) -> list[str]:
    return [x or "" for x in texts.slice(start, end - start).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])
