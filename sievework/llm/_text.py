"""Words and hashes of many texts at once, as numpy arrays.

Texts come as one array of UTF-8 bytes and the offsets of the texts in it.
A word is a longest run of bytes other than space and bytes 9 to 13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: A span longer than this is hashed on its own.
LONG_SPAN = 256
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut into (first text, text after the last, bytes, offsets) of about size bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def small(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows at most."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def lower(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case; all else as it is."""
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def eights(data: np.ndarray) -> np.ndarray:
    """For each place, and the one after the last, the eight bytes from there on as a number, zeros beyond the end. A view that isn't aligned."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; different salts give independent ones.

    Eight bytes at a time are stirred into what came before by a bijection, so
    spans of one length up to eight bytes never share a hash, and no sum can
    cancel as in a polynomial. Longer than LONG_SPAN: BLAKE2b.
    """
    size = (end - start).astype(np.int64)
    h = mix(size.astype(np.uint64) ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C55) & 0xFFFFFFFFFFFFFFFF))
    many = np.flatnonzero(size > LONG_SPAN)
    for i in many:
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    each = eights(data)
    on = np.flatnonzero((size > 0) & (size <= LONG_SPAN)) if len(many) else np.flatnonzero(size > 0)
    at, left, now = start[on], size[on], h[on]
    while len(on):
        now = mix(now ^ (each[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        done = ~more
        h[on[done]] = now[done]
        on, at, left, now = on[more], at[more] + 8, left[more] - 8, now[more]
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and first[i], the number of words before text i."""
    n = len(data)
    solid = np.ones(n + 1, bool)
    solid[:n] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    solid[n] = False
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # a word never goes from one text into the next
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | begins[1:]
    start = np.flatnonzero(starts)
    ends = np.zeros(n + 1, bool)
    ends[1:] = solid[:-1] & (~solid[1:] | begins[1:])
    return start, np.flatnonzero(ends), np.searchsorted(start, offsets)


def schema_of(fields, *more: str) -> str:
    """A DDL schema of Spark's fields and further "name type" parts."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields), *more])


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with columns put in the place of those of the same name, or at the end."""
    made = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
