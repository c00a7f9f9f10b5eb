"""Shared pieces of the corpus operators: byte-level tokens, batch slicing, shared-folder tables.

Kernels work on Arrow batches.  A text column is one contiguous UTF-8 buffer, so token
boundaries are found by numpy on bytes and the tokens are dictionary-encoded by Arrow:
no per-row Python loop is needed to count, hash or compare words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.tables import shared_folder, written as materialize  # noqa: F401

#: Bytes that belong to words: ASCII letters, digits, underscore and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
WORD_BYTES[128:] = True
#: Bytes that are not ASCII white space.
SOLID_BYTES = np.ones(256, dtype=bool)
SOLID_BYTES[[9, 10, 11, 12, 13, 32]] = False

#: Text bytes that a kernel handles at once; bounds the memory of a Python worker.
SLICE_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """64-bit identity of a row: equal for repeated rows, different for two texts under one id."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one StringArray without nulls (a null is an empty text) that starts at offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if column.offset:
        column = pa.concat_arrays([column])
        if column.offset:
            column = pc.take(column, pa.array(np.arange(len(column))))
    return column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and the n + 1 offsets of the texts in them."""
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def keep_heap() -> None:
    """Keep freed memory in the process until `give_back`: large temporaries otherwise go to the system and come back cleared, page by page."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


def give_back() -> None:
    """Return free memory to the system: a worker that is used again otherwise keeps the peak of every earlier kernel."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides itself
        pass


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        give_back()
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


class Tokens:
    """Maximal runs of bytes of one class in a batch of texts.

    starts, ends: byte offsets in `raw`; first: index of each text's first token (n + 1 values).
    """

    def __init__(self, column: pa.Array, table: np.ndarray = WORD_BYTES):
        self.raw, self.offsets = buffers(column)
        inside = table[self.raw]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        if len(inside):
            edge[0] = edge[-1] = True
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
            edge[self.offsets] = True
        cuts = np.flatnonzero(edge)
        left, right = cuts[:-1], cuts[1:]
        keep = inside[left] if len(left) else np.zeros(0, bool)
        self.starts, self.ends = left[keep], right[keep]
        self.first = np.searchsorted(self.starts, self.offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """Code of each token and the distinct tokens."""
        n = len(self.starts)
        if n == 0:
            return np.zeros(0, np.int64), pa.array([], pa.string())
        offs = np.zeros(n + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=offs[1:])
        flat = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offs), pa.py_buffer(self.raw[self._inside])])
        coded = flat.dictionary_encode()
        return np.asarray(coded.indices).astype(np.int64), coded.dictionary

    def texts(self) -> np.ndarray:
        """Index of the text of each token."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 steps) on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64))


def hash_strings(values: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string, computed over its bytes; alike on every worker."""
    raw, offs = buffers(values)
    n = len(values)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        starts = offs[:-1]
        where = np.arange(len(raw)) - np.repeat(starts, np.diff(offs))
        top = int(where.max()) + 1
        powers = _POWERS if top <= len(_POWERS) else np.cumprod(np.full(top, _BASE, np.uint64))
        out[full] = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[where], starts[full])
    return mix(out + np.diff(offs).astype(np.uint64))


def lowered(column: pa.Array) -> pa.Array:
    return text_array(pc.utf8_lower(column))


def segment_sum(values: np.ndarray, first: np.ndarray, dtype=None) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; empty segments give 0."""
    shape = (len(first) - 1, *values.shape[1:])
    out = np.zeros(shape, dtype or values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=dtype or values.dtype)
    return out
