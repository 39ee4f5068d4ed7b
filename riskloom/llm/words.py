"""Words of Arrow text columns, found for whole batches with byte tables instead of per-row code."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from types import ModuleType
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Text handled at once in a task, so that a batch of long documents needs no more memory than one of short ones.
SLICE_BYTES = 4 << 20
SPACE = 32


def byte_table(separators: bytes, lower: bool = True) -> bytes:
    """A table for bytes.translate: separators become spaces, A-Z lower case; bytes of longer characters stay."""
    table = bytearray(range(256))
    for b in separators:
        table[b] = SPACE
    if lower:
        for b in range(ord("A"), ord("Z") + 1):
            if table[b] != SPACE:
                table[b] = b + 32
    return bytes(table)


#: Words of anything but ASCII white space, and words of letters, digits and characters beyond ASCII.
BY_WHITE_SPACE = byte_table(b"\x20\t\n\v\f\r")
BY_PUNCTUATION = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Words(NamedTuple):
    ids: np.ndarray  #: of each word, its place in ``distinct``
    distinct: pa.Array
    bounds: np.ndarray  #: where each text's words begin, and the end
    starts: np.ndarray  #: byte of the slice at which a word begins
    ends: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = _buffers(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system. A worker idles for a minute beside the tasks of later stages, and the C library
    alone keeps what a task took at most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def process_cache() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("riskloom_process", ModuleType("riskloom_process")).__dict__


def words(texts: pa.Array, table: bytes) -> Words:
    """Words of each text; a null counts as an empty text."""
    process_cache().clear()  # a worker that has turned to words needs no tokenizer's memory
    offsets, data = _buffers(texts)
    offsets = offsets - offsets[0] if len(offsets) else offsets
    raw = np.frombuffer(data.translate(table), np.uint8)
    inside = raw != SPACE
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] |= inside[cuts]  # a word ends with its text
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    ids, distinct = dictionary(raw[inside].tobytes(), np.concatenate([[0], np.cumsum(ends - starts)]))
    return Words(ids, distinct, np.searchsorted(starts, offsets), starts, ends)


def dictionary(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Consecutive pieces of ``data`` as places in a list of the distinct ones."""
    n = len(offsets) - 1
    if n <= 0:
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    pieces = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive word hashes, whatever text they stand in."""
    runs = max(len(hashes) - n + 1, 0)
    out = np.zeros(runs, np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + runs] + np.uint64(0x9E3779B97F4A7C15))
    return out


def filled(texts: pa.Array) -> pa.Array:
    return texts.fill_null("") if texts.null_count else texts


def _buffers(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets of each text, and the bytes that they span."""
    texts = filled(texts)
    if not len(texts):
        return np.zeros(1, np.int64), b""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets, (data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b"")
