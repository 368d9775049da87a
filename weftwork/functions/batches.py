"""Words of whole Arrow batches, as numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``, or of other bytes, of the text with A-Z lower-cased. Words are
handled as 64-bit hashes; that two of them are confused by chance is not considered.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone, and whole.
CHUNK_BYTES = 1_000_000

_M = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, 256, dtype=np.uint64)[_LOWER]
_tables: dict[str, np.ndarray] = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["pow"]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        inverse = pow(_M, -1, 2**64)
        with np.errstate(over="ignore"):
            for name, base in (("pow", _M), ("inv", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _tables[name] = np.multiply.accumulate(steps)
    return _tables["pow"], _tables["inv"]


#: What lets go of things that a worker keeps from task to task.
KEPT: list[Callable[[], None]] = []


def relieve(but: Callable[[], None] | None = None) -> None:
    """Give memory that isn't used any more back to the system, at the end of a task: a waiting worker shares its executor's room.
    What is kept from task to task goes too, ``but`` for the task's own."""
    for drop in KEPT:
        if drop != but:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + (limit or CHUNK_BYTES), "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, space: np.ndarray = _SPACE, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, start byte, end byte, first word of each text as n + 1 offsets). ``space`` tells
    for each byte whether it separates words, ``inside`` for each place whether it is of a word, if given."""
    data, offs = buffers(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~space[data] if inside is None else inside
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * power[:n], out=total[1:])
        h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, offs)
