"""Vectorised scans of UTF-8 text held in Arrow batches: words, their hashes and shingles, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes that one scan holds at once, with some arrays of 8 bytes for each; a single longer document is scanned whole.
SLICE_BYTES = 1 << 19


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values from a seed."""
    x = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 0xD1B54A32D192ED03 % (1 << 64))
    return mix(mix(x))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = seeded(256, 7)
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), U64)
        have[1:] = U64(base)
        have = _powers[base] = np.multiply.accumulate(have, dtype=U64)
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (and the last ends); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return raw((pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string()))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """utf8() of a large_string or large_binary array without nulls."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return the memory of a task's arrays to the system; the worker lives on and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in slices of about `most` bytes of text, each with the bytes and offsets of its texts."""
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
    give_back()


def runs(apart: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are not apart, never across texts: starts, ends, and the text that each lies in."""
    n = len(apart)
    inner = at[(at > 0) & (at < n)]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[1:], before[0] = apart[:-1], True
        after[:-1], after[-1] = apart[1:], True
        before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each run's bytes."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, A-Z as a-z, and the text of each."""
    starts, ends, text = runs(SPACES[data], at)
    return run_hashes(data, starts, ends), text


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text; a text with fewer words (but some) has its whole sequence as one."""
    count = np.bincount(text, minlength=n_texts)
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, U64(size), U64)
    for j in range(size):
        out = mix(out + hashes[j : n + j])
    inside = text[:n] == text[size - 1 : size - 1 + n]
    out, owner = out[inside], text[:n][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        extra = np.empty(len(short), U64)
        for k, t in enumerate(short):
            x = np.full(1, U64(count[t]), U64)
            for w in hashes[first[t] : first[t] + count[t]]:
                x = mix(x + w)
            extra[k] = x[0]
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
    return out, owner


def distinct_by_text(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending, texts in order."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], owner[keep]


def offsets(owner: np.ndarray, n_texts: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_texts))]).astype(np.int64)
