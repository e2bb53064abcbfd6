"""Array code that the text operators share: words, hashes and ranges of whole Arrow columns.

A column of texts is one run of UTF-8 bytes and a list of offsets; everything here works on
such runs with numpy, some megabytes at a time, and never on one word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any bits of the result serve as a key."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, where - where[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes: first row, end row, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(data: np.ndarray) -> np.ndarray:
    """Prefix sums of which substring hashes are differences; see `span_hash`."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end): equal strings, equal values, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the row of each; none crosses rows."""
    solid = ~SEPARATOR[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[heads] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[heads[1:] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_LANES = mix(np.arange(11, 27, dtype=np.uint64))


def windows(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive values of one row, and the index of the first of each."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(values) - n + 1
    whole = np.flatnonzero(rows[:k] == rows[n - 1 :])
    total = np.zeros(k, np.uint64)
    for i in range(n):
        total += values[i : i + k] * _LANES[i]
    return mix(total[whole]), whole


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row: hashes, ascending in a row, and offsets of the rows.

    A-Z count as a-z. A row of fewer than n words has its whole sequence as one shingle.
    """
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    values = span_hash(runs(data), starts, ends)
    out, first = windows(values, rows, n)
    out_rows = rows[first]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])
        more = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = counts[short] > i
            more[has] += values[at[short[has]] + i] * _LANES[i]
        out = np.concatenate([out, mix(more + counts[short].astype(np.uint64))])
        out_rows = np.concatenate([out_rows, short])
    order = np.lexsort((out, out_rows))
    out, out_rows = out[order], out_rows[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (out_rows[1:] != out_rows[:-1])
    out, out_rows = out[keep], out_rows[keep]
    return out, np.searchsorted(out_rows, np.arange(len(offsets)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
