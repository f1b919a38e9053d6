"""Array kernels over the UTF-8 buffer of an Arrow text column.

A batch of texts is one byte array and the offsets at which its texts begin, so
words, n-grams and windows of a whole batch are found without a Python object
per text.  Spans are fingerprinted from a prefix polynomial modulo 2**64 with an
odd base, then mixed; equal bytes always give equal fingerprints, and two
different spans share one with odds of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are neither ASCII letters or digits nor part of a longer code point.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Lower-cases A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial of a byte array, for ``span_hash``."""
    power, _ = _power_tables(len(data))
    out = np.zeros(len(data) + 1, U)
    terms = data.astype(U)
    terms += U(1)
    terms *= power[: len(data)]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of every span ``[start, end)``."""
    _, inverse = _power_tables(len(prefix) - 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def window_hash(prefix: np.ndarray, width: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the windows of ``width`` bytes at ``starts``, or at every byte."""
    if starts is not None:
        return span_hash(prefix, starts, starts + width)
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, U)
    _, inverse = _power_tables(len(prefix) - 1)
    return mix((prefix[width:] - prefix[:n]) * inverse[:n])


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    n = len(data)
    inside = ~separator[data]
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` values within a text, and the index of each run's first value.

    ``first`` holds the index of the first value of each text, one more at the end.
    """
    m = len(values) - size + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(m, U)
    factor = 1
    for k in range(size):
        total += values[k : k + m] * U(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    end_of = np.repeat(first[1:], np.diff(first))[:m]
    at = np.flatnonzero(np.arange(m) + size <= end_of)
    return mix(total[at] + U(size)), at


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and their new bounds."""
    out = np.array(values)
    keep = np.ones(len(out), bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
            keep[a + 1 : b] = out[a + 1 : b] != out[a : b - 1]
    counted = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], counted[first]


#: Text bytes that one piece of a batch holds, unless a single text is longer.
PIECE_BYTES = 2 << 20


def pieces(batches, column: str):
    """Batches cut into runs of rows of about ``PIECE_BYTES`` text each."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    ranked = np.sort(values)
    begins = np.ones(len(ranked), bool)
    begins[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(begins)
    return ranked[at], np.diff(np.append(at, len(ranked)))


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of each value among them, and the first index of each."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    begins = np.ones(len(ranked), bool)
    begins[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(begins)
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(begins) - 1
    return ranked[at], which, order[at]
