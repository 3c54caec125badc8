"""Words of whole texts as numpy arrays: bounds and 64-bit hashes, many documents at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as
`[^\\x20\\x09-\\x0D]+` on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are handled in pieces of about so many bytes, so that arrays stay small.
CHUNK = 1 << 20

_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK + 1)
        base = _BASES[kind]
        inverse = pow(base, -1, 1 << 64)
        have = tuple(
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)])
            for b in (base, inverse)
        )
        _POWERS[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each row (one more than rows).

    rows: offsets in `data`, from 0 to its length; a word never crosses them.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(rows), np.int64)
    inside = ~SEPARATORS[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = rows[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, rows)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(stops, begin + CHUNK, "right")))
        end = stops[last - 1]
        up, down = powers("byte", int(end - begin) + 1)
        sums = np.zeros(end - begin + 1, np.uint64)
        part = data[begin:end].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: end - begin]
        np.cumsum(part, out=sums[1:])
        s, e = starts[first:last] - begin, stops[first:last] - begin
        out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix(out)


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, len(words) - n + 1 of them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        total = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            total *= np.uint64(_BASES["word"])
            total += words[k : len(words) - n + 1 + k]
        return mix(total)
    up, down = powers("word", len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])
