"""Whole texts of an Arrow batch as flat arrays: bytes, words, word hashes, shingles. No per-row Python objects.

All functions work on a chunk of some texts: ``raw`` holds their bytes one after the other, ``ends`` where each text
begins and the last one ends. Chunks are cut by bytes, so memory is bounded by the chunk or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def numbers(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(count, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))


BYTE_VALUES = numbers(256, 11)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
STEP = U(0x9E3779B97F4A7C15 | 1)


def chunks(
    column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 4096
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, ends) of as many texts as fit the limits, one at least. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), row + rows, n)
        yield row, stop, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each text (one more than texts)."""
    n = len(raw)
    solid = ~SPACE[raw]
    border = np.zeros(n + 1, dtype=bool)
    border[ends] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | border[1:n]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | border[1:n]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(stops) + 1, np.searchsorted(begin, ends)


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each word: polynomial over random byte values, then mixed with its length."""
    if len(begin) == 0:
        return np.zeros(0, dtype=U)
    lengths = end - begin
    first = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=first[1:])
    solid = raw[~SPACE[raw]]
    power = np.empty(int(lengths.max()), dtype=U)
    with np.errstate(over="ignore"):
        power[0] = 1
        power[1:] = STEP
        np.multiply.accumulate(power, out=power)
        place = np.arange(len(solid)) - np.repeat(first[:-1], lengths)
        return mix(np.add.reduceat(values[solid] * power[place], first[:-1]) + lengths.astype(U) * U(0xD6E8FEB86659FD93))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text after text, and where each text begins.

    A text with fewer words has its whole sequence as the only run; a text without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(runs, out=begin[1:])
    out = np.zeros(int(begin[-1]), dtype=U)
    factors = numbers(width, 23) | U(1)
    with np.errstate(over="ignore"):
        if len(hashes) >= width:
            summed = np.zeros(len(hashes) - width + 1, dtype=U)
            for k in range(width):
                summed += hashes[k : k + len(summed)] * factors[k]
            place = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(len(out))
            long = np.repeat(counts >= width, runs)
            out[long] = mix(summed[place[long]])
        for n in range(1, width):
            texts = np.flatnonzero(counts == n)
            if len(texts):
                summed = np.full(len(texts), U(n) * U(0xA24BAED4963EE407), dtype=U)
                for k in range(n):
                    summed += hashes[first[texts] + k] * factors[k]
                out[begin[texts]] = mix(summed)
    return out, begin
