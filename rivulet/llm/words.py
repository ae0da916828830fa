"""Words, their hashes and shingles over whole Arrow columns, without a Python loop per word.

A text is its UTF-8 bytes; a null text is empty. Words are maximal runs of bytes outside a set of gap bytes; the
default gaps are ASCII white space, so words are ``[^\\x20\\x09-\\x0D]+``. Hashes have 64 bits and are the same on
every machine and in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
LONG_WORD = 4096
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SCRAMBLE = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII but letters and digits; the bytes of other characters belong to words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``size`` bytes, so that temporary arrays stay small.

    Yields the first and last row, the bytes back to back, and where each row's bytes begin and the last one's end.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        high = min(high, len(column))
        yield low, high, whole[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
    """Where words start and end, and for each row the index of its first word (one more entry than rows)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    gap = gaps[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = ~gap
    end = start.copy()
    start[1:] &= gap[:-1] | first[1:-1]
    end[:-1] &= gap[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _SCRAMBLE
    return h ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, eight bytes at a time over all spans at once."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * _MULTIPLY + np.uint64(1))
    live, at = np.flatnonzero(left <= LONG_WORD), starts
    at, left = starts[live], left[live]
    while live.size:
        chunk = eight[at] & _MASKS[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ chunk) * _MULTIPLY)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
    """Hash of every word in A-Z lower case, and the index of each row's first word."""
    starts, ends, first = spans(data, offsets, gaps)
    return hashes(lower_ascii(data), starts, ends), first


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences, given the hashes of their first, second, ... elements."""
    out = mix(parts[0] + np.uint64(len(parts)))
    for part in parts[1:]:
        out = mix(out * _MULTIPLY + part)
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    return combine([words[k : len(words) - size + 1 + k] for k in range(size)])


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed numbers that Spark's long holds."""
    return np.ascontiguousarray(values).view(np.int64)
