"""NumPy kernels over the UTF-8 bytes of many texts at once: words, shingles and byte-string hashes.

A batch is a pair ``(data, offsets)``: the concatenated bytes and the position where each text begins (one
more offset than texts). Hashes of byte ranges come from one running sum of ``table[byte] * P**i`` modulo
2**64: the difference of two entries, divided by ``P**start``, depends on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; a longer text is a piece of its own.
PIECE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def _byte_table(fold_case: bool) -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        table[65:91] = table[97:123]
    return table


_EXACT, _FOLDED = _byte_table(False), _byte_table(True)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** (0 .. n-1)`` modulo 2**64, grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled, step = 1, np.uint64(base)
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * step
            step = np.uint64(int(step) * int(step) & _MASK)
            filled *= 2
        _powers[base] = have
    return have[:n]


_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the 64-bit finaliser of MurmurHash3, a public-domain function)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """Running sums with a leading zero, for :func:`range_hash`."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_FOLDED if fold_case else _EXACT)[data] * powers(_ODD, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start:end``, a function of those bytes and their number."""
    raw = (sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without copying; null texts are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[: offsets[-1]], offsets


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split a batch into runs of whole texts of about ``limit`` bytes: (first row, data, offsets from 0)."""
    data, offsets = text_arrays(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


#: Bytes between words: white space, or all that is no ASCII letter or digit and no part of a longer character.
BLANKS = _space
NON_LETTERS = np.ones(256, dtype=bool)
NON_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more than texts)."""
    inside = ~between[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[begin] = inside[begin]
    ends = inside.copy()
    ends[:-1] &= starts[1:] | ~inside[1:]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word."""
    start, end, first = word_spans(data, offsets)
    return range_hash(prefix_sums(data, fold_case), start, end), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words within a text; a shorter text has its whole sequence as one.

    Returns the hashes, text after text, and for each text the index of its first one.
    """
    count = np.diff(first)
    own = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(own)])
    multipliers = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(width, dtype=np.uint64)])
    position = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], own)
    total = np.zeros(len(position), dtype=np.uint64)
    for k in range(width):
        total += padded[position + k] * multipliers[k]
    short = np.flatnonzero((count > 0) & (count < width))
    for text in short:
        total[begin[text]] = np.sum(words[first[text] : first[text + 1]] * multipliers[: count[text]]) + np.uint64(count[text])
    return mix(total), begin


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows: the first row and each text's sorted set of shingle hashes (uint64)."""
    for row, data, offsets in pieces(column):
        shingles, begin = shingle_hashes(*word_hashes(data, offsets), width)
        yield row, [np.unique(shingles[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
