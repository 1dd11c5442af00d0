"""Words of many texts as numbers, exactly: two words have one number if and only if they are the same bytes of one text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lakewarden.llm.textkernels import PIECE, pieces, word_spans


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word ``data[start:end]``, dense from 0 in order of first occurrence."""
    length = end - start
    stop = np.cumsum(length)
    place = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)
    offsets = np.concatenate([[0], stop]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[place])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def numbered_words(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of whole texts of about ``limit`` bytes: the first row, the bytes, the texts' offsets in them, the words'
    numbers, and for each text the index of its first word (one more than texts).

    Words of different texts have different numbers, so whatever compares numbers never matches across texts.
    """
    for row, data, offsets in pieces(column, limit):
        start, end, first = word_spans(data, offsets)
        numbers = word_numbers(data, start, end)
        kinds = int(numbers.max()) + 1 if len(numbers) else 0
        yield row, data, offsets, numbers + np.repeat(np.arange(len(first) - 1) * kinds, np.diff(first)), first


def match_lengths(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """How many words agree from ``a`` and ``b`` (two different places) on, by comparing them, in steps that double."""
    n = len(numbers)
    padded = np.concatenate([numbers, [-1]])
    length = np.zeros(len(a), dtype=np.int64)
    active, step = np.arange(len(a)), 1
    while len(active):
        still = []
        for k in range(0, len(active), max(1, cells // step)):
            own = active[k : k + max(1, cells // step)]
            reach = length[own][:, None] + np.arange(step)
            equal = padded[np.minimum(a[own][:, None] + reach, n)] == padded[np.minimum(b[own][:, None] + reach, n)]
            whole = equal.all(axis=1)
            length[own] += np.where(whole, step, equal.argmin(axis=1))
            still.append(own[whole])
        active, step = np.concatenate(still), min(2 * step, cells)
    return length
