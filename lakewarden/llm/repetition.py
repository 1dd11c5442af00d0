"""Quality rules over whole texts, with repetition found by a suffix array.

The words of a text, as numbers, get a suffix array (prefix doubling in which suffixes that stand alone drop out) and
the longest common prefix of neighbours in it. These prefixes are found by comparing words where the pair of suffixes
isn't preceded by equal words, which costs n log n comparisons in all; every other one is one less than its
predecessor's in the text. Intervals of the prefix array whose suffixes are not all preceded by one word are the maximal
repeated substrings; their occurrences are united to the words that repetition covers. A text fails if they cover more than
``MAX_COVERED_PERCENT`` of its words or if one of them is longer than ``MAX_LONGEST`` words. The base rules (number of words, share of
words in repeated windows of eight) come first; the windows are read off the same arrays.

Nothing is hashed: words are numbered by their bytes and all comparisons are of numbers. Texts go to tasks whole and nothing is
shuffled; many short texts share one suffix array, in which they can't match each other.

Defined cases: a null or empty text has no words, so it fails the base rules, with counts of 0; rows that repeat an id or a
text are judged alike, each by itself; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lakewarden.llm.scratch import small_batches
from lakewarden.llm.textkernels import BLANKS
from lakewarden.llm.wordids import match_lengths, numbered_words

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
#: Words of the shortest repeat that counts, the share of words in such repeats and the longest one that may stay.
MIN_REPEAT = 5
MAX_COVERED_PERCENT = 30
MAX_LONGEST = 50
SYMBOLS = b"#*$%&|<>"

_symbol = np.zeros(256, dtype=bool)
_symbol[list(SYMBOLS)] = True

COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean,"
    " covered_words bigint, longest_repeat bigint, n_repeats bigint"
)


def suffix_array(numbers: np.ndarray) -> np.ndarray:
    """The places of all suffixes in the order of the numbers they begin with."""
    n = len(numbers)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    order = np.argsort(numbers, kind="stable")
    new = np.concatenate([[True], numbers[order][1:] != numbers[order][:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = np.maximum.accumulate(np.where(new, np.arange(n), 0)), -1
    active = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    step = 1
    while len(active):
        own = order[active]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[active] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = active[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return order


def common_prefixes(numbers: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in ``order`` the number of words it shares with the one before it (0 for the first)."""
    n = len(numbers)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    before = np.empty(n, dtype=np.int64)
    before[order] = np.concatenate([[-1], order[:-1]])
    place = np.arange(n)
    # Where the words before the two suffixes agree, the prefix is the predecessor's less one.
    follows = (place > 0) & (before > 0)
    follows[follows] = numbers[place[follows] - 1] == numbers[before[follows] - 1]
    heads = np.flatnonzero(~follows)
    reach = np.zeros(len(heads), dtype=np.int64)
    known = before[heads] >= 0
    reach[known] = match_lengths(numbers, heads[known], before[heads[known]])
    last = np.cumsum(~follows) - 1
    return (reach[last] - (place - heads[last]))[order]


def maximal_repeats(numbers: np.ndarray, order: np.ndarray, prefixes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, words) for each interval of ``order`` whose suffixes share ``words`` >= ``least`` words, no more to
    the right and no word to the left that is the same for all."""
    found, stack = [], []
    left = np.concatenate([[-1], numbers])[order]
    # How far back from each suffix the word to the left has been the same.
    same = np.maximum.accumulate(np.where(np.concatenate([[True], left[1:] != left[:-1]]), np.arange(len(order)), 0)) if len(order) else order
    high = np.flatnonzero(prefixes >= least)
    previous = -2
    for k, value in zip(high.tolist(), prefixes[high].tolist(), strict=True):
        if k != previous + 1:
            _close(stack, 0, previous, found)
        begin = _close(stack, value, k - 1, found)
        if not stack or stack[-1][0] < value:
            stack.append((value, k - 1 if begin is None else begin))
        previous = k
    _close(stack, 0, previous, found)
    return [(a, b, words) for a, b, words in found if same[b] > a or left[b] == -1]


def _close(stack: list, value: int, last: int, found: list) -> int | None:
    """End the intervals that share more than ``value`` words; where the outermost of them began."""
    begin = None
    while stack and stack[-1][0] > value:
        words, begin = stack.pop()
        found.append((begin, last, words))
    return begin


def covered(start: np.ndarray, length: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` words lie in one of the spans."""
    edges = np.zeros(count + 1, dtype=np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges)[:-1] > 0


def _by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _rules(min_repeat: int, max_covered_percent: int, max_longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets, numbers, first in numbered_words(batch.column(1)):
                texts = len(offsets) - 1
                n_words = np.diff(first)
                chars = _by_text(~BLANKS[data] & ((data & 0xC0) != 0x80), offsets)
                symbols = _by_text(_symbol[data], offsets)
                raw = data.tobytes()
                lines = np.array([repeated_lines(raw[offsets[k] : offsets[k + 1]]) for k in range(texts)], dtype=np.int64)
                order = suffix_array(numbers)
                prefixes = common_prefixes(numbers, order)
                shared = np.zeros(len(numbers), dtype=np.int64)
                shared[order] = np.maximum(prefixes, np.concatenate([prefixes[1:], [0]])) if len(order) else prefixes
                window = np.flatnonzero(shared >= WINDOW)
                repeat_words = _by_text(covered(window, np.full(len(window), WINDOW), len(numbers)), first)
                repeats = maximal_repeats(numbers, order, prefixes, min_repeat)
                owner = np.searchsorted(first, order[[a for a, _, _ in repeats]], side="right") - 1 if repeats else np.empty(0, dtype=np.int64)
                longest = np.zeros(texts, dtype=np.int64)
                np.maximum.at(longest, owner, np.array([words for _, _, words in repeats], dtype=np.int64))
                spans = np.flatnonzero(shared >= min_repeat)
                cover = _by_text(covered(spans, shared[spans], len(numbers)), first)
                failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEATED_PERCENT * n_words)
                kept = ~failed & (100 * cover <= max_covered_percent * n_words) & (longest <= max_longest)
                values = [n_words, chars, symbols, lines, repeat_words, failed, kept, cover, longest, np.bincount(owner, minlength=texts)]
                arrays = [pa.array(v.astype(bool) if v.dtype == bool else v.astype(np.int64)) for v in values]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, texts), *arrays], names=["doc_id", *names])

    names = [part.split()[0] for part in COLUMNS.split(",")]
    return run


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The counts and verdicts of every row of ``docs`` (doc_id, text).

    ``covered_words`` are those in maximal repeats of ``min_repeat`` words or more, ``longest_repeat`` and ``n_repeats`` the
    longest of these and their number.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(COLUMNS)])
    return docs.select("doc_id", "text").mapInArrow(_rules(min_repeat, max_covered_percent, max_longest), schema)
