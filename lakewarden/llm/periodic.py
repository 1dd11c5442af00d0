"""Periodic runs of words: every maximal stretch that repeats its first words at least four times over.

A run is a stretch of words with smallest period q and a length of at least ``max(MIN_LENGTH, MIN_POWER * q)`` that no
neighbouring word extends with that period. Candidates come from a harmonic grid: for every period p the places 0, 3p,
6p, ... of a text, n/3 * (1 + 1/2 + 1/3 + ...) pairs in all. A run of four periods holds such a place x together with
x + p, and then reaches as far as the text agrees with itself shifted by p to both sides of x. These reaches are longest
common extensions: prefix hashes give them for all pairs of a block by one binary search in step. Stretches found from
several places or as a multiple of their period are one (the smallest period stays), and every stretch that is left is
compared word by word; if a hash misled, the block's reaches are found again by comparing words. So the result is exact.

Texts go to tasks whole and nothing is shuffled. A task holds a few arrays as long as the words of ``PIECE`` bytes of
text (or of one longer text) and ``PAIRS`` pairs at a time.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; rows that repeat an id or a text
are treated alike, each by itself; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.llm.scratch import small_batches
from lakewarden.llm.textkernels import _ODD, mix, powers
from lakewarden.llm.wordids import match_lengths, numbered_words

MIN_LENGTH = 6
MIN_POWER = 4
#: (period, grid point) pairs looked at together.
PAIRS = 1 << 20

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_sums(numbers: np.ndarray) -> np.ndarray:
    """Prefix hashes: running sums of ``hash(word) * base ** place`` with a leading zero."""
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(numbers.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(numbers)))])


def _grid(first: np.ndarray, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about ``pairs`` pairs: the text, the period and the grid point of each."""
    n = np.diff(first)
    periods = n // MIN_POWER * (n >= MIN_LENGTH)
    total = int(periods.sum())
    before = np.concatenate([[0], np.cumsum(periods)])
    at = 0
    while at < total:
        # At most ``pairs`` combinations of a text and a period, cut again where their grid points are too many.
        k = np.arange(at, min(total, at + pairs))
        text = np.searchsorted(before, k, side="right") - 1
        period = k - before[text] + 1
        points = (n[text] - 1 - period) // ((MIN_POWER - 1) * period) + 1
        upto = max(1, int(np.searchsorted(np.cumsum(points), pairs, side="right")))
        text, period, points = text[:upto], period[:upto], points[:upto]
        place = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
        text, period = np.repeat(text, points), np.repeat(period, points)
        yield text, period, first[text] + (MIN_POWER - 1) * period * place
        at += upto


def _reach(sums: np.ndarray, x: np.ndarray, period: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
    """For all pairs at once, how far the words from ``x`` (backward: before it) agree with those a period later."""
    shift, low, high = powers(_ODD, int(period.max(initial=0)) + 1)[period], np.zeros(len(x), dtype=np.int64), limit.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        own, q = x[open_], period[open_]
        middle = (low[open_] + high[open_] + 1) // 2
        a, b = (own, own + middle) if forward else (own - middle, own)
        same = (sums[b] - sums[a]) * shift[open_] == sums[b + q] - sums[a + q]
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1


def _compared(numbers: np.ndarray, first: np.ndarray, text: np.ndarray, x: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same reaches, by comparing words: forward, and backward in the reversed texts."""
    forward = match_lengths(numbers, x, x + period)
    n = len(numbers)
    back = match_lengths(numbers[::-1], n - x, n - x - period)
    return forward, np.minimum(back, x - first[text])


def _all_equal(numbers: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether each stretch really has its period."""
    span = length - period
    done = 0
    while done < len(start):
        upto = done + max(1, int(np.searchsorted(np.cumsum(span[done:]), PAIRS, side="right")))
        own = span[done:upto]
        place = np.arange(own.sum()) + np.repeat(start[done:upto] - (np.cumsum(own) - own), own)
        if not np.array_equal(numbers[place], numbers[place + np.repeat(period[done:upto], own)]):
            return False
        done = upto
    return True


def find_runs(numbers: np.ndarray, first: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every run of every text: the text, the start within it, the length and the period, by text, start and period."""
    sums, end = word_sums(numbers), first[1:]

    def stretches(exact: bool) -> np.ndarray:
        found = [np.empty((0, 4), dtype=np.int64)]
        for text, period, x in _grid(first, pairs):
            near = np.flatnonzero(numbers[x] == numbers[x + period])
            text, period, x = text[near], period[near], x[near]
            if exact:
                forward, back = _compared(numbers, first, text, x, period)
            else:
                forward = _reach(sums, x, period, end[text] - x - period, True)
                back = _reach(sums, x, period, x - first[text], False)
            length = forward + back + period
            good = length >= np.maximum(MIN_LENGTH, MIN_POWER * period)
            rows = np.stack([text, x - back, length, period], axis=1)[good]
            found.append(_smallest_period(rows))
        return _smallest_period(np.concatenate(found))

    rows = stretches(False)
    if not _all_equal(numbers, rows[:, 1], rows[:, 2], rows[:, 3]):
        rows = stretches(True)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1]))]
    return rows[:, 0], rows[:, 1] - first[rows[:, 0]], rows[:, 2], rows[:, 3]


def _smallest_period(rows: np.ndarray) -> np.ndarray:
    """Of stretches with the same start and length the one of smallest period: the others' are multiples of it."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] != rows[:-1, 2])
    return rows[new]


def repeated_words(count: int, first: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words some run contains after its first period."""
    edges = np.zeros(count + 1, dtype=np.int64)
    begin = first[text] + start
    np.add.at(edges, begin + period, 1)
    np.add.at(edges, begin + length, -1)
    return np.cumsum(edges)[:-1] > 0


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets, numbers, first in numbered_words(batch.column(1)):
            text, start, length, period = find_runs(numbers, first)
            dropped = repeated_words(len(numbers), first, text, start, length, period)
            raw, collapsed = data.tobytes(), []
            for k in range(len(offsets) - 1):
                words = raw[offsets[k] : offsets[k + 1]].split()
                own = dropped[first[k] : first[k + 1]]
                collapsed.append(b" ".join(compress(words, ~own) if own.any() else words).decode())
            bounds = pa.array(np.searchsorted(text, np.arange(len(offsets))), pa.int32())
            runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(collapsed)), pa.array(np.diff(first), pa.int64()), runs, pa.array(collapsed, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs`` (doc_id, text): the runs by start and period, each
    with its start (word number from 0), length and period, and the words that are left, joined by one space, when
    those are dropped that a run contains after its first period."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(f"n_words bigint, runs {RUNS}, collapsed string")])
    return docs.select("doc_id", "text").mapInArrow(_batches, schema)


def runs_report(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of all runs and of the rest."""
    found = periodic_runs(docs)
    line = lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("top.length * 1000 div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
