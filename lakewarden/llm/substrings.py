"""Suffix-array dedup with a logarithmic index family.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller doc_id.

**Pieces.** A window is a run of ``LENGTH`` bytes of a document. Its anchor is the run of ``GRAM`` bytes in it with the
least hash, so equal windows have equal anchors. Neighbouring windows with equal anchors make a piece, which is the bytes
they cover. Every window is in one piece, and pieces go to shards by their anchors, with their bytes: equal windows meet.

**Before the shuffle.** A piece whose bytes are also a piece of an earlier document among those that the task has at
hand is all repeated; that is settled there. So what many documents share comes to its shard once for each run of some
``FLUSH`` bytes. An anchor with more pieces than a shard should hold (found on a sample of documents that grows with the
corpus; it decides only the way that windows take) has its windows dealt by their whole content.

**Index family.** In a shard the pieces come in batches of ascending doc_id. Each batch gets a suffix array (``starts``
in the order of the next bytes), which is merge-scanned against the arrays of the existing levels: entries side by side
that agree in all bytes asked for are a match. What is new becomes a level, and levels of about equal size merge, so
there are O(log n) of them. The family is used over the suffixes at the anchors, which shows the pieces that might have a
match, and over all suffixes of those where a window starts. All matches are of bytes, never of hashes. Where an anchor's 32-bit
hash comes more than once in a piece, all pieces of the shard with an anchor of that hash are looked up by window.

**Removal.** Matched runs are packed by the range of documents they belong to, so that a range's runs and its
compressed texts meet in one task, runs first.

Defined cases: a null text is empty; a text of fewer than 50 bytes loses nothing; a null doc_id is neither smaller nor
larger than any, so its text is left alone; rows that repeat a doc_id don't affect each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.scratch import small_batches, stage
from lakewarden.llm.textkernels import _INVERSE as INVERSE
from lakewarden.llm.textkernels import _EXACT, _ODD, mix, pieces, powers, prefix_sums, range_hash

LENGTH = 50
GRAM = 12
#: Text bytes whose pieces make a shard, and text bytes in a range of documents, about.
SHARD_BYTES = 10 << 20
RANGE_BYTES = 16 << 20
#: Bytes of pieces or texts that a task packs at a time, suffixes in a batch of the index family, text bytes in a run.
FLUSH = 40 << 20
BATCH = 1 << 20
PIECE = 1 << 18
MANY = 1 << 16
#: Texts in which frequent anchors are looked for: all of up to so many bytes, and never less than this share.
SAMPLE_BYTES, SAMPLE_SHARE = 16 << 20, 1 / 1024


# Pieces


def _order_values(sums: np.ndarray, n: int, gram: int) -> np.ndarray:
    """For every position a 32-bit value that depends on the next ``gram`` bytes."""
    return _ordered((sums[gram:] - sums[:-gram]) * powers(INVERSE, len(sums))[: n - gram + 1])


def _order_values_at(text: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """These values for some positions, without sums over the whole text."""
    raw = np.zeros(len(places), dtype=np.uint64)
    for k, power in enumerate(powers(_ODD, gram)):
        raw += _EXACT[text[places + k]] * power
    return _ordered(raw)


def _ordered(raw: np.ndarray) -> np.ndarray:
    raw ^= raw >> np.uint64(29)
    raw *= np.uint64(0xBF58476D1CE4E5B9)
    return (raw >> np.uint64(32)).astype(np.uint32)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


class Pieces:
    """The pieces of a run of texts: ``start`` and ``windows`` (their number), the anchors' values and first places
    (and ``MANY`` added to those of pieces in which the anchor's value comes more than once)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        n = len(data)
        self.start = self.windows = np.empty(0, dtype=np.int64)
        self.value = np.empty(0, dtype=np.uint32)
        self.doc = self.anchor = self.start
        if n < length:
            return
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.sums = prefix_sums(data)
        values = _order_values(self.sums, n, gram)
        least = _sliding_min(values, length - gram + 1)
        inside = doc[: n - length + 1] == doc[length - 1 :]
        fresh = np.ones(len(least) + 1, dtype=bool)
        fresh[1:-1] = (least[1:] != least[:-1]) | ~inside[:-1] | ~inside[1:]
        edges = np.flatnonzero(fresh)
        kept = inside[edges[:-1]]
        self.start, self.windows = edges[:-1][kept], np.diff(edges)[kept]
        self.value, self.doc = least[self.start], doc[self.start]
        self.anchor = np.full(len(self.start), -1)
        last = self.anchor.copy()
        for ahead in range(length - gram + 1):
            last[values[self.start + self.windows - 1 + ahead] == self.value] = ahead
            back = length - gram - ahead
            self.anchor[values[self.start + back] == self.value] = back
        self.anchor[last + self.windows - 1 != self.anchor] += MANY


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``count[i]`` numbers for each i, one after another."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _equal_bytes(text: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size[i]`` bytes at ``one[i]`` are those at ``other[i]``; no size is 0."""
    if not len(size):
        return np.zeros(0, dtype=bool)
    same = text[_spread(one, size)] == text[_spread(other, size)]
    return np.logical_and.reduceat(same, np.cumsum(size) - size)


def _repeats(text: np.ndarray, start: np.ndarray, size: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a piece's bytes are also those of a piece of a smaller document. Digests find them, bytes decide."""
    found = np.zeros(len(doc), dtype=bool)
    order = np.argsort(digest)
    equal = digest[order][1:] == digest[order][:-1]
    several = np.zeros(len(order), dtype=bool)
    several[1:] = equal
    several[:-1] |= equal
    order = order[several]
    order = order[np.lexsort((doc[order], digest[order]))]
    fresh = np.diff(digest[order], prepend=~digest[order[:1]]) != 0
    leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    later = np.flatnonzero((doc[order] > doc[leader]) & (size[order] == size[leader]))
    found[order[later]] = _equal_bytes(text, start[order[later]], start[leader[later]], size[leader[later]])
    return found


# Packing


def _differences(values: np.ndarray) -> bytes:
    """Little-endian bytes of the differences, low bytes first."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _pack(columns: list[tuple[str, np.ndarray]], tail: bytes = b"") -> bytes:
    head = b"".join(_differences(values.astype(kind)) for kind, values in columns)
    return struct.pack("<i", len(columns[0][1])) + zstandard.ZstdCompressor(level=3).compress(head + tail)


def _unpack(blob: bytes, kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    (n,) = struct.unpack_from("<i", blob)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), dtype=np.uint8)
    columns, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = data[at : at + n * size].reshape(size, n)
        columns.append(np.cumsum(planes.T.copy().view(kind).reshape(-1), dtype=kind).astype(np.int64))
        at += n * size
    return columns, data[at:]


#: Columns of pieces (doc_id, row number, position, bytes, place of the anchor), of runs (doc_id, row number, begin, bytes)
#: and of texts (doc_id, row number, bytes, whether there is an id).
PIECE_KINDS = ["<i8", "<i4", "<u4", "<u4", "<u4"]
RUN_KINDS = ["<i8", "<i4", "<u4", "<u4"]
TEXT_KINDS = ["<i8", "<i4", "<u4", "<u4"]


def _range_of(doc: np.ndarray, number: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) ^ mix(number.astype(np.uint64))) % np.uint64(ranges)).astype(np.int64)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and its rows, in their order."""
    rows = np.argsort(keys, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(keys[rows], prepend=-1)), len(rows))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(keys[rows[a]]), rows[a:b]


class _Runs:
    """Gathers matched runs and hands them out by range of documents."""

    def __init__(self, ranges: int):
        self.ranges, self.parts, self.held = ranges, [], 0

    def add(self, doc: np.ndarray, number: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        if len(doc):
            self.parts.append((doc, number, begin, size))
            self.held += len(doc)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            doc, number, begin, size = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            for key, rows in _groups(_range_of(doc, number, self.ranges)):
                yield key, _pack([(kind, c[rows]) for kind, c in zip(RUN_KINDS, (doc, number, begin, size), strict=True)])
        self.parts, self.held = [], 0


def _batches(rows: Iterator[tuple[int, bytes]], first: str) -> Iterator[pa.RecordBatch]:
    """Rows of a number and bytes, a few megabytes at a time."""
    keys, blobs, held = [], [], 0
    for key, blob in rows:
        keys.append(key)
        blobs.append(blob)
        held += len(blob)
        if held >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=[first, "blob"])
            keys, blobs, held = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=[first, "blob"])


def _anchors(length: int, gram: int):
    """The anchors of texts and their numbers of pieces in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0), PIECE):
                value, count = np.unique(Pieces(data, offsets, length, gram).value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(count.astype(np.int64))], names=["value", "count"])

    return run


def _dealt(shards: int, ranges: int, heavy: np.ndarray, length: int, gram: int):
    """Rows of (doc_id, number, text) to packed pieces by shard, and to runs settled here under -1 - range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        runs, held = _Runs(ranges), 0

        def flush() -> Iterator[tuple[int, bytes]]:
            nonlocal held
            text = np.concatenate([p[0] for p in parts])
            size, doc, number, position, anchor, route, digest = (np.concatenate(c) for c in list(zip(*parts, strict=True))[1:])
            start = np.cumsum(size) - size
            parts.clear()
            held = 0
            settled = _repeats(text, start, size, digest, doc)
            runs.add(doc[settled], number[settled], position[settled], size[settled])
            left = np.flatnonzero(~settled)
            for shard, rows in _groups((route[left] % np.uint64(shards)).astype(np.int64)):
                own = left[rows]
                columns = zip(PIECE_KINDS, (doc[own], number[own], position[own], size[own], anchor[own]), strict=True)
                yield shard, _pack(list(columns), text[_spread(start[own], size[own])].tobytes())
            for key, blob in runs.blobs():
                yield -1 - key, blob

        def taken() -> Iterator[tuple[int, bytes]]:
            nonlocal held
            for batch in batches:
                doc_ids, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for row, data, offsets in pieces(batch.column(2), PIECE):
                    found = Pieces(data, offsets, length, gram)
                    if not len(found.start):
                        continue
                    start, windows, doc, anchor, value = found.start, found.windows, found.doc, found.anchor, found.value
                    route = mix(value.astype(np.uint64) + np.uint64(1))
                    single = np.zeros(len(start), dtype=bool)
                    if len(heavy):
                        often = np.isin(value, heavy)
                        single = np.concatenate([single[~often], np.ones(int(windows[often].sum()), dtype=bool)])
                        each = lambda c: np.concatenate([c[~often], np.repeat(c[often], windows[often])])  # noqa: B023, E731
                        starts = np.concatenate([start[~often], _spread(start[often], windows[often])])
                        # The anchor of a single window is only where its suffix is looked at first: its beginning.
                        doc, anchor, route, start, windows = each(doc), np.where(single, 0, each(anchor)), each(route), starts, np.where(single, 1, each(windows))
                    size = windows + (length - 1)
                    digest = range_hash(found.sums, start, start + size)
                    parts.append((data[_spread(start, size)], size, doc_ids[row + doc], numbers[row + doc].astype(np.int64), start - offsets[doc], anchor, np.where(single, digest, route), digest))
                    held += int(size.sum())
                    if held >= FLUSH:
                        yield from flush()
            if parts:
                yield from flush()

        yield from _batches(taken(), "shard")

    return run


# The index family


def _words(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The next ``n`` (at most 8) bytes as a number that orders as they do; ``text`` ends in 8 spare bytes."""
    values = np.lib.stride_tricks.sliding_window_view(text, 8)[at].view(">u8").reshape(-1).astype(np.uint64)
    return values >> np.uint64(64 - 8 * n)


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their next ``length`` bytes (ties as given), and for each place but the first in
    that order whether it agrees with the one before in all of them. Runs that are in order already merge fast."""
    key = _words(text, starts, min(8, length))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    for ahead in range(8, length, 8):
        if not equal.any():
            break
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] = equal
        tied[:-1] |= equal
        at = np.flatnonzero(tied)
        group = np.concatenate([[0], np.cumsum(~equal)])[at]
        own = order[at]
        key = _words(text, starts[own] + ahead, min(8, length - ahead))
        fresh = np.diff(group, prepend=-1) != 0
        differ = np.zeros(int(group[-1]) + 1, dtype=bool)
        differ[group[key != key[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]]] = True
        mixed = np.flatnonzero(differ[group])  # groups that agree in these bytes too are in order
        inner = mixed[np.lexsort((key[mixed], group[mixed]))]
        order[at[mixed]], key[mixed] = own[inner], key[inner]
        equal[at[1:] - 1] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
    return order, equal


class IndexFamily:
    """Suffix arrays of geometrically growing size over the batches added so far. A level has different suffixes only,
    each in the place where it came first: a pair of arrays, where it starts in the text and its number."""

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length = text, length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _scan(self, level: tuple[np.ndarray, np.ndarray], starts: np.ndarray) -> np.ndarray:
        """For each suffix of an array the number of its match in a level, or -1, by one merge of the two."""
        order, equal = suffix_order(self.text, np.concatenate([level[0], starts]), self.length)
        found = np.full(len(starts), -1)
        hit = np.flatnonzero(equal)
        found[order[hit + 1] - len(level[0])] = level[1][order[hit]]
        return found

    def add(self, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Scan a batch and make what is new a level. Returns for each suffix the number of the first that equals it."""
        order, equal = suffix_order(self.text, starts, self.length)
        group = np.concatenate([[0], np.cumsum(~equal)]) if len(order) else order
        leaders = order[np.concatenate([[True], ~equal])] if len(order) else order
        first, fresh = numbers[leaders].copy(), np.ones(len(leaders), dtype=bool)
        for level in self.levels:
            found = self._scan(level, starts[leaders])
            fresh &= found < 0
            first = np.where(found < 0, first, found)
        if fresh.any():
            self.levels.append((starts[leaders[fresh]], numbers[leaders[fresh]]))
            while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
                a, b = self.levels.pop(-2), self.levels.pop()
                both = [np.concatenate(c) for c in zip(a, b, strict=True)]
                merged, _ = suffix_order(self.text, both[0], self.length)
                self.levels.append((both[0][merged], both[1][merged]))
        out = np.empty(len(starts), dtype=np.int64)
        out[order] = first[group]
        return out


def _in_batches(doc: np.ndarray, count: np.ndarray, most: int = BATCH) -> Iterator[slice]:
    """Runs of pieces with some ``most`` suffixes, ``count`` for each piece; a document is never split."""
    ends, begin = np.cumsum(count), 0
    while begin < len(doc):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        end = int(np.searchsorted(doc, doc[end - 1], side="right"))
        yield slice(begin, end)
        begin = end


def _firsts(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """By an index family: for each suffix the number of the first that equals it, and whether there are others."""
    family, first = IndexFamily(text, length), np.empty(len(starts), dtype=np.int64)
    for rows in _in_batches(doc, np.ones(len(starts), dtype=np.int64), most):
        first[rows] = family.add(starts[rows], np.arange(rows.start, rows.stop))
    several = first != np.arange(len(starts))
    several[first[several]] = True
    return first, several


def matched_runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, text: np.ndarray, length: int, gram: int, most: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes covered by windows that also start in a smaller document: piece, begin in the piece, bytes.

    Pieces are in order of ``doc``; ``text`` ends in 8 spare bytes. A piece with an anchor of its own has no match, nor
    has one that shares with no other what lies around the anchor: a window has at least half its other bytes before
    or behind it. That holds where the anchor comes once in all pieces that have it. Of the pieces left, one that is all
    the bytes of an earlier document's piece is one run; windows of the rest are looked up.
    """
    many, anchor = anchor >= MANY, anchor % MANY
    first, asked = _firsts(text, start + anchor, doc, gram, most)
    # A piece with two anchors of one value, different ones perhaps, may match a piece that has only the second.
    values = _order_values_at(text, start + anchor, gram)
    unclear = np.isin(values, np.unique(values[many]))
    asked = np.flatnonzero(asked | unclear)
    kept, half = unclear[asked], (length - gram + 1) // 2
    for before in (0, half):  # what follows the anchor, what precedes it
        own = np.flatnonzero((anchor[asked] >= before) & (anchor[asked] - before + gram + half <= size[asked]))
        piece = asked[own]
        kept[own] |= _firsts(text, start[piece] + anchor[piece] - before, doc[piece], gram + half, most)[1]
    asked = asked[kept]
    # What tells most unequal pieces apart; bytes decide, and what it doesn't tell apart is looked up by window.
    digest = mix(first[asked].astype(np.uint64) << np.uint64(20) ^ size[asked].astype(np.uint64))
    digest ^= mix(_words(text, start[asked], 8)) ^ mix(_words(text, start[asked] + size[asked] - 8, 8) + np.uint64(1))
    whole = _repeats(text, start[asked], size[asked], digest, doc[asked])
    settled, open_ = asked[whole], asked[~whole]
    found = [(settled, np.zeros(len(settled), dtype=np.int64), size[settled])]
    family, known_doc, number = IndexFamily(text, length), [], 0
    windows = size[open_] - (length - 1)
    for rows in _in_batches(doc[open_], windows, most):
        piece = np.repeat(open_[rows], windows[rows])
        place = _spread(np.zeros(rows.stop - rows.start, dtype=np.int64), windows[rows])
        # Suffixes are numbered by document, so that a number tells how early its document is.
        fresh = np.diff(doc[piece], prepend=doc[piece[0]] - 1) != 0
        numbers = number + np.cumsum(fresh) - 1
        number = int(numbers[-1]) + 1
        hit = np.flatnonzero(family.add(start[piece] + place, numbers) < numbers)
        if len(hit):
            edge = np.ones(len(hit), dtype=bool)
            edge[1:] = (piece[hit][1:] != piece[hit][:-1]) | (np.diff(place[hit]) != 1)
            a = np.flatnonzero(edge)
            b = np.append(a[1:], len(hit)) - 1
            found.append((piece[hit[a]], place[hit[a]], place[hit[b]] - place[hit[a]] + length))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _shard_runs(blobs: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matched runs of a shard: doc_id, row number, begin in the text, bytes."""
    parts = [_unpack(blob, PIECE_KINDS) for blob in blobs]
    doc, number, position, size, anchor = (np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True))
    text = np.concatenate([*(p[1] for p in parts), np.zeros(8, dtype=np.uint8)])
    parts.clear()
    start = np.cumsum(size) - size
    order = np.lexsort((position, number, doc))
    doc, number, position = doc[order], number[order], position[order]
    piece, begin, covered = matched_runs(doc, start[order], size[order], anchor[order], text, length, gram)
    return doc[piece], number[piece], position[piece] + begin, covered


def _scan(shards: int, ranges: int, length: int, gram: int):
    """Sorted rows of (shard, blob) to runs by range of documents; runs that are settled already pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(ranges)

        def taken() -> Iterator[tuple[int, bytes]]:
            shard, blobs = None, []
            for batch in batches:
                for own, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if own < 0:
                        yield -1 - own, blob.as_py()
                        continue
                    if blobs and own != shard:
                        runs.add(*_shard_runs(blobs, length, gram))
                        blobs = []
                        if runs.held >= BATCH:
                            yield from runs.blobs()
                    shard = own
                    blobs.append(blob.as_py())
            if blobs:
                runs.add(*_shard_runs(blobs, length, gram))
            yield from runs.blobs()

        yield from _batches(taken(), "range")

    return run


# Texts


def _packed_texts(ranges: int):
    """Rows of (doc_id, number, text) to ``range, kind 1, blob``, many texts in a blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def flush() -> Iterator[tuple[int, bytes]]:
            nonlocal held
            text = np.concatenate([p[0] for p in parts])
            size, known, doc, number = (np.concatenate(c) for c in list(zip(*parts, strict=True))[1:])
            parts.clear()
            held = 0
            start = np.cumsum(size) - size
            # No runs wait for a text without an id, so it goes anywhere.
            spread = np.where(known, number, np.arange(len(doc)))
            for key, rows in _groups(_range_of(doc, spread, ranges)):
                columns = zip(TEXT_KINDS, (doc[rows], number[rows], size[rows], known[rows]), strict=True)
                yield key, _pack(list(columns), text[_spread(start[rows], size[rows])].tobytes())

        def taken() -> Iterator[tuple[int, bytes]]:
            nonlocal held
            for batch in batches:
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                doc, number = (batch.column(k).fill_null(0).to_numpy().astype(np.int64) for k in (0, 1))
                for row, data, offsets in pieces(batch.column(2), PIECE):
                    own = slice(row, row + len(offsets) - 1)
                    parts.append((data, np.diff(offsets), known[own], doc[own], number[own]))
                    held += len(data)
                    if held >= FLUSH // 2:
                        yield from flush()
            if parts:
                yield from flush()

        for batch in _batches(taken(), "range"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ones(batch.num_rows, dtype=np.int32)), batch.column(1)], names=["range", "kind", "blob"])

    return run


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals; touching intervals are one run."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return begin[first], reach[np.append(first[1:] - 1, len(begin) - 1)] if len(begin) else reach


class _Covered:
    """The runs of a range of documents, to be looked up by row."""

    def __init__(self, blobs: list[bytes]):
        parts = [_unpack(blob, RUN_KINDS)[0] for blob in blobs] or [[np.empty(0, dtype=np.int64)] * 4]
        doc, number, self.begin, self.size = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((number, doc))
        doc, number, self.begin, self.size = doc[order], number[order], self.begin[order], self.size[order]
        edges = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(number) != 0)) + 1).tolist(), len(doc)]
        self.rows = {(int(doc[a]), int(number[a])): (a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a}

    def of(self, doc: int | None, number: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.rows.get((doc, number), (0, 0))
        return _spans(self.begin[a:b], self.begin[a:b] + self.size[a:b])


def _cut(keep_text: bool):
    """Sorted rows of (range, kind, blob), runs before texts, to what is left of the documents."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def left(blob: bytes, covered: _Covered) -> Iterator[tuple]:
        (doc, number, size, known), text = _unpack(blob, TEXT_KINDS)
        text, ends = memoryview(text), np.cumsum(size).tolist()
        for row, (doc_id, own, end) in enumerate(zip(doc.tolist(), number.tolist(), ends, strict=True)):
            data = text[end - int(size[row]) : end]
            doc_id = doc_id if known[row] else None
            begin, stop = covered.of(doc_id, own)
            edges = [0, *np.stack([begin, stop], axis=1).reshape(-1).tolist(), len(data)]
            kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            yield doc_id, len(data), int((stop - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, covered = None, [], _Covered([])
        for batch in batches:
            for own, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != current:
                    current, blobs, covered = own, [], None
                if kind == 0:
                    blobs.append(blob.as_py())
                    continue
                if covered is None:
                    covered, blobs = _Covered(blobs), []
                rows = left(blob.as_py(), covered)
                while some := list(itertools.islice(rows, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(zip(*some, strict=True), kinds, names, strict=False)], names=names)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, number, text``: the number tells rows apart that repeat a doc_id."""
    rows = docs.select("doc_id", "text")
    repeated = stage(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")), "substring-repeated")
    if repeated.isEmpty():
        return rows.select("doc_id", F.lit(0).alias("number"), "text")
    number = F.when(F.col("__id").isNotNull(), F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1))).otherwise(F.lit(0))
    return rows.join(repeated, F.col("doc_id") == F.col("__id"), "left").select("doc_id", number.cast("int").alias("number"), "text")


def _frequent_anchors(rows: DataFrame, total: int, length: int, gram: int, most: int) -> np.ndarray:
    """Anchors with more than ``most`` pieces, as a sample tells; there are at most pieces / most of them."""
    share = min(1.0, max(SAMPLE_BYTES / max(total, 1), SAMPLE_SHARE))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("anchors"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    counted = drawn.mapInArrow(_anchors(length, gram), "value long, count long").groupBy("value").agg(F.sum("count").alias("count"))
    return np.array(sorted(r["value"] for r in counted.where(F.col("count") > most * share).collect()), dtype=np.uint32)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, heavy_pieces: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``: the bytes left).

    ``heavy_pieces``: an anchor with more pieces has its windows dealt one by one (default: a sixteenth of a shard).
    """
    rows = _numbered(docs)
    spark = docs.sparkSession
    small_batches(spark)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = spark.sparkContext.defaultParallelism
    shards, ranges = (int(max(least, -(-total // size))) for size in (SHARD_BYTES, RANGE_BYTES))
    indexed = rows.where("doc_id IS NOT NULL")
    if heavy_pieces is None:
        heavy_pieces = SHARD_BYTES // (8 * (length - gram + 2))
    heavy = _frequent_anchors(indexed, total, length, gram, heavy_pieces)
    dealt = indexed.mapInArrow(_dealt(shards, ranges, heavy, length, gram), "shard int, blob binary")
    met = dealt.repartitionById(shards, F.pmod("shard", F.lit(shards))).sortWithinPartitions("shard")
    runs = stage(met.mapInArrow(_scan(shards, ranges, length, gram), "range int, blob binary"), "substring-runs")
    texts = rows.mapInArrow(_packed_texts(ranges), "range int, kind int, blob binary")
    both = runs.select("range", F.lit(0).alias("kind"), "blob").unionByName(texts)
    ordered = both.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "kind")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return ordered.mapInArrow(_cut(keep_text), schema)
