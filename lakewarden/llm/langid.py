"""Language identification with a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams (here runs
of one to four bytes of the lower-cased UTF-8 text, hashed into ``BUCKETS``) that occur in both, divided by
the geometric mean of the numbers in each. (Two n-grams may share a bucket, so the kernel is that of buckets: exact for
ordinary texts but for a few per cent of their n-grams, coarser the more of the buckets a very long text fills.) Nyström landmarks, a few sampled texts, make it a finite feature
space, in which one-versus-rest kernel ridge regression is a small linear system. A prediction is
``presence(x) . landmarks' . K^(-1/2) . weights / sqrt(|x|)``; as the product is associative, everything to
the right of ``presence(x)`` is one matrix and whole blocks of texts are scored by one matrix product each.

The fit uses a bounded sample, up to ``PER_LANGUAGE`` texts of every language and fewer where ``LABELLED`` texts are
not enough for that, but at least one, taken by a hash of the id; counts are over all rows. No language is left out;
the weights and the landmarks' presences take 256 KiB a language each. What the driver gathers of a sampled text are
the bits of its buckets, 8 KiB whatever its length: about 1.5 times ``LABELLED`` of them, as the draw takes half as many again
before it is trimmed (147 MB), and one for each language. Every text is predicted, whole.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing can
be learned; rows with a null lang or text are not learned from; a null doc_id hashes as an empty text; rows
that repeat an id or a text are predicted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.scratch import small_batches
from lakewarden.llm.textkernels import pieces

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 300
LABELLED = 12_000
LANDMARKS = 256
RIDGE = 1e-3
#: Texts in a matrix product.
BLOCK = 128
UNKNOWN = "und"

_letter = re.compile(r"[^\W\d_]")  # letters, and numbers such as a half or a superscript two
_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += np.uint64(32)
_seeds = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def presence(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows: the first row and a 0/1 matrix, a row for each text and a column for each bucket."""
    for row, data, offsets in pieces(column):
        codes, hashed = np.zeros(len(data), dtype=np.uint64), []
        wide = _lower[data]
        for n in GRAMS:
            codes = codes[: max(0, len(data) - n + 1)] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
            hashed.append(((codes + np.uint64(n)) * _seeds[n - 1] >> np.uint64(48)).astype(np.int64))
        for first in range(0, len(offsets) - 1, BLOCK):
            last = min(first + BLOCK, len(offsets) - 1)
            matrix = np.zeros((last - first, BUCKETS), dtype=np.uint8)
            for k in range(first, last):
                for n, of in zip(GRAMS, hashed, strict=True):
                    matrix[k - first, of[offsets[k] : max(offsets[k], offsets[k + 1] - n + 1)]] = 1
            yield row + first, matrix


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode's categories L)."""
    return any(m[0].isalpha() for m in _letter.finditer(text))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """Regression values, a row for each text and a column for each language."""
        size = np.maximum(matrix.sum(axis=1, dtype=np.int64), 1)
        return (matrix.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None]


def _unit_rows(sets: list[np.ndarray]) -> np.ndarray:
    """Presences, as bits, to rows of unit length."""
    rows = np.unpackbits(np.stack(sets), axis=1).astype(np.float32)
    return rows / np.sqrt(rows.sum(axis=1, keepdims=True))


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """``sets``: the bits of each text's buckets. Nyström features from evenly spaced texts of each language, then one ridge system for all languages."""
    languages = sorted(set(labels))
    kept = [(s, x) for s, x in zip(sets, labels, strict=True) if s.any()]
    if not kept:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32))
    each = max(1, landmarks // len(languages))
    owned: dict[str, list[int]] = {language: [] for language in languages}
    for k, (_, x) in enumerate(kept):
        owned[x].append(k)
    chosen: list[int] = []
    for own in owned.values():
        chosen += [own[i] for i in np.unique(np.linspace(0, len(own) - 1, min(each, len(own))).astype(int))] if own else []
    marks = _unit_rows([kept[k][0] for k in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    blocks = [_unit_rows([own for own, _ in kept[k : k + BLOCK]]) @ marks.T for k in range(0, len(kept), BLOCK)]
    features = np.concatenate(blocks).astype(np.float64) @ root
    targets = np.stack([features[own].sum(axis=0) for own in owned.values()], axis=1)
    solved = np.linalg.solve(features.T @ features + ridge * len(kept) * np.eye(features.shape[1]), targets)
    return LanguageModel(languages, (marks.T.astype(np.float64) @ (root @ solved)).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [own.tobytes() for _, matrix in presence(batch.column(2)) for own in np.packbits(matrix, axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["lang", "place", "bits"])


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, labelled: int = LABELLED, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on a bounded sample of the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ticket = F.xxhash64(F.lit("langid"), "doc_id", "text")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(ticket).alias("least")).collect()
    if not counts:
        return fit([], [])
    per_language = min(per_language, max(1, labelled // len(counts)))
    rates = [(r["lang"], min(1.0, 1.5 * per_language / r["count"]), r["least"]) for r in counts]
    drawn = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double, least long"))
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = usable.select("lang", place.alias("place"), ticket.alias("ticket"), "text").join(drawn, "lang")
    # The row with the least ticket is there for a language of which the draw takes none.
    sample = placed.where("place < rate OR ticket = least").select("lang", "place", "text")
    rows = sample.mapInArrow(_sets, "lang string, place double, bits binary").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    taken: dict[str, int] = {}
    sets, labels = [], []
    for language, bits in zip(rows.column("lang").to_pylist(), rows.column("bits"), strict=True):
        taken[language] = taken.get(language, 0) + 1
        if taken[language] <= per_language:
            sets.append(np.frombuffer(bits.as_py(), dtype=np.uint8))
            labels.append(language)
    return fit(sets, labels, landmarks)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            known = np.array([has_letter(text.as_py() or "") for text in batch.column(2)], dtype=bool)
            best, score = np.full(len(known), len(names) - 1), np.zeros(len(known))
            if own.languages:
                for first, matrix in presence(batch.column(2)):
                    values = own.scores(matrix)
                    rows = slice(first, first + len(matrix))
                    best[rows], score[rows] = values.argmax(axis=1), np.clip(values.max(axis=1), 0, 1)
                best, score = np.where(known, best, len(names) - 1), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and predict all."""
    small_batches(docs.sparkSession)
    return predict(docs, train(docs, ~held_out(F.col("doc_id"))))
