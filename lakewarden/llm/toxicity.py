"""Toxicity by a classifier chain.

The categories (0/1 label columns) are predicted in order. Each has a logistic regression over the presence
of words, a few shape features of the text and the probabilities of the categories before it. What a later
model sees of the earlier ones in training are out-of-fold predictions, so it learns how far to trust them;
in prediction the chain is walked with the final models.

Words are runs of letters and digits, lower-cased (A-Z), known by 64-bit hashes, so no two share a feature.
A model's words are those whose association with its label in the training fold is beyond chance (a G test
at ``SIGNIFICANCE`` with a correction for the number of words); selection is inside each fold.

The fit uses some ``LABELLED`` labelled documents: a draw by a hash of the id, so the number is within a few hundred
(five standard deviations) of it, and one text of each id. That bound also bounds the broadcast that picks their texts.
One task gathers the distinct words' hashes of these texts, no text, and fits in order of the ids' hashes; the
driver gets the models only. Every document is scored, whole.

Defined cases: a null or empty text has no words and is judged by the rest of the model, which gives about
the base rate of empty texts; labels that are null are left out; rows that repeat a doc_id in the labels
count as positive if any is; of documents that repeat one, the text with the least hash is learned from; a category with fewer than ``LEAST`` positives or negatives has a constant
probability; without labels every probability is 0; a null doc_id is scored too; an empty table gives an
empty result; columns of ``docs`` other than doc_id and text pass through :func:`keep_clean` untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.scratch import small_batches
from lakewarden.llm.textkernels import NON_LETTERS, pieces, prefix_sums, range_hash, word_spans

#: Default chain: whether a text is of good quality is known to the model of toxicity.
CATEGORIES = ("quality", "toxic")
LABELLED = 12_000
FOLDS = 5
WORDS = 256
SIGNIFICANCE = 1e-3
LEAST = 5
THRESHOLD = 0.5
SHAPES = 5
#: Words that a fit handles at a time, besides those of the longest text.
RUN = 1 << 18


def features(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Runs of rows: the first row, each text's sorted distinct word hashes, and the shape features."""
    for row, data, offsets in pieces(column):
        start, end, first = word_spans(data, offsets, NON_LETTERS)
        hashes = range_hash(prefix_sums(data, fold_case=True), start, end)
        words = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        count, size = np.diff(first), np.diff(offsets)
        running = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
        digits = running[offsets[1:]] - running[offsets[:-1]]
        distinct = np.array([len(own) for own in words])
        letters = np.concatenate([[0], np.cumsum(end - start)])
        in_words = letters[first[1:]] - letters[first[:-1]]
        shape = np.stack(
            [
                np.log1p(count),
                distinct / np.maximum(count, 1),
                np.log1p(in_words / np.maximum(count, 1)),
                in_words / np.maximum(size, 1),
                digits / np.maximum(size, 1),
            ],
            axis=1,
        )
        yield row, words, shape


def _g_test(present: np.ndarray, positive: np.ndarray, n: int, n_positive: int) -> np.ndarray:
    """The G statistic of each word's two-by-two table."""
    cells = [(positive, n_positive), (present - positive, n - n_positive)]
    total = np.zeros(len(present))
    for held, side in cells:
        for observed, share in ((held, present), (side - held, n - present)):
            expected = share * (side / n)
            with np.errstate(divide="ignore", invalid="ignore"):
                total += np.where(observed > 0, observed * np.log(observed / expected), 0.0)
    return 2 * total


def _runs(words: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of texts of some ``RUN`` words: the words' hashes, and the row of each."""
    begin, held = 0, 0
    for end, own in enumerate(words, 1):
        held += len(own)
        if held >= RUN or end == len(words):
            yield np.concatenate(words[begin:end]), np.repeat(np.arange(begin, end), [len(x) for x in words[begin:end]])
            begin, held = end, 0


def _distinct(words: Sequence[np.ndarray]) -> np.ndarray:
    """The sorted distinct hashes, by merging those of runs, so that no copy of all words is made."""
    levels: list[np.ndarray] = [np.empty(0, dtype=np.uint64)]
    for flat, _ in _runs(words):
        levels.append(np.unique(flat))
        while len(levels) > 1 and len(levels[-2]) <= 2 * len(levels[-1]):
            last = levels.pop()
            levels[-1] = np.union1d(levels[-1], last)
    return np.unique(np.concatenate(levels))


@dataclass
class LogisticModel:
    """Weights over chosen words (sorted hashes), the dense columns and an intercept."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    constant: float | None = None

    def _matrix(self, words: Sequence[np.ndarray], dense: np.ndarray) -> np.ndarray:
        x = np.zeros((len(words), len(self.words) + dense.shape[1] + 1))
        for flat, owner in _runs(words) if len(self.words) else ():
            place = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            hit = self.words[place] == flat
            x[owner[hit], place[hit]] = 1
        # Texts far longer than those trained on must not be judged by their length.
        shape = np.clip((dense - self.centre) / self.scale, -3, 3)
        shape[[len(own) == 0 for own in words], :SHAPES] = 0
        x[:, len(self.words) : -1] = shape
        x[:, -1] = 1
        return x

    def probability(self, words: Sequence[np.ndarray], dense: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._matrix(words, dense) @ self.weights, -40, 40)))


def fit_logistic(words: list[np.ndarray], dense: np.ndarray, label: np.ndarray, most: int = WORDS, penalty: float = 0.02, shape_penalty: float = 20.0) -> LogisticModel:
    """Select words, then Newton's method with halved steps on the penalised likelihood, which is convex."""
    n, n_positive = len(label), int(label.sum())
    if min(n_positive, n - n_positive) < LEAST:
        return LogisticModel(constant=n_positive / n if n else 0.0)
    known = _distinct(words)
    present, positive = np.zeros(len(known)), np.zeros(len(known))
    for flat, owner in _runs(words):
        index = np.searchsorted(known, flat)
        present += np.bincount(index, minlength=len(known))
        positive += np.bincount(index[label[owner] == 1], minlength=len(known))
    g = _g_test(present, positive, n, n_positive)
    # For one degree of freedom P(G > x) is below exp(-x / 2), so this bound is on the safe side.
    bar = 2 * np.log(max(len(known), 1) / SIGNIFICANCE)
    best = np.flatnonzero(g >= bar)
    best = best[np.lexsort((known[best], -g[best]))][:most]
    model = LogisticModel(np.sort(known[best]), centre=dense.mean(axis=0), scale=np.maximum(dense.std(axis=0), 1e-6))
    x = model._matrix(words, dense)
    ridge = np.full(x.shape[1], penalty)
    ridge[len(model.words) : len(model.words) + SHAPES] = shape_penalty
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    beta[-1] = np.log(n_positive / (n - n_positive))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(np.logaddexp(0, z) - label * z) + (ridge * b * b).sum() / 2)

    now = loss(beta)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (label - p) - ridge * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        while (then := loss(beta + step)) > now and np.abs(step).max() > 1e-9:  # Newton's step may overshoot
            step = step / 2
        if then > now:
            break
        beta = beta + step
        if now - then < 1e-9 * max(now, 1.0):
            break
        now = then
    model.weights = beta
    return model


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[LogisticModel]

    def probabilities(self, words: Sequence[np.ndarray], shape: np.ndarray) -> np.ndarray:
        seen = shape
        for model in self.models:
            seen = np.concatenate([seen, model.probability(words, seen)[:, None]], axis=1)
        return seen[:, shape.shape[1] :]


def fit_chain(words: list[np.ndarray], shape: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: Sequence[str]) -> Chain:
    """``labels``: a column for each category, NaN where it isn't known; ``fold``: a number for each row."""
    seen, models = shape, []
    for column in range(labels.shape[1]):
        label = labels[:, column]
        known = ~np.isnan(label)

        def fitted(rows: np.ndarray, label: np.ndarray = label, seen: np.ndarray = seen) -> LogisticModel:
            return fit_logistic([words[i] for i in np.flatnonzero(rows)], seen[rows], label[rows])

        out = np.zeros(len(words))
        for k in np.unique(fold):
            inside = fold == k
            out[inside] = fitted(known & ~inside).probability([words[i] for i in np.flatnonzero(inside)], seen[inside])
        models.append(fitted(known))
        seen = np.concatenate([seen, out[:, None]], axis=1)
    return Chain(tuple(categories), models)


def _training_rows(n_labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shapes = [], []
            for _, own, shape in features(batch.column(0)):
                words += [x.view(np.int64) for x in own]
                shapes += shape.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.list_(pa.int64())), pa.array(shapes, pa.list_(pa.float64())), *batch.columns[1:]],
                names=["words", "shape", "place", "fold", *(f"y{k}" for k in range(n_labels))],
            )

    return run


def _fit(categories: Sequence[str]):
    """The pickled chain of all training rows; the task that gets them holds eight bytes for each word of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rest = [], []
        for batch in batches:
            flat, begin = batch.column(0).values.to_numpy().view(np.uint64), batch.column(0).offsets.to_numpy()
            words += [flat[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
            shape = np.array(batch.column(1).to_pylist()).reshape(-1, SHAPES)
            y = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]], axis=1)
            rest.append((shape, batch.column(2).to_numpy(), batch.column(3).to_numpy(), y))
        if not words:
            return
        shape, place, fold, y = (np.concatenate(parts) for parts in zip(*rest, strict=True))
        order = np.argsort(place)
        chain = fit_chain([words[i] for i in order], shape[order], y[order], fold[order], categories)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, labelled: int = LABELLED, folds: int = FOLDS) -> Chain:
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    total = known.count()
    if not total:
        return Chain(tuple(categories), [LogisticModel(constant=0.0) for _ in categories])
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30))
    sample = known.where(place < F.lit(min(1.0, labelled / total) * float(1 << 30)))
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    others = [F.first(c).alias(c) for c in categories]
    picked = drawn.groupBy("doc_id").agg(F.min_by(F.struct("text"), F.coalesce(F.xxhash64("text"), F.lit(0))).alias("least"), *others).select("doc_id", "least.text", *categories)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds))
    rows = picked.select("text", F.xxhash64("doc_id").alias("place"), fold.alias("fold"), *[F.col(c).alias(f"y{k}") for k, c in enumerate(categories)])
    schema = "words array<long>, shape array<double>, place long, fold long, " + ", ".join(f"y{k} double" for k in range(len(categories)))
    table = rows.mapInArrow(_training_rows(len(categories)), schema).repartition(1)
    found = table.mapInArrow(_fit(tuple(categories)), "chain binary").collect()
    if not found:
        return Chain(tuple(categories), [LogisticModel(constant=0.0) for _ in categories])
    return pickle.loads(found[0].chain)


def _scores(shared, position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            found = [chain.probabilities(words, shape) for _, words, shape in features(batch.column(position))]
            values = np.concatenate(found) if found else np.zeros((0, len(chain.categories)))
            columns = [pa.array(values[:, k]) for k in range(len(chain.categories))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f"p_{c}" for c in chain.categories)])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` and a probability ``p_<category>`` for each category, for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)
    return docs.select("doc_id", "text").mapInArrow(_scores(shared, 1), schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, the probabilities, and ``toxic``: whether the chain's last one reaches ``threshold``."""
    scored = score(docs, train(docs, labels, categories))
    return scored.withColumn("toxic", F.col(f"p_{categories[-1]}") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below ``threshold``, with their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.probabilities(words, shape)[:, -1] for _, words, shape in features(batch.column(place))]
            clean = np.concatenate(found) < threshold if found else np.zeros(0, dtype=bool)
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
