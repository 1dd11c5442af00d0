"""Hard-negative mining over inverted lists, exact.

Vectors are integers, a score is an inner product. K-means on a bounded sample gives centroids; every row goes to the list of its
nearest one, and each list keeps its radius r, the greatest distance of a member from the centroid c. By Cauchy-Schwarz
no member x of a list scores above ``q.c + |q| r`` or below ``q.c - |q| r``. An anchor visits lists in the order of their upper bounds,
passes over those that lie outside its window of scores, and stops where the bound falls strictly below the k-th
score it has (ties count, so equal bounds are visited). Visits are made in rounds of ``ROUNDS`` lists: what a round finds
raises the k-th score that the next round's lists are held against. All rows of a visited list are scored, so nothing is lost.

First each anchor's positives are searched, with no window and among rows of its label, then for all its positives at
once the negatives, each with the window of scores that the positive's score sets.

At size: a list is split by row into parts of at most some ``PART`` rows and the anchors into groups of some ``GROUP``, so a hot label, a
hot vector or a hot list is dealt over many tasks; a task scores one part against one group by matrix products. What goes to all
tasks or to the driver are the centroids, radii and sizes of at most ``MAX_LISTS`` lists, and a sample of at most
``SAMPLE`` rows. Candidates are cut to the k best by part, and again before they are shuffled.

Defined cases: a row with a null label or vector, or a null component, takes no part; nor does one of more than ``MAX_WIDTH``
components, or with components so great that products might not fit a long (``LARGEST``). Of vectors of different length the
shorter one counts as ended by zeros. A null id is never an anchor and comes last among ties; rows that repeat an id or all of a
row are rows of their own, and an anchor may have its own copy as a positive. Without rows or anchors the result is
empty; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.scratch import stage

POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: Rows that the centroids are fit on, and the components that they have in all.
SAMPLE, SAMPLE_CELLS = 16_384, 1 << 21
MAX_LISTS, LIST_ROWS = 1024, 512
#: Lists that an anchor visits in the first rounds; the last one visits all that are left.
ROUNDS = (4, 28)
#: Rows in a part of a list and anchors in a group, and the components that either has at most.
PART, GROUP, CELLS = 1024, 16_384, 1 << 20
MAX_WIDTH = 16_384
#: The sum of squares that no vector's greatest component times its length may pass: 100 times a score fits a long.
LARGEST = 1 << 55
BROADCAST_ROWS = 500_000

_FOUND = "uid bigint, slot int, found bigint, score bigint"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: by floating point where every partial sum is a whole number that it can hold."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """K-means (Lloyd's steps) from evenly spaced rows of the sample; a centroid without rows stays where it is."""
    rows = sample.astype(np.float64)
    found = rows[np.unique(np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int))]
    for _ in range(rounds):
        nearest = nearest_list(rows, found)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        sizes = np.bincount(nearest, minlength=len(found))
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def nearest_list(rows: np.ndarray, middle: np.ndarray) -> np.ndarray:
    step = max(1, (CELLS * 4) // max(1, len(middle)))
    half = (middle**2).sum(axis=1) / 2
    return np.concatenate([(rows[k : k + step] @ middle.T - half).argmax(axis=1) for k in range(0, len(rows), step)] or [np.empty(0, dtype=np.int64)])


def bounds(queries: np.ndarray, middle: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the scores in each list, with a margin for rounding: a row for each query."""
    rows = queries.astype(np.float64)
    size = np.sqrt((rows**2).sum(axis=1))[:, None]
    reach = size * radius
    margin = 1e-6 + 1e-9 * (reach + size * np.sqrt((middle**2).sum(axis=1)))
    score = rows @ middle.T
    return score - reach - margin, score + reach + margin


def wanted_lists(lower: np.ndarray, upper: np.ndarray, windows: list[dict], best: dict[int, int], seen: np.ndarray, most: int | None) -> np.ndarray:
    """Which lists one query visits next, by upper bound: some window meets the list's bounds and could still gain from it."""
    want = np.zeros(len(upper), dtype=bool)
    for w in windows:
        want |= (upper >= w["low"]) & (lower <= w["high"]) & (upper >= best.get(w["slot"], -np.inf))
    want[seen] = False
    order = np.flatnonzero(want)
    order = order[np.argsort(-upper[order], kind="stable")]
    return order if most is None else order[:most]


def best_of_part(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best scores of each query within its window, ties by the smaller id, by query and rank."""
    good = allowed & (scores >= low[:, None]) & (scores <= high[:, None])
    if scores.shape[1] > k:
        least = np.iinfo(np.int64).min
        held = np.where(good, scores, least)
        kth = np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        good &= held >= kth[:, None]
    query, row = np.nonzero(good)
    by = np.lexsort((ids[row], -scores[query, row], query))
    query, row = query[by], row[by]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], row[place < k]


def _assigner(middle: np.ndarray, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // width)
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                rows = matrix(part.column(3), width).astype(np.float64)
                nearest = nearest_list(rows, middle)
                distance = np.sqrt(((rows - middle[nearest]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest, pa.int32()), pa.array(distance)], names=[*batch.schema.names, "list", "distance"])

    return run


def _visits(shared, width: int, most: int | None) -> Callable:
    """Rows of anchors with the lists they visit next; those with none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, middle, radius = shared.value
        for batch in batches:
            step = max(1, CELLS // max(width, len(radius)))
            for k in range(0, len(batch), step):
                part = batch.slice(k, step)
                lower, upper = bounds(matrix(part.column("vector"), width), middle, radius)
                next_lists = []
                for own, (windows, best, seen) in enumerate(zip(part.column("windows").to_pylist(), part.column("best").to_pylist(), part.column("seen").to_pylist(), strict=True)):
                    known = np.searchsorted(numbers, np.array(seen, dtype=np.int64))
                    next_lists.append(numbers[wanted_lists(lower[own], upper[own], windows, dict(best or ()), known, most)].tolist())
                visit = pa.array(next_lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, visit], names=[*batch.schema.names, "visit"])

    return run


def _scorer(width: int, same: bool, k: int) -> Callable:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list] = {"uid": [], "slot": [], "found": [], "score": []}
        if len(rows) and len(anchors):
            own, label = rows.column("uid").to_numpy(), rows.column("label").to_numpy()
            named = rows.column("vec_id").combine_chunks()
            id_ = named.fill_null(np.iinfo(np.int64).max).to_numpy()
            cell = matrix(rows.column("vector"), width)
            step = max(1, CELLS // max(len(cell), width))
            for at in range(0, len(anchors), step):
                part = anchors.slice(at, step)
                uid, theirs = part.column("uid").to_numpy(), part.column("label").to_numpy()
                scores = products(matrix(part.column("vector"), width), cell)
                allowed = (theirs[:, None] == label) == same
                if same:
                    allowed &= uid[:, None] != own
                windows, best = part.column("windows").to_pylist(), part.column("best").to_pylist()
                for slot in sorted({w["slot"] for ws in windows for w in ws}):
                    # A query without this window gets one that nothing lies in.
                    ends = [next(((max(w["low"], dict(b or ()).get(slot, w["low"])), w["high"]) for w in ws if w["slot"] == slot), (1, 0)) for ws, b in zip(windows, best, strict=True)]
                    low, high = np.array(ends, dtype=np.int64).T
                    query, row = best_of_part(scores, allowed, id_, low, high, k)
                    out["uid"].append(uid[query])
                    out["slot"].append(np.full(len(query), slot, dtype=np.int32))
                    out["found"].append(row)
                    out["score"].append(scores[query, row])
            flat = {name: np.concatenate(parts) for name, parts in out.items()}
            return pa.table({**flat, "found": named.take(pa.array(flat["found"]))}).cast(_schema)
        return _schema.empty_table()

    return run


_schema = pa.schema([("uid", pa.int64()), ("slot", pa.int32()), ("found", pa.int64()), ("score", pa.int64())])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot, with their ranks from 1."""
    order = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Lists:
    """Rows dealt to the lists of their nearest centroids; see the module's docstring."""

    def __init__(self, rows: DataFrame, count: int, width: int, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS) -> None:
        """``rows``: a written table of uid, vec_id, label, vector, anchor; ``count`` of them, at most ``width`` components each."""
        spark = rows.sparkSession
        size = min(SAMPLE, max(1, SAMPLE_CELLS // width))
        ticket = F.xxhash64(F.lit("lists"), "uid")
        drawn = rows.where(F.pmod(ticket, F.lit(1 << 20)) < int(min(1.0, 1.5 * size / count) * (1 << 20)) + 1)
        sample = matrix(drawn.select(ticket.alias("ticket"), "vector").orderBy("ticket").limit(size).toArrow().column("vector"), width)
        wanted = max(1, min(max_lists, count // list_rows, len(sample) // 8))
        middle = centroids(sample, wanted) if len(sample) else np.zeros((1, width))
        schema = f"{_fields(rows)}, list int, distance double"
        self.width = width
        self.rows = stage(rows.mapInArrow(_assigner(middle, width), schema), "negatives-lists")
        totals = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.max("distance").alias("radius")).orderBy("list").toArrow()
        numbers = totals.column("list").to_numpy().astype(np.int64)
        radius = totals.column("radius").to_numpy() * (1 + 1e-9)
        self._part = min(PART, max(16, CELLS // width))
        parts = [(int(n), int(-(-size // self._part))) for n, size in zip(numbers, totals.column("size").to_pylist(), strict=True)]
        self._parts = spark.createDataFrame(parts, "list int, parts int")
        self._shared = spark.sparkContext.broadcast((numbers, middle[numbers], radius))

    def _round(self, state: DataFrame, most: int | None, salts: int, same: bool, k: int) -> tuple[DataFrame, DataFrame | None]:
        """One round of visits: the anchors with what they visited, and what was found (None if nobody visits a list)."""
        planned = stage(state.mapInArrow(_visits(self._shared, self.width, most), f"{_fields(state)}, visit array<int>"), "negatives-visits")
        salted = planned.where(F.size("visit") > 0).withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "uid"), F.lit(salts)).cast("int"))
        # The two sides of the cogroup come from one table; new names keep their columns apart.
        called = salted.select(F.col("salt").alias("group"), F.explode("visit").alias("list")).distinct()
        count = called.count()
        if not count:
            return planned, None
        called = F.broadcast(called) if count <= BROADCAST_ROWS else called
        parts = F.broadcast(self._parts)
        part = F.pmod(F.xxhash64(F.lit("part"), "uid"), F.col("parts")).cast("int")
        rows = self.rows.join(parts, "list").select("list", part.alias("part"), "uid", "vec_id", "label", "vector").join(called, "list")
        asked = salted.withColumn("list", F.explode("visit")).join(parts, "list")
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "salt", "uid", "label", "vector", "windows", "best")
        found = rows.groupBy("list", "part", "group").cogroup(asked.toDF("visited", "piece", *asked.columns[2:]).groupBy("visited", "piece", "salt")).applyInArrow(_scorer(self.width, same, k), _FOUND)
        return planned, found

    def search(self, anchors: DataFrame, count: int, same: bool, k: int, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
        """The k best rows of each of ``count`` anchors (uid, label, vector, windows) and slot: uid, slot, found, score, rank."""
        salts = -(-count // min(GROUP, max(16, CELLS * 4 // self.width)))
        state = anchors.select("uid", "label", "vector", "windows", F.expr("CAST(NULL AS map<int, bigint>)").alias("best"), F.expr("CAST(array() AS array<int>)").alias("seen"))
        held: DataFrame | None = None
        for most in (*rounds, None):
            planned, found = self._round(state, most, salts, same, k)
            if found is None:
                break
            together = found if held is None else held.select("uid", "slot", "found", "score").unionByName(found)
            held = stage(_ranked(together, k), "negatives-found")
            kth = held.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("best"))
            state = planned.withColumn("seen", F.concat("seen", "visit")).drop("visit", "best").join(kth, "uid", "left")
            state = state.select("uid", "label", "vector", "windows", "best", "seen")
        return held if held is not None else anchors.sparkSession.createDataFrame([], f"{_FOUND}, rank int")


def _fields(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT, list_rows: int = LIST_ROWS, max_lists: int = MAX_LISTS, rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vectors`` (vec_id bigint, label bigint,
    vector array<bigint>).

    The positives of a row where ``anchor`` holds are the first ``positives`` other rows of its label, by score and then id; the
    negatives of such a pair the first ``negatives`` rows of another label that score between ``low_percent`` and
    ``high_percent`` of what the positive does.
    """
    empty = vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    fits = F.expr(f"size(vector) <= {MAX_WIDTH} AND forall(vector, x -> x IS NOT NULL AND abs(x) <= int(sqrt({LARGEST}D / greatest(size(vector), 1))))")
    usable = vectors.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & fits)
    known = F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = usable.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "vector", known.alias("anchor"))
    rows = stage(rows, "negatives-rows")
    count, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vector"))).first()
    if not asked:
        return empty
    lists = Lists(rows, count, max(1, width), list_rows, max_lists)
    everything = F.expr(f"array(named_struct('slot', 0, 'low', {-(1 << 62)}L, 'high', {1 << 62}L))")
    anchors = rows.where("anchor").select("uid", "vec_id", "label", "vector")
    near = lists.search(anchors.withColumn("windows", everything), asked, True, positives, rounds)
    near = near.select("uid", F.col("rank").alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    low, high = f"CAST((positive_score * {low_percent} + 99) DIV 100 AS bigint)", f"CAST(positive_score * {high_percent} DIV 100 AS bigint)"
    windows = near.where(f"{low} <= {high}").groupBy("uid").agg(F.collect_list(F.expr(f"named_struct('slot', slot, 'low', {low}, 'high', {high})")).alias("windows"))
    far = lists.search(anchors.join(windows, "uid"), asked, False, negatives, rounds)
    pairs = far.withColumnRenamed("score", "negative_score").join(near, ["uid", "slot"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return pairs.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", "negative_score")
