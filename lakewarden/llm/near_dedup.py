"""MinHash near-dedup on SetSketch registers.

1. One pass over the texts gives each document its number of distinct word shingles, a 128-bit digest of the
   set and the registers. Documents with equal sets collapse to the one with the least doc_id.
2. Bands of ``ROWS`` registers are bucket keys. Only representatives that share a bucket go on; their full
   shingle sets are made once, from the texts.
3. Buckets are searched by pivots, not by all pairs. A round counts the components in each bucket. Buckets
   that lie in one component are done. In the others some members outside the largest component are pivots
   and are compared with the members of other components: first by size, then by the joint likelihood of the
   registers, then exactly on the full sets. A pivot has then met everything in its bucket and leaves it.
   Links contract components. One round settles nearly all buckets. What is left shares much but not enough,
   such as a common passage; those members get an exact second key, the prefix of rarest shingles, and go on
   in rounds with ever more pivots until every bucket is settled. No link is lost to a cap.
4. Components come from star contraction on the links.

A pair at the threshold of 0.85 shares none of the 32 bands of 6 registers with a probability of 3e-7, and a pair
at 0.8 none of 48 bands with 5e-7 (of 32 with 6e-5, so a lower threshold needs more ``bands``); the register
estimate discards only what lies ``ERRORS`` standard errors below the threshold. Sets are of 64-bit hashes of shingles. Nothing else is lossy.

What moves: registers and sets of documents that share no bucket are never shuffled, and a round moves those of the
pairs it compares only. A list of ids or keys is broadcast up to ``BROADCAST_ROWS`` rows of it, and shuffled beyond.

Defined cases: words as in the contract (runs without white space, A-Z lower-cased); a text of one to four
words is one shingle; a null or blank text has an empty set and is linked with nothing; a row with a null
doc_id is linked with nothing, has a null component and is kept; rows that repeat a doc_id are one node with
several sets; equal texts are linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.components import components
from lakewarden.llm.naming import columns, without
from lakewarden.llm.scratch import small_batches, stage
from lakewarden.llm.setsketch import similarity, sketch
from lakewarden.llm.textkernels import pieces, shingle_hashes, shingle_sets, word_hashes

BANDS = 32
ROWS = 6
ERRORS = 5
BROADCAST_ROWS = 1_000_000
#: Pivots in a bucket in the first round and in the first over rare shingles, and how many times more by round there.
PIVOTS, RARE_PIVOTS, GROWTH = 1, 16, 4
#: A class of equal sets is large from so many rows on, and there are no more large ones than this.
LARGE_ROWS, LARGE_CLASSES = 1000, 4096


def _signatures(width: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in pieces(batch.column(1)):
                shingles, begin = shingle_hashes(*word_hashes(data, offsets), width)
                rows = sketch(shingles, begin, registers)
                sets = [np.unique(shingles[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sets)),
                        pa.array([len(own) for own in sets], pa.int64()),
                        pa.array([hashlib.blake2b(own.tobytes(), digest_size=16).digest() for own in sets], pa.binary()),
                        pa.array([own.tobytes() for own in rows], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "registers"],
                )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64()))], names=["rep", "shingles"]
                )

    return run


def _likely(threshold: float):
    """Pairs whose registers don't speak against the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for k in (4, 5))
                sizes = [batch.column(k).to_numpy().astype(np.float64) for k in (2, 3)]
                margin = ERRORS * np.sqrt(threshold * (1 - threshold) / one.shape[1])
                batch = batch.filter(pa.array(similarity(one, other, *sizes) >= threshold - margin))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    return run


def _among(df: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in a written table of one column and distinct rows."""
    name = listed.columns[0]
    small = listed.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(listed) if small else listed, df[column] == listed[name], "left_semi")


class _Search:
    """The representatives' registers and sets, and the test of a table of candidate pairs."""

    def __init__(self, registers: DataFrame, sets: DataFrame, threshold: float):
        self.registers, self.sets, self.threshold = registers, sets, threshold
        self.hundredths = round(100 * threshold)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked, confirmed on full sets."""
        side = lambda df, key, **names: df.select(F.col("rep").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
        ends = lambda of: stage(of.select(F.col("a").alias("end")).unionByName(of.select(F.col("b").alias("end"))).distinct(), "near-ends")
        registers = _among(self.registers, "rep", ends(pairs))
        sketched = pairs.join(side(registers, "a", n_shingles="n_a", registers="r_a"), "a").join(side(registers, "b", n_shingles="n_b", registers="r_b"), "b")
        likely = stage(sketched.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_likely(self.threshold), "a long, b long"), "near-likely")
        sets = _among(self.sets, "rep", ends(likely))
        full = likely.join(side(sets, "a", shingles="s_a"), "a").join(side(sets, "b", shingles="s_b"), "b")
        shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        counted = full.select("a", "b", shared.alias("both"), (F.size("s_a") + F.size("s_b")).cast("long").alias("sum"))
        return counted.where(100 * F.col("both") >= self.hundredths * (F.col("sum") - F.col("both"))).select("a", "b").distinct()


def _open_rows(buckets: DataFrame, labels: DataFrame, pivots: int) -> DataFrame:
    """The rows of buckets that still hold several components and a row that may be met, with this round's pivots.

    Pivots follow one order of all representatives, not one for each bucket: members that meet in many buckets have the
    same pivots in them, so the pairs of different buckets are mostly the same pairs.
    """
    draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    seen = buckets.join(labels, "rep").withColumn("draw", draw)
    by_label = seen.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.max("met").alias("met"), F.min(F.struct("draw", "rep")).alias("first"))
    keys = by_label.groupBy("key").agg(
        F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.max("met").alias("any"), F.min("first").alias("first")
    )
    keys = keys.where("labels > 1 AND any").select("key", "first", "total")
    chosen = (F.col("rep") == F.col("first.rep")) | (F.col("draw") * F.col("total") < pivots)
    return seen.join(keys, "key").select("key", "rep", "n", "met", "place", "label", chosen.alias("pivot"))


def _round(rows: DataFrame, labels: DataFrame, search: _Search) -> DataFrame:
    """Compare pivots with what they may be linked to in their buckets, and contract the components."""
    p = rows.where("pivot").select("key", F.col("rep").alias("p"), F.col("n").alias("n_p"), F.col("label").alias("label_p"), F.col("place").alias("place_p"))
    # All that two sets share comes no earlier than the first key they share, which bounds it from above.
    most = F.least(F.col("n") - F.col("place"), F.col("n_p") - F.col("place_p")) + 1
    enough = most * (100 + search.hundredths) >= (F.col("n") + F.col("n_p")) * search.hundredths
    pairs = p.join(rows, "key").where((F.col("label") != F.col("label_p")) & enough).select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b"))
    links = stage(search.links(stage(pairs.distinct(), "near-pairs")), "near-links")
    name = lambda of, end: labels.select(F.col("rep").alias(of), F.col("label").alias(end))
    edges = links.join(name("a", "la"), "a").join(name("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = components(edges)
    return stage(labels.join(roots, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("root", "label").alias("label")), "near-labels")


def _prefix_buckets(reps: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """Buckets by rare shingle: an exact second key for the members of buckets that pivots did not settle.

    With the shingles in order of their number of sets, the smaller of two linked sets has one of its first
    ``n - ceil(2t / (1 + t) * n) + 1`` (``met``) among the larger one's first ``n - ceil(t * n) + 1``. Sets that
    agree in a common passage only share none of those, so they are not compared again.
    """
    n = F.size("shingles").cast("long")
    own = sets.join(reps, "rep", "left_semi").select("rep", n.alias("n"), F.xxhash64("shingles").alias("set"), F.explode("shingles").alias("key"))
    own = stage(own, "near-shingles")
    counted = own.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("rep", "set").orderBy("held", "key")
    ranked = own.join(counted, "key").withColumn("place", F.row_number().over(order))
    first = F.expr(f"n - (2 * {hundredths} * n + {99 + hundredths}) div {100 + hundredths} + 1")
    last = F.expr(f"n - ({hundredths} * n + 99) div 100 + 1")
    return ranked.where((F.col("place") <= last) & (F.col("held") > 1)).select("key", "rep", "n", (F.col("place") <= first).alias("met"), "place")


def _linked(buckets: DataFrame, labels: DataFrame, sets: DataFrame, search: _Search) -> DataFrame:
    """``rep, label`` once all that share a bucket (key, rep, n) are in one component or have been compared."""
    rows = stage(_open_rows(buckets.withColumns({"met": F.lit(True), "place": F.lit(1)}), labels, PIVOTS), "near-open")
    labels = _round(rows, labels, search)
    left = _open_rows(rows.where("NOT pivot").select("key", "rep", "n", "met", "place"), labels, PIVOTS)
    unsettled = stage(left.select("rep").distinct(), "near-unsettled")
    if unsettled.isEmpty():
        return labels
    buckets, pivots = stage(_prefix_buckets(unsettled, sets, search.hundredths), "near-prefixes"), RARE_PIVOTS
    while True:
        rows = stage(_open_rows(buckets, labels, pivots), "near-open")
        if rows.isEmpty():
            return labels
        labels = _round(rows, labels, search)
        buckets = rows.where("NOT pivot").select("key", "rep", "n", "met", "place")
        pivots *= GROWTH


def _large(classes: DataFrame) -> DataFrame:
    """The classes (digest, rep) that hold ``LARGE_ROWS`` rows or more and one row in ``LARGE_CLASSES``, so at most that many."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    return stage(classes.where(F.col("copies") >= max(LARGE_ROWS, -(-total // LARGE_CLASSES))).select("digest", "rep"), "near-large")


def _placed(rows: DataFrame, classes: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` with the ``rep`` of their class, and a ``salt``. Those of large classes get it by a broadcast; they and rows that
    have no class would crowd one task of the shuffled join, so they have a salt that is in no class (0 is in all). ``rows`` is a
    written table, so that a repeated task numbers its rows as before."""
    marked = rows.join(F.broadcast(large.select("digest", F.col("rep").alias("large_rep"))), "digest", "left")
    apart = F.col("large_rep").isNotNull() | F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    salt = F.when(apart, 1 + F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int")).otherwise(F.lit(0))
    found = marked.withColumn("salt", salt).join(classes.select("digest", "salt", "rep"), ["digest", "salt"], "left")
    return found.select("doc_id", "n_shingles", "digest", F.coalesce("large_rep", "rep").alias("rep"), "salt")


def _ties(spare: DataFrame, classes: DataFrame, hint) -> DataFrame:
    """Links (a, b) from the classes of a document with several sets (rows that repeat its doc_id) to the document."""
    ids = spare.select(F.col("doc_id").alias("end"))
    own = classes.join(hint(ids), F.col("rep") == F.col("end"), "left_semi").select(F.col("rep").alias("doc_id"), "rep")
    several = spare.unionByName(own).groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("doc_id")
    return stage(spare.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "near-ties")


def _with_ties(labels: DataFrame, ties: DataFrame) -> DataFrame:
    """``rep, label`` with the components of ``ties`` contracted."""
    if ties.isEmpty():
        return labels
    name = lambda of, end: labels.select(F.col("rep").alias(of), F.col("label").alias(end))
    named = ties.join(name("a", "la"), "a", "left").join(name("b", "lb"), "b", "left")
    roots = components(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    ends = ties.select(F.col("a").alias("rep")).unionByName(ties.select(F.col("b").alias("rep"))).distinct().join(labels, "rep", "left_anti")
    known = labels.unionByName(ends.select("rep", F.col("rep").alias("label")))
    return stage(known.join(roots, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("root", "label").alias("label")), "near-labels")


def near_duplicates(docs: DataFrame, threshold: float = 0.85, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_shingles long, digest binary, registers binary"
    signed = stage(docs.mapInArrow(_signatures(width, bands * rows), schema), "near-signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # The salt is a column of the table, not a literal, so that it stays a key of the joins below.
    grouped = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stage(grouped.withColumn("salt", F.lit(0)), "near-classes")
    large = _large(classes)
    placed = stage(_placed(signed.select("doc_id", "n_shingles", "digest"), classes, large), "near-placed")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    spare = stage(placed.where(linked & (F.col("doc_id") > F.col("rep"))).select("digest", "doc_id", "rep").distinct(), "near-spare")
    hint = F.broadcast if spare.count() <= BROADCAST_ROWS // 4 else lambda df: df
    registers = usable.join(hint(spare.select("digest", "doc_id")), ["digest", "doc_id"], "left_anti")
    registers = registers.select(F.col("doc_id").alias("rep"), "n_shingles", "registers")
    key = F.expr(f"explode(transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(registers, i * {2 * rows} + 1, {2 * rows}))))")
    keyed = registers.select(key.alias("key"), "rep", F.col("n_shingles").alias("n"))
    shared = stage(keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key"), "near-keys")
    buckets = stage(_among(keyed, "key", shared).distinct(), "near-buckets")
    active = stage(buckets.select("rep").distinct(), "near-active")
    texts = _among(docs, "doc_id", active)
    registers = stage(_among(registers, "rep", active).distinct(), "near-registers")
    sets = stage(texts.mapInArrow(_full_sets(width), "rep long, shingles array<long>"), "near-sets")
    labels = _linked(buckets, active.select("rep", F.col("rep").alias("label")), sets, _Search(registers, sets, threshold))
    labels = _with_ties(labels, _ties(spare.select("doc_id", "rep"), classes.select("rep"), hint))
    shown = F.broadcast(labels.join(F.broadcast(large.select("rep")), "rep", "left_semi").select("rep", F.col("label").alias("large_label")))
    rest = stage(labels.withColumn("salt", F.lit(0)), "near-rest")
    placed = placed.join(shown, "rep", "left").join(rest, ["rep", "salt"], "left").withColumn("label", F.coalesce("large_label", "label"))
    component = F.when(linked, F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.85, width: int = 5, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs`` but for all documents of a component other than the one with the least doc_id.

    Of rows with words that repeat the doc_id that stays, the one whose text has the least hash stays.
    """
    found = stage(near_duplicates(docs, threshold, width, bands).where("n_shingles > 0 AND doc_id IS NOT NULL"), "near-found")
    dropped = stage(found.where("NOT kept").select("doc_id").distinct(), "near-dropped")
    staying = without(docs, F.broadcast(dropped) if dropped.count() <= 2 * BROADCAST_ROWS else dropped, "doc_id")
    repeated = stage(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-repeated")
    if repeated.isEmpty():
        return staying
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    several = without(staying.where(worded), repeated, "doc_id", "left_semi")
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*columns(docs)), F.xxhash64("text")).alias("one_row")).select("one_row.*")
    others = staying.where(~worded).unionByName(without(staying.where(worded), repeated, "doc_id"))
    return others.unionByName(one.select(*columns(docs)))
