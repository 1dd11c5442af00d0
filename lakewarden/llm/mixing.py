"""Mixing sources to target weights.

The tokens of each source are aggregated (map-side partial sums, so a hot source is no problem), every
source gets a target by weight and with that a repetition rate, and each document is emitted
``floor(rate)`` times plus one Bernoulli copy whose probability is the rate's fraction. The draw hashes
the seed, the document's id and its text, so reruns and recomputed tasks agree. Only DataFrame functions are used.

Defined cases: a null text has no words; a null source is a source of its own that sorts last; rows that
repeat a doc_id draw on their own if their texts differ, and so do rows without an id; a source without words has
target 0 and is not taken; an empty table gives an empty result; further columns pass through
``mix_documents`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.naming import column, columns, unused
from lakewarden.llm.scratch import stage

#: Above so many sources, or bytes of their names, the statistics are joined by shuffle (AQE splits hot sources).
BROADCAST_SOURCES = 100_000
BROADCAST_BYTES = 16 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Sources sorted by code point (null last) take ``weights`` in turn. The sum of all sizes is shared by
    weight; a target stops at ``cap`` times its source's size and the excess is shared again by weight.
    That fixed point is a water level L with target = min(cap * size, weight * L); sorting by the level at
    which a source fills up gives L from two running sums. The table has one row per source, which is what
    bounds the two global windows here.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * cap).alias("ceiling"),
    )
    filling = everything.orderBy((F.col("ceiling") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = lambda name: F.col(name).cast("decimal(19,0)")  # noqa: E731  products may exceed 64 bits
    levels = weighed.select(
        "source",
        "source_size",
        "weight",
        "ceiling",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(onward).alias("share"),
    ).withColumn("full", wide("ceiling") * wide("share") <= wide("left") * wide("weight"))
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("share"))).over(everything)
    return levels.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(F.col("weight") * level).alias("target"),
    )


def _draw(seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed, the id and the text."""
    text = F.coalesce(F.md5("text"), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, names: Sequence[str], weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with three more columns, called ``names``: the source's size, its target, and how often the mix takes the row."""
    targets = stage(source_targets(docs, weights, cap), "mix-targets")
    source, rated, *facts = unused(docs.columns + list(names), "mix_source", "mix_rate", "mix_size", "mix_target")
    facts_of = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    targets = targets.toDF(source, *facts)
    if facts_of[0] <= BROADCAST_SOURCES and facts_of[1] <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    rate = F.coalesce(column(facts[1]) / column(facts[0]), F.lit(0.0))
    joined = docs.join(targets, F.col("source").eqNullSafe(column(source)), "left").withColumn(rated, rate)
    extra = (_draw(seed) < column(rated) - F.floor(column(rated))).cast("int")
    added = [column(facts[0]), column(facts[1]), F.floor(column(rated)).cast("int") + extra]
    return joined.select(*columns(docs), *[c.alias(name) for c, name in zip(added, names, strict=True)])


def mix_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    size, target, copies, copy = unused(docs.columns, "size", "target", "copies", "copy")
    taken = with_copies(docs, (size, target, copies), weights, cap, seed).where(column(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), column(copies)))).select(*columns(docs))


def mixing_report(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies, source."""
    size = word_count(F.col("text"))
    return with_copies(docs.select("doc_id", "text", "source"), ("source_size", "target", "copies"), weights, cap, seed).select(
        "doc_id", size.alias("size"), "source_size", "target", (size * F.col("copies")).alias("taken"), "copies", "source"
    )
