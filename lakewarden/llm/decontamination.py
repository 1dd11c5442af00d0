"""Benchmark decontamination by size-partitioned MinHash containment search, on DataFrame functions only.

Documents are as long as they like and items are short, so the Jaccard similarity of the two says nothing
and the search is for containment |item & document| / |item|. Items are partitioned by the power of two
that bounds their number of shingles. In each partition an item's signature is its ``k`` smallest shingle
hashes (bottom-k MinHash), with ``k = floor((1 - threshold) * bound) + 1`` from the partition's size bound:
a document that lacks at most that share of the shingles must hold one of them, so no match is lost. Shingles
that more than ``COMMON`` items have come last in that order, so a phrase that all items share makes no candidates.

The signatures' hashes also set bits in a bitmap of ``1 << BITMAP`` bits that is part of the plan: a document's
shingles are tested against it inside the array, and only those that pass become rows. A pair is a candidate if the
document has enough shingles for the item's partition. Candidate pairs, and no others, are verified by exact
containment over the whole text: the shingles of a pair's item meet those of its document by document and hash, so
neither a long document nor a common shingle is one task's work. Shingles are compared by 64-bit hashes.

A signature table of up to ``BROADCAST_ROWS`` rows is broadcast; a larger one is joined by shuffle.

Defined cases: words are runs of characters other than white space, lower-cased; a text of one to four
words has its whole sequence as the only shingle; an item of that length is found inside any document, whose
runs of as many words are probed too; null or blank texts have none and match nothing; items or documents without an
id are never reported; rows that repeat an id are one item or document whose shingles are united; empty tables give an
empty result; other columns are ignored, or passed through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.naming import without
from lakewarden.llm.scratch import stage

BROADCAST_ROWS = 500_000
COMMON = 16
#: Bits of the bitmap of signatures, as a power of two; its words are one constant array of the plan.
BITMAP = 21
BLANK = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BLANK), "")


def _short(words: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", words), F.lit("short"))


def shingled(df: DataFrame, id_col: str, width: int = 5, lengths: Sequence[int] = ()) -> DataFrame:
    """``id, shingles``: hashes of every run of ``width`` words, in order and with repeats, and of runs of ``lengths``."""
    words = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _words(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0)
    runs = F.transform(
        F.sequence(F.lit(0), F.size("words") - width),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(width)]),
    )
    shingles = F.when(F.size("words") >= width, runs).otherwise(F.array(_short(F.col("words"))))
    for n in lengths:
        starts = F.sequence(F.lit(1), F.size("words") - n + 1)
        short = F.transform(starts, lambda i: _short(F.slice("words", i, n)))  # noqa: B023
        shingles = F.concat(shingles, F.when(F.size("words") >= n, short).otherwise(F.array().cast("array<bigint>")))
    return words.select("id", shingles.alias("shingles"))


def _short_lengths(items: DataFrame, width: int) -> list[int]:
    """The distinct numbers of words of the items that are shorter than a shingle."""
    sizes = items.where(F.col("item_id").isNotNull()).select(F.size(_words(F.col("text"))).alias("n"))
    return sorted(r["n"] for r in sizes.where((F.col("n") > 0) & (F.col("n") < width)).distinct().collect())


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _item_sets(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """``item_id, shingles, n_item_shingles, size_bound, k``; shingles in the order that signatures are taken from."""
    rows = shingled(items, "item_id", width).select(F.col("id").alias("item_id"), F.explode("shingles").alias("h")).distinct()
    held = rows.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    ranked = rows.join(held, "h").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct((F.col("held") > COMMON).alias("common"), "h"))).alias("ranked"))
    return (
        ranked.select("item_id", F.col("ranked.h").alias("shingles"), F.size("ranked").cast("long").alias("n_item_shingles"))
        .withColumn("size_bound", F.pow(F.lit(2.0), F.ceil(F.log2("n_item_shingles"))).cast("long"))
        .withColumn("k", (F.floor((1 - F.lit(threshold)) * F.col("size_bound")) + 1).cast("int"))
    )


def _bit(h: Column) -> tuple[Column, Column]:
    """The word (from 0) and the bit in it that a hash sets in the bitmap."""
    place = F.shiftrightunsigned(h, 64 - BITMAP)
    return F.shiftright(place, 6).cast("int"), (place.bitwiseAND(F.lit(63))).cast("int")


def _bitmap(signatures: DataFrame) -> Column:
    """The bitmap as a constant array of ``1 << (BITMAP - 6)`` words, whatever the number of signatures."""
    word, bit = _bit(F.col("h"))
    bits = signatures.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("value"))
    words = ["0"] * (1 << (BITMAP - 6))
    for row in bits.groupBy("word").agg(F.bit_or("value").alias("value")).collect():
        words[row["word"]] = str(row["value"])
    return F.split(F.lit(",".join(words)), ",").cast("array<bigint>")


def _passes(bitmap: Column, h: Column) -> Column:
    word, bit = _bit(h)
    return F.getbit(F.get(bitmap, word), bit) == 1


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """Pairs ``doc_id, item_id, n_item_shingles, n_shared, containment`` with containment >= threshold."""
    lengths = _short_lengths(items, width)
    item_sets = stage(_item_sets(items, threshold, width), "contain-items")
    signatures = stage(item_sets.select("item_id", "size_bound", F.explode(F.slice("shingles", F.lit(1), F.col("k"))).alias("h")), "contain-signatures")
    bitmap = _bitmap(signatures)
    probes = shingled(docs, "doc_id", width, lengths).select(
        "id", F.size("shingles").alias("n"), F.explode(F.filter("shingles", lambda h: _passes(bitmap, h))).alias("h")
    )
    # All items of a partition have more than half its bound, and rows that repeat an id unite, so only they are exempt.
    hits = probes.join(_sized(signatures, signatures.count()), "h").groupBy("id", "item_id", "size_bound").agg(F.sum("n").alias("n"))
    candidates = stage(hits.where(F.col("n") >= F.lit(threshold) * F.col("size_bound") / 2).select(F.col("id").alias("doc_id"), "item_id"), "contain-candidates")
    return _verified(docs, item_sets, candidates, threshold, width, lengths)


def _verified(docs: DataFrame, item_sets: DataFrame, candidates: DataFrame, threshold: float, width: int, lengths: Sequence[int]) -> DataFrame:
    """Exact containment of each candidate pair, over the documents that are in one."""
    suspects = stage(candidates.select("doc_id").distinct(), "contain-suspects")
    chosen = docs.select("doc_id", "text").join(_sized(suspects, suspects.count()), "doc_id", "left_semi")
    held = shingled(chosen, "doc_id", width, lengths).select(F.col("id").alias("doc_id"), F.explode(F.array_distinct("shingles")).alias("h"))
    wanted = stage(candidates.join(item_sets, "item_id").select("doc_id", "item_id", "n_item_shingles", F.explode("shingles").alias("h")), "contain-wanted")
    shared = (
        held.join(_sized(wanted, wanted.count()), ["doc_id", "h"])
        .groupBy("doc_id", "item_id", "n_item_shingles")
        .agg(F.count_distinct("h").alias("n_shared"))
    )
    containment = F.col("n_shared") / F.col("n_item_shingles")
    return (
        shared.withColumn("containment", containment)
        .where(F.col("containment") >= threshold)
        .select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` without the documents that contain an item; documents without an id stay."""
    hits = find_contained(docs, items, threshold, width).select("doc_id").distinct()
    return without(docs, stage(hits, "contain-hits"), "doc_id")
