"""Exact dedup with a heavy-hitter split.

One pass over the texts leaves a narrow table (id, length, SHA-256 of the text without white space).
Misra-Gries summaries of its partitions, added up, name the digests that may be frequent; their exact
winners and counts are then aggregated (with map-side partial aggregation) and broadcast, so that the
rows of large groups of copies are settled on the map side. The remaining digests use an ordinary shuffle. An
estimate falls short by at most ``rows / (counters + 1)`` and a digest is chosen from ``rows / (2*counters)`` on, so none
of the remaining ones holds more than a ``1.5 / counters`` share of the rows.

The bound of the broadcast: candidates have estimates of at least ``rows / (2*counters)`` and estimates
add up to at most ``rows``, so there are at most ``2*counters`` of them, whatever the data.

Defined cases: a null text counts as empty, and empty texts (or white space only) are copies of each
other; of equal texts the row with the most code points, then the smallest doc_id stays; rows that repeat
that row exactly (same doc_id, same length) all carry ``kept``; a null doc_id loses against any id and
is kept only where the whole group has none; other columns of the input are ignored, or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.naming import columns, unused
from lakewarden.llm.scratch import stage

#: Counters in each Misra-Gries summary.
COUNTERS = 1024
BLANK = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, length, digest``: the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.char_length(text).cast("long").alias("length"),
        F.unhex(F.sha2(F.regexp_replace(text, BLANK, "").cast("binary"), 256)).alias("digest"),
    )


class MisraGries:
    """At most ``counters`` counters; an estimate is too low by at most ``rows / (counters + 1)``."""

    def __init__(self, counters: int):
        self.counters = counters
        self.counts: dict = {}

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge a batch that is already counted: add up, then subtract the (counters+1)-th largest count."""
        for key, count in zip(keys.tolist(), counts.tolist(), strict=True):
            self.counts[key] = self.counts.get(key, 0) + count
        if len(self.counts) > self.counters:
            values = np.fromiter(self.counts.values(), dtype=np.int64, count=len(self.counts))
            cut = int(np.partition(values, len(values) - self.counters - 1)[len(values) - self.counters - 1])
            self.counts = {k: v - cut for k, v in self.counts.items() if v > cut}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(counters)
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by("digest").aggregate([("digest", "count")])
            summary.add(table.column("digest").to_numpy(), table.column("digest_count").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(summary.counts), pa.binary()), pa.array(list(summary.counts.values()), pa.int64())],
            names=["digest", "estimate"],
        )

    return run


def frequent(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``2*counters`` digests: every one with more than ``1.5 * rows / counters + 1`` rows is among them."""
    total = rows.count()
    partial = rows.select("digest").mapInArrow(_summaries(counters), "digest binary, estimate long")
    merged = partial.groupBy("digest").agg(F.sum("estimate").alias("estimate"))
    return merged.where(F.col("estimate") >= max(2, total // (2 * counters) + 1)).select("digest")


def keepers(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(digests(docs), "exact-digests")
    best = F.max(F.struct("length", F.bitwise_not("id").alias("order")))  # its order is the ids' reversed, nulls last
    winners = lambda of: of.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    heavy = stage(frequent(rows, counters), "exact-frequent")
    hot = stage(winners(rows.join(F.broadcast(heavy), "digest", "left_semi")), "exact-winners")
    settled = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    decided = settled.unionByName(rest.join(winners(rest), "digest"))
    keep_id = F.bitwise_not("best.order")
    same_id = F.col("id").eqNullSafe(keep_id)
    return decided.select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        "group_size",
        (same_id & (F.col("length") == F.col("best.length"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; rows without an id stay only if they are kept."""
    keep_id, sha, own = unused(docs.columns, "keep_id", "keep_sha", "own_sha")
    kept = keepers(docs, counters).where("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(sha)).distinct()
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANK, "")
    marked = docs.withColumn(own, F.sha2(text.cast("binary"), 256))
    on = F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(sha))
    return marked.join(kept, on, "left_semi").select(*columns(docs))
