"""Rows that keep arriving in a folder, through contract and rules by micro-batch.

The batch engine runs in ``foreachBatch``. Batches are written under their number, so one that is run again after a
failure overwrites what it wrote before and nothing is doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lakewarden.operators.index import add_record_index
from lakewarden.plans.engine import Engine
from lakewarden.sources.sinks import drop_record_index, write_parquet


def ingest(engine: Engine, entity: str, source: str, target: str, checkpoint: str, *, format: str = "parquet", available_now: bool = False, **options: str) -> StreamingQuery:
    """Start a query that validates each micro-batch of ``entity`` and writes survivors and messages below ``target``."""
    stream = engine.spark.readStream.schema(engine.raw_schema(entity)).options(**options).format(format).load(source)

    def one(batch: DataFrame, number: int) -> None:
        staged = write_parquet(batch, f"{target}/raw/batch={number}")
        outcome = engine.run({entity: add_record_index(staged)}, reject=True)
        for name, frame in outcome.catalog.items():
            write_parquet(drop_record_index(frame), f"{target}/entities/{name}/batch={number}")
        write_parquet(outcome.messages, f"{target}/messages/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
