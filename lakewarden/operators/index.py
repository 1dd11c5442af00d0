"""The dense 1-based record index, without a shuffle: offsets of files plus each row's place in its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.operators.catalog import RECORD_INDEX
from lakewarden.sources.files import scratch


def add_record_index(frame: DataFrame) -> DataFrame:
    """Number the rows of a Parquet table by file name and place; a frame that has the index is left alone.

    Spark tells each row's place in its file, and counting the rows of a file takes its footer only, so no job is run here and a
    task that runs again numbers its rows alike. Any other frame, such as the output of a shuffle, is written to the shared
    scratch folder first, since running its plan again may deal its rows anew.
    """
    if RECORD_INDEX in frame.columns:
        return frame
    if not _is_table(frame):
        path = f"{scratch(frame.sparkSession, 'indexed')}/rows"
        frame.write.parquet(path)
        frame = frame.sparkSession.read.schema(frame.schema).parquet(path)
    file, place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place")
    counts = frame.select(file).groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file.
    offsets = counts.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    numbered = frame.select("*", file, place).join(F.broadcast(offsets), "__file")
    return numbered.select(*[F.col(f"`{c}`") for c in frame.columns], (F.col("__before") + F.col("__place") + 1).cast("long").alias(RECORD_INDEX))


def _is_table(frame: DataFrame) -> bool:
    """Whether a frame is a Parquet table or a projection of one, so that rows are those of its files."""
    plan = frame._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "row_index" in frame.select("_metadata").schema[0].dataType.names


def drop_record_index(frame: DataFrame) -> DataFrame:
    return frame.drop(RECORD_INDEX)
