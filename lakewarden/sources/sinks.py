"""Sinks: entities as Parquet, messages as JSON lines, processing errors."""

from __future__ import annotations

import json
import traceback
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators.index import drop_record_index
from lakewarden.plans.messages import messages_from
from lakewarden.sources.files import Files


def write_parquet(frame: DataFrame, path: str) -> DataFrame:
    """Overwrite, then read again, which cuts the plan between stages."""
    frame.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_entities(entities: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Engine outputs, without the record index."""
    return {name: write_parquet(drop_record_index(frame), f"{folder}/{name}") for name, frame in entities.items()}


def write_messages(messages: DataFrame, folder: str, stage: str, mode: str = "append") -> str:
    """Messages as JSON lines under ``errors/<stage>_errors.jsonl``, written by all tasks at once. ``mode="overwrite"`` is
    for a frame that holds all messages of the stage, so that a rerun doesn't double them."""
    place = f"{folder}/errors/{stage}_errors.jsonl"
    messages.write.mode(mode).option("ignoreNullFields", "false").json(place)
    return place


def write_processing_error(spark: SparkSession, folder: str, stage: str, error: BaseException) -> str:
    """A failure of the engine itself, one line in a file of its own below ``processing_errors/processing_errors.jsonl``
    (not every store can append), which Spark reads as one table."""
    place = f"{folder}/processing_errors/processing_errors.jsonl"
    row: dict[str, Any] = {"step_name": stage, "error_location": "processing", "error_level": "integrity", "error_message": str(error), "error_traceback": traceback.format_exception(error)}
    Files(spark).write_text(f"{place}/{stage}-{uuid.uuid4().hex}.json", json.dumps(row) + "\n")
    return place


def write_processing_errors(errors: DataFrame, folder: str) -> str:
    """Many failures as :func:`write_processing_error` writes one, by tasks: ``step_name``, ``error_message`` and, if it is
    there, ``error_traceback`` (an array of lines)."""
    place = f"{folder}/processing_errors/processing_errors.jsonl"
    trace = F.col("error_traceback") if "error_traceback" in errors.columns else F.array().cast("array<string>")
    rows = errors.select("step_name", F.lit("processing").alias("error_location"), F.lit("integrity").alias("error_level"), "error_message", trace.alias("error_traceback"))
    rows.write.mode("append").option("ignoreNullFields", "false").json(place)
    return place


def describe_errors(errors: DataFrame, kind: Column, text: Column, stage: Column, entity: Column | None = None) -> DataFrame:
    """What :func:`describe_error` says of one exception, for each row of a frame of them."""
    said = F.concat(F.lit("Unexpected error ("), kind, F.lit(": "), F.coalesce(text, F.lit("")), F.lit(") in "), stage)
    fixed = {"Key": "", "FailureType": "integrity", "Status": "error", "Category": "Bad file"}
    given = {"ErrorType": kind, "ErrorMessage": said, **({} if entity is None else {"Entity": entity})}
    return messages_from(errors, **{k: F.lit(v) for k, v in fixed.items()}, **given)


def describe_error(error: BaseException, stage: str, entity: str | None = None) -> dict[str, Any]:
    """Any exception as the columns of an integrity message."""
    text = f"Unexpected error ({type(error).__name__}: {error}) in {stage}"
    return {"Entity": entity, "Key": "", "FailureType": "integrity", "Status": "error", "ErrorType": type(error).__name__, "ErrorMessage": text, "Category": "Bad file"}


def count_rows(frame: DataFrame) -> int:
    return frame.agg(F.count(F.lit(1))).first()[0]
