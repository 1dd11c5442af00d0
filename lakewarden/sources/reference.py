"""Reference data: tables, Parquet files (relative to the document or by URI) and Arrow streams, loaded on first use."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lakewarden.sources.arrowfiles import read_arrow


def loader(spark: SparkSession, config: Mapping[str, Mapping[str, Any]], base: Path | str | None = None, extra: Mapping[str, DataFrame] | None = None) -> Callable[[str], DataFrame | None]:
    """A function from a name to its DataFrame, or None where nothing is configured under the name."""
    extra = extra or {}

    def load(name: str) -> DataFrame | None:
        if name in extra:
            return extra[name]
        if name not in config:
            return None
        spec = config[name]
        if spec["type"] == "table":
            return spark.table(".".join(spec[k] for k in ("database", "table_name") if spec.get(k)))
        if spec["type"] == "filename":
            place = f"{str(base).rstrip('/')}/{spec['filename']}" if base else spec["filename"]
        elif spec["type"] == "uri":
            place = spec["uri"]
        else:
            raise ValueError(f"unknown kind of reference data {spec['type']!r}")
        return read_arrow(spark, place) if place.endswith((".arrow", ".arrows")) else spark.read.parquet(place)

    return load
