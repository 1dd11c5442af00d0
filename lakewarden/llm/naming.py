"""Column names of tables that operators pass through: any name may occur, dots, quotes and an operator's own included."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A top-level column, whatever its name."""
    return F.col(quoted(name))


def columns(df: DataFrame) -> list[Column]:
    """All columns of a table, as they are."""
    return [column(name) for name in df.columns]


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that clashes with none of ``taken`` in any case."""
    known, found = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        found.append(name)
    return found


def without(df: DataFrame, keys: DataFrame, name: str, kind: str = "left_anti") -> DataFrame:
    """The rows of ``df`` whose column ``name`` is not (``left_semi``: is) in the one column of ``keys``, which may be
    marked for broadcast by the caller who knows its size."""
    (other,) = unused(df.columns, "key")
    renamed = keys.toDF(other)
    return df.join(renamed, column(name) == column(other), kind).select(*columns(df))
